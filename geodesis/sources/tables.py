"""Graphs found in the sales, event and web tables.

Each reads whole tables and reduces them by keyed aggregation before any join,
so a key that holds a large share of the rows is combined where it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodesis.graph import Graph


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def web(spark: SparkSession, folder: str) -> Graph:
    """Pages and the link targets in their markup, joined by undirected edges."""
    pages = table(spark, folder, "pages")
    target = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return Graph.from_edges(pages.select(F.col("url").alias("src"), target.alias("dst")))


def duty(spark: SparkSession, folder: str) -> Graph:
    """Users who hand over within a minute: from the first one seen in it to the
    last, weighted by the seconds between them (counting both). All users are
    vertices, also those who never open or close a minute."""
    events = table(spark, folder, "events")
    seen = F.struct("ts", "event_id", "user_id")
    minutes = events.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min(seen).alias("first"), F.max(seen).alias("last")
    )
    seconds = F.second("last.ts") - F.second("first.ts") + 1
    steps = minutes.select(
        F.col("first.user_id").alias("src"), F.col("last.user_id").alias("dst"), seconds.alias("seconds")
    )
    users = events.select(F.col("user_id").alias("id"))
    return Graph.from_edges(steps, users.distinct(), directed=True)


def _deals(spark: SparkSession, folder: str) -> DataFrame:
    """``o_custkey, l_suppkey, price``: lowest price per customer and supplier."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_extendedprice").alias("price")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.min("price").alias("price"))
    )


def trade(spark: SparkSession, folder: str) -> Graph:
    """Customers (even ids) and the suppliers (odd ids) they bought from."""
    # Pairs are made distinct as edges, once; the same line more often is no more than that.
    lines = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_suppkey") * 2 + 1).alias("dst"))
    orders = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("src"))
    return Graph.from_edges(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst"))


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """``src, dst, price``: supplier nation, customer nation, lowest price."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return (
        _deals(spark, folder)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), "price")
    )


def ferries(spark: SparkSession, folder: str) -> Graph:
    """Nations, and for each return flag the customer nation to which a supplier
    nation sold its dearest line with that flag. All nations are vertices."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    # Reduced to a line per supplier and flag before anything is joined.
    line = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    dearest = lines.groupBy("l_suppkey", "l_returnflag").agg(F.max(line).alias("line"))
    dearest = dearest.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    dearest = dearest.groupBy("s_nationkey", "l_returnflag").agg(F.max("line").alias("line"))
    sold = dearest.join(orders, F.col("line.l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    pairs = sold.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return Graph.from_edges(pairs, _nations(spark, folder))


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def lanes(spark: SparkSession, folder: str) -> Graph:
    """Supplier nations and the customer nations they deliver to, weighted by
    the lowest price of a delivery rounded up."""
    rounded = _deliveries(spark, folder).withColumn("price", F.ceil("price"))
    return Graph.from_edges(rounded, _nations(spark, folder), directed=True)


def tolls(spark: SparkSession, folder: str) -> Graph:
    """Nations that trade either way, weighted by the lowest price in thousands,
    rounded up to quarters so that sums are exact; where the keys add up to a
    multiple of seven, the price is not known."""
    quarters = F.ceil(F.col("price").cast("double") / 250) / 4
    price = F.when((F.col("src") + F.col("dst")) % 7 != 0, quarters)
    return Graph.from_edges(_deliveries(spark, folder).withColumn("price", price), _nations(spark, folder))


def relay(spark: SparkSession, folder: str) -> Graph:
    """Parts on the first and the last line of an order, first to last."""
    line = F.struct("l_linenumber", "l_partkey")
    orders = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min(line).alias("first"), F.max(line).alias("last")
    )
    steps = orders.select(F.col("first.l_partkey").alias("src"), F.col("last.l_partkey").alias("dst"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    return Graph.from_edges(steps, parts, directed=True)


def places(spark: SparkSession, folder: str) -> Graph:
    """Regions, their nations, and the customers and suppliers in those: a
    forest. The kind of an id is its remainder by 4."""
    nation = table(spark, folder, "nation").select(
        (F.col("n_regionkey") * 4).cast("long").alias("src"), (F.col("n_nationkey") * 4 + 1).cast("long").alias("dst")
    )
    customer = table(spark, folder, "customer").select(
        (F.col("c_nationkey") * 4 + 1).cast("long").alias("src"), (F.col("c_custkey") * 4 + 2).alias("dst")
    )
    supplier = table(spark, folder, "supplier").select(
        (F.col("s_nationkey") * 4 + 1).cast("long").alias("src"), (F.col("s_suppkey") * 4 + 3).alias("dst")
    )
    regions = table(spark, folder, "region").select((F.col("r_regionkey") * 4).cast("long").alias("id"))
    return Graph.from_edges(nation.unionByName(customer).unionByName(supplier), regions)
