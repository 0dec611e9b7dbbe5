"""Several rounds of a traversal in one job, for graphs and sources that are few.

State is one row per source and reached vertex: ``source, node, dist, sigma`` and
``passed``, the shares that steps further out sent back, so that the dependency is
``sigma * passed``. Rows stay in the partition of their source and steps are
broadcast, as lists of the vertices one step away with the vertex itself in front.
A round is a look-up, an explode and an aggregation without a shuffle: rows of the
frontier go to themselves and to all next vertices, others to themselves alone. So
rounds can follow each other in one plan, outwards and back, and the cost of
starting jobs and of writing tables is paid once instead of once per distance.
Every round passes over all rows, which is why this is for few of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.graph import edge_key
from geodesis.workspace import session_conf

# Rows of state that a task of a chained traversal holds.
ROWS_PER_TASK = 200_000

_OWN = "IF(at = node, {}, NULL)"


def _one_round(state: DataFrame, steps: DataFrame, distance: int) -> DataFrame:
    """Rows go to themselves, as ``at``, and those at a distance to all next ones."""
    met = state.join(F.broadcast(steps), F.col("node") == F.col("u"))
    to = F.explode(F.when(F.col("dist") == distance, F.col("next")).otherwise(F.array("node")))
    return met.select(*state.columns, to.alias("at"))


def _outwards(state: DataFrame, steps: DataFrame, distance: int) -> DataFrame:
    own, sent = F.expr(f"max({_OWN.format('sigma')})"), F.expr("sum(IF(at = node, NULL, sigma))")
    nearest = F.expr("min(IF(at = node, dist, dist + 1))")
    grown = _one_round(state, steps, distance).groupBy("source", "at").agg(nearest.alias("dist"), F.coalesce(own, sent).alias("sigma"))
    return grown.select("source", F.col("at").alias("node"), "dist", "sigma")


def _back(state: DataFrame, steps: DataFrame, distance: int) -> DataFrame:
    own = {name: F.expr(f"max({_OWN.format(name)})").alias(name) for name in ("dist", "sigma", "passed")}
    sent = F.expr("sum(IF(at = node, NULL, 1 / sigma + passed))").alias("sent")
    summed = _one_round(state, steps, distance).groupBy("source", "at").agg(*own.values(), sent)
    passed = F.col("passed") + F.when(F.col("dist") == distance - 1, F.coalesce("sent", F.lit(0.0))).otherwise(0.0)
    # Backwards, a step may lead to where the source does not get.
    return summed.filter("dist IS NOT NULL").select("source", F.col("at").alias("node"), "dist", "sigma", passed.alias("passed"))


def step_lists(vertices: DataFrame, steps: DataFrame) -> DataFrame:
    """``u, next`` for every vertex ``id``: itself, then where ``steps`` (``u, w``)
    lead from it."""
    listed = steps.groupBy("u").agg(F.collect_list("w").alias("next"))
    joined = vertices.select(F.col("id").alias("u")).join(listed, "u", "left")
    own = F.array("u")
    return joined.select("u", F.when(F.col("next").isNull(), own).otherwise(F.concat(own, "next")).alias("next"))


def width_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_TASK))


def planning(spark, width: int):
    """Settings for chained plans: they are small, and fixed from the start."""
    return session_conf(
        spark,
        spark__sql__adaptive__enabled="false",
        spark__sql__shuffle__partitions=str(width),
        spark__sql__requireAllClusterKeysForCoPartition="false",
    )


def traversed(sources: DataFrame, leaving: DataFrame, entering: DataFrame, rounds: int, width: int) -> DataFrame:
    """State of the vertices within ``rounds`` steps of each source. It is complete
    if none is that far away. ``leaving`` and ``entering`` are the lists of steps
    forwards and backwards, the same if undirected."""
    state = sources.select("source").repartition(width, "source")
    state = state.select("source", F.col("source").alias("node"), F.lit(0).alias("dist"), F.lit(1.0).alias("sigma"))
    for distance in range(rounds):
        state = _outwards(state, leaving, distance)
    state = state.withColumn("passed", F.lit(0.0))
    for distance in range(rounds, 0, -1):
        state = _back(state, entering, distance)
    return state


def edge_sums(state: DataFrame, entering: DataFrame, directed: bool, width: int) -> DataFrame:
    """``src, dst, total``: dependencies on an edge summed over the sources."""
    state = state.repartition(width, "source")
    share = (1 / F.col("sigma") + F.col("passed")).alias("share")
    heads = state.select("source", F.col("node").alias("w"), (F.col("dist") - 1).alias("dist"), share)
    heads = heads.join(F.broadcast(entering), F.col("w") == F.col("u")).select("source", "w", "dist", "share", F.explode("next").alias("node"))
    tails = state.select("source", "node", "dist", "sigma").hint("shuffle_hash")
    key = edge_key(F.col("node"), F.col("w"), directed)
    return heads.join(tails, ["source", "node", "dist"]).groupBy(*key).agg(F.sum(F.col("sigma") * F.col("share")).alias("total"))
