"""Numbers in place of ids that are none, while a graph is traversed.

State has a row for every pack of sources and vertex reached, and a step carries two
ids: numbers are shorter than texts, and as short for every text."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from geodesis.graph import Graph
from geodesis.workspace import Workspace

# Vertices that are numbered in one place.
NUMBERED = 50_000


def number(graph: Graph, tables: Workspace) -> DataFrame | None:
    """``id, number`` of the vertices, the same for the same vertices; None if ids
    are numbers."""
    if isinstance(graph.vertices.schema["id"].dataType, NumericType):
        return None
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, ceil(graph.n / NUMBERED))))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    dealt = graph.vertices.select("id", part.alias("part")).withColumn("place", place)
    tables.save("numbers", dealt.select("id", (F.col("part") * F.lit(2**32) + F.col("place")).alias("number")))
    return tables.load("numbers")


def with_numbers(rows: DataFrame, numbers: DataFrame, *names: str) -> DataFrame:
    """Rows with the numbers of some columns in place of their ids."""
    for name in names:
        told = numbers.select(F.col("id").alias(name), F.col("number").alias("_number"))
        rows = rows.join(told, name).drop(name).withColumnRenamed("_number", name)
    return rows


def with_ids(rows: DataFrame, numbers: DataFrame, *names: str) -> DataFrame:
    """Rows with the ids of some columns in place of their numbers."""
    for name in names:
        told = numbers.select(F.col("number").alias(name), F.col("id").alias("_id"))
        rows = rows.join(told, name).drop(name).withColumnRenamed("_id", name)
    return rows


def renumbered(graph: Graph, numbers: DataFrame, tables: Workspace) -> Graph:
    """The graph with numbers for ids."""
    tables.save("numbered_edges", with_numbers(graph.edges, numbers, "src", "dst").select(*graph.edges.columns))
    made = Graph(numbers.select(F.col("number").alias("id")), tables.load("numbered_edges"), graph.directed, kept=True)
    made.__dict__["n"] = graph.n
    return made
