"""Graphs from whitespace-separated text, any line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodesis.graph import Graph


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, tokens`` of each line; only the tokens of a blank line are none."""
    lines = spark.read.text(path)
    blank = F.trim(F.regexp_replace("value", r"\s+", " "))
    tokens = F.when(blank == "", F.array().cast("array<string>")).otherwise(F.split(blank, " "))
    return lines.select("value", tokens.alias("tokens"))


def _checked(lines: DataFrame, good: Column, mode: str) -> DataFrame:
    good = good & F.forall("tokens", lambda token: token.try_cast("long").isNotNull())
    if mode == "drop":
        return lines.filter(good)
    complaint = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))
    return lines.select(F.when(good, F.col("tokens")).otherwise(complaint).alias("tokens"))


def _mode(mode: str) -> None:
    if mode not in ("fail", "drop"):
        raise ValueError(f"mode must be 'fail' or 'drop', got {mode!r}")


def read_edge_list(spark: SparkSession, path: str, directed: bool = False, mode: str = "fail") -> Graph:
    """One ``src dst`` pair of integers per line. Other lines make the read fail,
    or are skipped with ``mode="drop"``."""
    _mode(mode)
    rows = _checked(_lines(spark, path), F.size("tokens") == 2, mode)
    edges = rows.select(
        F.col("tokens")[0].try_cast("long").alias("src"),
        F.col("tokens")[1].try_cast("long").alias("dst"),
    )
    return Graph.from_edges(edges, directed=directed)


def read_adjacency_list(spark: SparkSession, path: str, directed: bool = False, mode: str = "fail") -> Graph:
    """One ``origin target target …`` list of integers per line; an origin alone
    is a vertex without edges."""
    _mode(mode)
    rows = _checked(_lines(spark, path), F.size("tokens") >= 1, mode)
    ids = rows.select(F.transform("tokens", lambda token: token.try_cast("long")).alias("ids"))
    edges = ids.select(F.col("ids")[0].alias("src"), F.explode(F.expr("slice(ids, 2, size(ids) - 1)")).alias("dst"))
    # Every other id is the end of an edge.
    alone = ids.filter(F.size("ids") == 1).select(F.col("ids")[0].alias("id"))
    return Graph.from_edges(edges, alone, directed=directed)


def read_graph(
    spark: SparkSession, path: str, adjacency: bool = True, directed: bool = False, mode: str = "fail"
) -> Graph:
    """Either layout, chosen by ``adjacency``."""
    read = read_adjacency_list if adjacency else read_edge_list
    return read(spark, path, directed, mode)
