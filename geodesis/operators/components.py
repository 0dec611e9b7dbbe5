"""Connected components and their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.graph import Graph
from geodesis.operators.field import Limits
from geodesis.operators.merging import smallest_reachable
from geodesis.workspace import Workspace


def connected_components(graph: Graph, limits: Limits | None = None) -> DataFrame:
    """``id, component`` with the smallest id of the component as its name; the
    direction of edges does not matter. Rounds grow with the logarithm of the
    longest chain. ``limits`` is accepted for the sake of older calls."""
    tables = Workspace(graph.vertices.sparkSession, "components")
    return label_components(graph.stored(tables), tables)


def label_components(graph: Graph, tables: Workspace) -> DataFrame:
    """The same for a graph stored in ``tables``."""
    merged = smallest_reachable(graph.edges.select("src", "dst"), tables)
    named = graph.vertices.join(merged.withColumnRenamed("node", "id"), "id", "left")
    tables.save("components", named.select("id", F.coalesce("component", "id").alias("component")))
    return tables.load("components")


def component_sizes(graph: Graph, components: DataFrame, larger_than: int = 0) -> DataFrame:
    """``component, n_nodes, n_edges`` of components with more than
    ``larger_than`` vertices. Edges are counted per vertex before they are
    attributed, so a hub is one row by then."""
    at = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return (
        components.join(at, "id", "left")
        .groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("n_nodes"),
            F.coalesce(F.sum("edges"), F.lit(0)).cast("long").alias("n_edges"),
        )
        .filter(F.col("n_nodes") > larger_than)
    )
