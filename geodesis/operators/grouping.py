"""Components dealt into groups that are traversed one after the other.

No path leaves a component, so what a traversal from all vertices holds is bounded by
the squares of the components, not by the square of the graph. Whole components go
into groups of about as many pairs of vertices as may be held at a time, and of no
more steps than are sent to every executor where that is possible; a component with
more pairs is a group of several batches. Vertices without a step are on no path and
in no group.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.graph import Graph
from geodesis.operators.field import Limits
from geodesis.operators.merging import smallest_reachable
from geodesis.workspace import Workspace

# Components are dealt into so many buckets by hash, and whole buckets into groups.
BUCKETS = 1_024
# Rows of a weighted traversal for each pair of source and vertex.
WEIGHTED = 4


@dataclass
class Group:
    """A part of a graph without steps to the rest, and its number of batches."""

    number: int
    batches: int
    pairs: int = 0
    steps: int = 0
    buckets: tuple[int, ...] = ()

    def graph(self, whole: Graph, tables: Workspace) -> Graph:
        vertices = tables.parts("group_vertices", [self.number]).select("id")
        graph = Graph(vertices, tables.parts("group_edges", [self.number]).select(*whole.edges.columns), whole.directed, kept=True)
        graph.__dict__["n"] = tables.rows("group_vertices", self.number)
        return graph

    def sources(self, tables: Workspace) -> DataFrame:
        """``source`` with its ``component`` and the component's ``size``."""
        return tables.parts("group_vertices", [self.number]).select(F.col("id").alias("source"), "component", "size")


def grouped(graph: Graph, tables: Workspace, limits: Limits, weighted: bool) -> list[Group]:
    """Write the groups of a stored graph to ``tables`` and return them; none if no
    vertex has a step."""
    merging = Workspace(tables.spark, "grouping")
    named = smallest_reachable(graph.edges.select("src", "dst"), merging)
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ends = graph.edges.filter("src <> dst").select(F.col("src").alias("node"))
    steps = ends.join(named, "node").groupBy("component").agg((F.count(F.lit(1)) * (1 if graph.directed else 2)).alias("steps"))
    bucket = F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int")
    tables.save("group_sizes", sizes.join(steps, "component").withColumn("bucket", bucket))
    sizes = tables.load("group_sizes")
    rows = WEIGHTED if weighted else 1
    pairs = F.sum(F.col("size").cast("double") * F.col("size")) * rows
    # At most as many rows as there are buckets.
    told = sizes.groupBy("bucket").agg(pairs.alias("pairs"), F.sum("steps").alias("steps")).collect()
    groups = _dealt([(row["bucket"], int(row["pairs"]), row["steps"]) for row in told], limits)
    if groups:
        owner = {bucket: group.number for group in groups for bucket in group.buckets}
        number = F.get(F.array(*[F.lit(owner.get(k, -1)) for k in range(BUCKETS)]), F.col("bucket"))
        placed = named.join(sizes.select("component", "size", number.alias("group")), "component")
        tables.save_parted("group_vertices", placed.select(F.col("node").alias("id"), "component", "size", "group"), "group")
        at = tables.parts("group_vertices").select(F.col("id").alias("src"), F.col("part").alias("group"))
        tables.save_parted("group_edges", graph.edges.join(at, "src"), "group")
    merging.discard()
    tables.drop("group_sizes")
    return groups


def _dealt(buckets: list[tuple[int, int, int]], limits: Limits) -> list[Group]:
    """Groups of ``(bucket, pairs, steps)``, each bucket in the first with room."""
    groups: list[Group] = []
    for bucket, pairs, steps in sorted(buckets, key=lambda row: (-row[1], row[0])):
        # Steps beyond what is broadcast are laid out alike, however many.
        large = steps > limits.broadcast_arcs
        for group in groups:
            alike = group.steps > limits.broadcast_arcs if large else group.steps + steps <= limits.broadcast_arcs
            if alike and group.pairs + pairs <= group.batches * limits.state_rows:
                break
        else:
            group = Group(len(groups), max(1, ceil(pairs / limits.state_rows)))
            groups.append(group)
        group.pairs, group.steps, group.buckets = group.pairs + pairs, group.steps + steps, (*group.buckets, bucket)
    return groups
