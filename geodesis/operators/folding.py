"""Vertices that hang on by one edge, folded into what they hang on.

Every path to or from a vertex with one neighbour runs over that neighbour, so
what it adds to all scores is a matter of counting. Such vertices are taken off in
rounds, all at once in each, and leave their number with their neighbour; what is
left is traversed, with a vertex standing for all that was folded into it. Trees
go altogether if rounds allow. Fewer rounds give the same scores with more left to
traverse, so a long chain need not be taken off to its end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.graph import Graph, arcs, edge_key
from geodesis.operators.field import refuse_unusable, unusable_weights
from geodesis.operators.merging import smallest_reachable
from geodesis.workspace import Workspace

# Folding starts if at least one vertex in so many hangs on by one edge.
WORTH = 50


@dataclass(frozen=True)
class Folded:
    """What is left of a graph, and what was folded into it.

    ``masses``: ``id, inside, squares`` of vertices that others were folded into:
    how many, and the sum of the squares of how many each branch had. ``peeled``:
    the same of the vertices taken off, by round, with their ``parent``.
    """

    core: Graph
    masses: DataFrame
    tables: Workspace
    rounds: int

    @cached_property
    def _sized(self) -> tuple[DataFrame, DataFrame]:
        """``id, inside, squares, size`` of what is left, and ``id, parent, …`` of
        what was taken off; ``size`` is the number of vertices of the component."""
        tables = self.tables
        merged = smallest_reachable(self.core.edges.select("src", "dst"), tables, "folded")
        part = F.coalesce("component", "id").alias("part")
        left = self.core.vertices.join(merged.withColumnRenamed("node", "id"), "id", "left").select("id", part)
        left = left.join(self.masses, "id", "left").select("id", "part", *_known())
        tables.save("parts", left)
        sizes = tables.load("parts").groupBy("part").agg(F.sum(F.col("inside") + 1).alias("size"))
        tables.save("core_sized", tables.load("parts").join(sizes, "part").drop("part"))
        left = tables.load("core_sized")
        above, taken = left.select("id", "size"), []
        # The parent of a vertex is left, or was taken off in a later round.
        for number in range(self.rounds, 0, -1):
            peeled = tables.load(f"peeled_{number}").join(above.withColumnRenamed("id", "parent"), "parent")
            tables.save(f"sized_{number}", peeled.select("id", "parent", "inside", "squares", "size"))
            taken.append(tables.load(f"sized_{number}"))
            above = above.unionByName(taken[-1].select("id", "size"))
        peeled = taken[0]
        for frame in taken[1:]:
            peeled = peeled.unionByName(frame)
        return left, peeled

    def node_totals(self, found: DataFrame, endpoints: bool) -> DataFrame:
        """``id, total`` of all vertices from the sums over what was traversed."""
        left, peeled = self._sized
        inside, others = F.col("inside"), F.col("size") - 1 - F.col("inside")
        # Pairs that part at the vertex: all others, but for those of one branch.
        own = inside * inside - F.col("squares") + 2 * inside * others
        ends = 2 * (F.col("size") - 1) if endpoints else F.lit(0.0)
        left = left.join(found, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) + own + ends).alias("total"))
        return left.unionByName(peeled.select("id", (own + ends).alias("total")))

    def edge_totals(self, found: DataFrame) -> DataFrame:
        """``src, dst, total`` likewise."""
        _, peeled = self._sized
        across = 2 * (F.col("inside") + 1) * (F.col("size") - 1 - F.col("inside"))
        key = edge_key(F.col("id"), F.col("parent"), False)
        return found.unionByName(peeled.select(*key, across.alias("total")))


def _known() -> list:
    return [F.coalesce(name, F.lit(0.0)).alias(name) for name in ("inside", "squares")]


def fold(graph: Graph, tables: Workspace, rounds: int, weight: str | None = None) -> Folded | None:
    """Take off vertices with one neighbour in up to ``rounds`` rounds; None if
    the stored, undirected ``graph`` has few of them. Weights do not matter but
    for having to be lengths."""
    steps = arcs(graph, weight)
    refuse_unusable(tables.save("links_0", steps, **({"unusable": unusable_weights()} if weight else {})))
    masses, done = None, 0
    while done < rounds:
        links = tables.load(f"links_{done}").select("u", "w")
        ends = links.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("parent"))
        tables.save("ends", ends.filter("n = 1").select("u", "parent"))
        ends = tables.load("ends")
        # Of two that only have each other, the smaller stays.
        turned = ends.select(F.col("parent").alias("u"), F.col("u").alias("parent"))
        leaves = ends.join(ends.join(turned, ["u", "parent"], "left_semi").filter("u < parent"), ["u", "parent"], "left_anti")
        leaves = leaves.withColumnRenamed("u", "id")
        leaves = leaves.join(masses, "id", "left") if masses is not None else leaves.withColumns(dict.fromkeys(("inside", "squares"), F.lit(0.0)))
        number = tables.save(f"peeled_{done + 1}", leaves.select("id", "parent", *_known()))["rows"]
        tables.drop("ends")
        if number == 0 or (done == 0 and number * WORTH < graph.n):
            break
        done += 1
        peeled = tables.load(f"peeled_{done}")
        whole = F.col("inside") + 1
        gained = peeled.groupBy(F.col("parent").alias("id")).agg(F.sum(whole).alias("inside"), F.sum(whole * whole).alias("squares"))
        if masses is not None:
            gained = masses.unionByName(gained).groupBy("id").agg(F.sum("inside").alias("inside"), F.sum("squares").alias("squares"))
        tables.save(f"masses_{done}", gained)
        masses = tables.load(f"masses_{done}")
        for end in ("u", "w"):
            links = links.join(peeled.select(F.col("id").alias(end)), end, "left_anti")
        tables.save(f"links_{done}", links)
        tables.drop(f"links_{done - 1}")
    tables.drop(f"links_{done}")
    if not done:
        return None
    gone = tables.load("peeled_1").select("id")
    for number in range(2, done + 1):
        gone = gone.unionByName(tables.load(f"peeled_{number}").select("id"))
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    tables.save("core_edges", edges.select(*graph.edges.columns))
    n = tables.save("core", graph.vertices.join(gone, "id", "left_anti"))["rows"]
    core = Graph(tables.load("core"), tables.load("core_edges"), kept=True)
    core.__dict__["n"] = n
    return Folded(core, masses.join(core.vertices, "id", "left_semi"), tables, done)
