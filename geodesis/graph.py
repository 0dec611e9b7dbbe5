"""The graph as two relations: vertices ``id`` and edges ``src, dst, …``."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodesis.functions.checks import require_bool
from geodesis.workspace import Workspace


def _known(name: str, what: str = "edge") -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"{what} without {name}"))).alias(name)


@dataclass(frozen=True)
class Graph:
    """A simple graph: one edge per pair, each vertex listed once.

    ``edges`` holds ``src``, ``dst`` and any number of numeric attributes, of
    which a call may name one as its weight. Undirected edges are kept as the
    ordered pair ``src <= dst``. Ids are of any orderable type.

    ``kept`` tells that both are read from tables; ``derived`` that the vertices
    are the endpoints and the ``declared`` ones.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    kept: bool = field(default=False, repr=False)
    declared: DataFrame | None = field(default=None, repr=False)
    derived: bool = field(default=False, repr=False)

    @classmethod
    def from_edges(
        cls,
        edges: DataFrame,
        vertices: DataFrame | None = None,
        directed: bool = False,
        duplicates: str = "min",
    ) -> Graph:
        """Build from rows ``src, dst`` with optional numeric attributes, and
        optionally from vertices ``id`` that need not occur in any edge.

        Missing attribute values count as 1. Parallel edges collapse into one
        with the smallest value of each attribute; with ``duplicates="error"``
        parallel edges that disagree are refused.
        """
        require_bool("directed", directed)
        if duplicates not in ("min", "error"):
            raise ValueError(f"duplicates must be 'min' or 'error', got {duplicates!r}")
        simple = simple_edges(edges, directed)
        if duplicates == "error":
            _refuse_disagreeing(edges, directed)
        return cls(vertex_set(simple, vertices), simple, directed, declared=vertices, derived=True)

    @cached_property
    def n(self) -> int:
        """Number of vertices, counted once."""
        return self.vertices.count()

    @property
    def attributes(self) -> list[str]:
        return [name for name in self.edges.columns if name not in ("src", "dst")]

    def stored(self, workspace: Workspace) -> Graph:
        """The same graph read from tables, so its derivation runs only once; a
        graph that is read from tables already stays as it is."""
        if self.kept:
            return self
        workspace.save("edges", self.edges)
        edges = workspace.load("edges")
        vertices = vertex_set(edges, self.declared) if self.derived else self.vertices
        n = workspace.save("vertices", vertices)["rows"]
        graph = Graph(workspace.load("vertices"), edges, self.directed, kept=True)
        graph.__dict__["n"] = n
        return graph


def _oriented(edges: DataFrame, directed: bool) -> DataFrame:
    """Attributes as doubles without gaps; undirected pairs in one order."""
    attributes = [name for name in edges.columns if name not in ("src", "dst")]
    values = [F.coalesce(F.col(name).cast("double"), F.lit(1.0)).alias(name) for name in attributes]
    known = edges.select(_known("src"), _known("dst"), *values)
    if directed:
        return known
    return known.select(*edge_key(F.col("src"), F.col("dst"), directed), *attributes)


def edge_key(tail: Column, head: Column, directed: bool) -> tuple[Column, Column]:
    """The pair under which an edge walked from ``tail`` to ``head`` is kept."""
    if directed:
        return tail.alias("src"), head.alias("dst")
    return F.least(tail, head).alias("src"), F.greatest(tail, head).alias("dst")


def simple_edges(edges: DataFrame, directed: bool) -> DataFrame:
    """One row per edge, however often and in whichever direction it was given."""
    oriented = _oriented(edges, directed)
    attributes = [name for name in oriented.columns if name not in ("src", "dst")]
    if not attributes:
        return oriented.distinct()
    return oriented.groupBy("src", "dst").agg(*[F.min(name).alias(name) for name in attributes])


def _refuse_disagreeing(edges: DataFrame, directed: bool) -> None:
    oriented = _oriented(edges, directed)
    attributes = [name for name in oriented.columns if name not in ("src", "dst")]
    if not attributes:
        return
    spread = oriented.groupBy("src", "dst").agg(
        *[(F.min(name) != F.max(name)).alias(name) for name in attributes]
    )
    clash = F.lit(False)
    for name in attributes:
        clash = clash | F.col(name)
    if not spread.filter(clash).isEmpty():
        raise ValueError("parallel edges disagree on an attribute")


def vertex_set(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Edge endpoints together with the declared vertices, each once."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if declared is not None:
        ends = ends.unionByName(declared.select(_known("id", "vertex")))
    return ends.distinct()


def arcs(graph: Graph, weight: str | None = None) -> DataFrame:
    """Directed steps ``u, w`` a path may take (``u, w, weight`` if weighted).

    Undirected edges can be walked both ways. Self-loops are on no shortest
    path. A weight no edge carries counts as 1 throughout.
    """
    edges = graph.edges.filter(F.col("src") != F.col("dst"))
    step = []
    if weight is not None:
        value = F.col(weight) if weight in graph.attributes else F.lit(1.0)
        step = [value.alias("weight")]
    if graph.directed:
        return edges.select(F.col("src").alias("u"), F.col("dst").alias("w"), *step)
    ways = F.array(
        F.struct(F.col("src").alias("u"), F.col("dst").alias("w")),
        F.struct(F.col("dst").alias("u"), F.col("src").alias("w")),
    )
    return edges.select(F.explode(ways).alias("way"), *step).select("way.*", *[c for c in ["weight"] if step])


# A vertex with more rows than the block size has slots; the list of such
# vertices is sent around up to these bounds. Beyond them, all rows are salted.
BROADCAST_HUBS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64


def _with_slots(rows: DataFrame, other: str, block_size: int) -> DataFrame:
    """``rows`` with ``slots`` for their ``id``: how many blocks of about
    ``block_size`` rows it fills. Rows are never moved by their bare id."""
    tables = Workspace(rows.sparkSession, "slots")
    counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > block_size)
    hubs = counted.select("id", F.ceil(F.col("degree") / block_size).cast("int").alias("slots"))
    seen = tables.save("hubs", hubs, bytes=F.sum(F.octet_length(F.col("id").cast("string")).cast("long")))
    hubs = tables.load("hubs")
    if not seen["rows"]:
        return rows.withColumn("slots", F.lit(1))
    if seen["rows"] <= BROADCAST_HUBS and seen["bytes"] <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(hubs), "id", "left")
    else:
        salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
        everywhere = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt).join(everywhere, ["id", "salt"], "left").drop("salt")
    return joined.withColumn("slots", F.coalesce("slots", F.lit(1)))


def _slot(other: str) -> Column:
    return F.pmod(F.xxhash64(other), F.col("slots")).cast("int")


def neighbours(graph: Graph, frontier: DataFrame, block_size: int = 100_000) -> DataFrame:
    """Rows ``id`` of a frontier with each vertex one step away. The steps of a
    vertex with more than ``block_size`` of them are spread over slots, and its
    frontier rows go to each."""
    steps = arcs(graph).select(F.col("u").alias("id"), F.col("w").alias("neighbour"))
    slotted = _with_slots(steps, "neighbour", block_size)
    steps = slotted.withColumn("slot", _slot("neighbour")).drop("slots")
    hubs = slotted.filter("slots > 1").select("id", "slots").distinct()
    asked = frontier.select("id").join(hubs, "id", "left")
    asked = asked.select("id", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot"))
    return asked.join(steps, ["id", "slot"]).select("id", "neighbour")


def sorted_vertices(graph: Graph) -> DataFrame:
    return graph.vertices.orderBy("id")


def sorted_edges(graph: Graph) -> DataFrame:
    return graph.edges.orderBy("src", "dst")


def adjacency(graph: Graph, block_size: int = 100_000) -> DataFrame:
    """Sorted neighbours of each vertex: ``id, block, neighbours``, with the key
    ``(id, block)``.

    A vertex with more than ``block_size`` neighbours spans several blocks of
    about that size, so no row and no task holds an unbounded list. Vertices
    without neighbours have one empty block.
    """
    edges = graph.edges
    listed = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    if not graph.directed:
        back = edges.filter(F.col("src") != F.col("dst"))
        listed = listed.unionByName(back.select(F.col("dst").alias("id"), F.col("src").alias("neighbour")))
    grouped = (
        _with_slots(listed, "neighbour", block_size)
        .groupBy("id", _slot("neighbour").alias("block"))
        .agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))
    )
    return graph.vertices.join(grouped, "id", "left").select(
        "id",
        F.coalesce("block", F.lit(0)).alias("block"),
        F.coalesce("neighbours", F.array().cast(grouped.schema["neighbours"].dataType)).alias("neighbours"),
    )
