"""Betweenness of vertices and edges, and the relations beneath it."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.functions.checks import require_bool
from geodesis.functions.scale import edge_scale, node_scale, rescaled
from geodesis.graph import Graph, edge_key
from geodesis.operators import dependencies as deps
from geodesis.operators.field import Field, Limits
from geodesis.operators.folding import fold
from geodesis.operators.grouping import Group, grouped
from geodesis.operators.hops import PACKED, PATHS, each_source, lanes, walk_hops
from geodesis.operators.numbering import number, renumbered, with_ids, with_numbers
from geodesis.operators.pivots import sample_vertices
from geodesis.operators.weighted import TIGHT, walk_weighted
from geodesis.workspace import Workspace


class _Traversal:
    """Traversal of a stored graph from a set of sources, batch by batch."""

    def __init__(
        self,
        graph: Graph,
        chosen: DataFrame | None,
        weight: str | None,
        limits: Limits | None,
        folding: bool = False,
        numbering: bool = True,
    ) -> None:
        self.tables = Workspace(graph.vertices.sparkSession)
        self.limits = limits or Limits()
        self.graph = self.whole = graph.stored(self.tables)
        # Sums over all sources do not need those that hang on by one edge.
        self.folded = None
        if folding and chosen is None and not graph.directed and self.limits.fold_rounds:
            self.folded = fold(self.whole, self.tables, self.limits.fold_rounds, weight)
        if self.folded:
            self.graph = self.folded.core
        if chosen is None:
            self.count = self.graph.n
            self.sources = self.graph.vertices.select(F.col("id").alias("source"))
        else:
            sources = chosen.select(F.col("id").alias("source")).distinct()
            self.count = self.tables.save("sources", sources)["rows"]
            self.sources = self.tables.load("sources")
            unknown = self.sources.join(self.graph.vertices, F.col("source") == F.col("id"), "left_anti")
            if not unknown.isEmpty():
                raise ValueError("some sources are not vertices of the graph")
        # Texts are numbered, and named again in what is returned.
        self.numbers = number(self.graph, self.tables) if numbering else None
        if self.numbers is not None:
            self.graph = renumbered(self.graph, self.numbers, self.tables)
            self.sources = with_numbers(self.sources, self.numbers, "source")
        wanted = ceil(self.count * self.graph.n / self.limits.state_rows)
        self.batches = max(1, min(wanted, self.count))
        # Sums over all sources are made by groups of components if pairs are too many.
        self.weight = weight
        self.groups: list[Group] = []
        if folding and chosen is None and wanted > 1:
            self.groups = grouped(self.graph, self.tables, self.limits, weight is not None)
            self.batches = sum(group.batches for group in self.groups) or 1
        # Sums of batches; under a name, those of an earlier run are taken over.
        self.kept = self.tables
        if self.limits.run:
            self.kept = Workspace(self.tables.spark, "kept", self.limits.run)
            self._recognise(weight)
        if not self.groups:
            self.field = self._field(self.graph, ceil(self.count / self.batches))

    def _field(self, graph: Graph, sources: int) -> Field:
        field = Field(graph, self.tables, self.weight, self.limits, sources=sources, packed=self.weight is None)
        if self.folded:
            masses = self.folded.masses.select("id", (F.col("inside") + 1).alias("mass"))
            field.stand_for(masses if self.numbers is None else with_numbers(masses, self.numbers, "id"))
        return field

    def _recognise(self, weight: str | None) -> None:
        """Refuse a name under which something else was begun."""
        edges = self.graph.edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(self.graph.edges.columns)).cast("decimal(38)")))
        sources = self.sources.agg(F.count(F.lit(1)), F.sum(F.xxhash64("source").cast("decimal(38)")))
        told = [self.graph.n, self.graph.directed, weight, self.batches, *edges.first(), *sources.first()]
        mark = self.tables.spark.range(1).select(F.lit(repr([str(x) for x in told])).alias("of"))
        if not self.kept.adopt("of", 0):
            self.kept.append("of", 0, mark, again=True)
        if self.kept.parts("of").first()["of"] != mark.first()["of"]:
            raise ValueError(f"the run {self.limits.run!r} was begun with another graph, sources or sizes")

    def run(self, backward: bool = True, wanted: tuple[str, ...] = ()):
        """Go through all batches; state is in the tables at each stop. Batches of
        which all ``wanted`` tables are there already are left out."""
        walk = walk_hops if self.weight is None else walk_weighted
        gather = deps.gather_hops if self.weight is None else deps.gather_weighted
        first = 0
        for group in self.groups or [None]:
            batches = group.batches if group else self.batches
            numbers = range(first, first + batches)
            first += batches
            done = [self.limits.run and wanted and all([self.kept.adopt(name, batch) for name in wanted]) for batch in numbers]
            if group and not all(done):
                graph = group.graph(self.graph, self.tables)
                self.field, self.sources = self._field(graph, ceil(graph.n / batches)), group.sources(self.tables)
            for number, batch in enumerate(numbers):
                if done[number]:
                    continue
                part = self.sources
                if batches > 1:
                    part = part.filter(F.pmod(F.xxhash64("source"), F.lit(batches)) == number)
                depth = walk(self.field, part)
                if backward:
                    gather(self.field, depth)
                yield batch
                self.tables.drop(PATHS, PACKED, deps.DEPENDENCIES, TIGHT)
            if not group or not all(done):
                self.field.release()
        self.tables.drop("sources", "group_vertices", "group_edges")

    def node_totals(self, endpoints: bool) -> DataFrame:
        """``id, total`` over all batches."""
        total = self.named(self.kept.parts(self.node_sums(endpoints)).groupBy("id").agg(F.sum("total").alias("total")), "id")
        return self.folded.node_totals(total, endpoints) if self.folded else total

    def edge_totals(self) -> DataFrame:
        """``src, dst, total`` over all batches."""
        total = self.kept.parts("edge_sums").groupBy("src", "dst").agg(F.sum("total").alias("total"))
        total = self.named(total, "src", "dst").select(*edge_key(F.col("src"), F.col("dst"), self.whole.directed), "total")
        return self.folded.edge_totals(total) if self.folded else total

    def named(self, rows: DataFrame, *names: str) -> DataFrame:
        """Rows with the ids of the graph in some columns."""
        return rows if self.numbers is None else with_ids(rows, self.numbers, *names)

    def node_sums(self, endpoints: bool) -> str:
        """The table of sums, which with ends counted is another one."""
        return "end_sums" if endpoints and not self.folded else "node_sums"

    def paths(self) -> DataFrame:
        """``source, node, dist, sigma`` of the batch, by the field's ids."""
        rows = self.tables.parts(PATHS)
        if self.field.weighted:
            return rows.select("source", "node", "dist", "sigma")
        met = [F.col(s) > 0 for s in lanes(self.field, "s")]
        rows = each_source(self.field, rows, met, sigma="s")
        return rows.select("source", "node", F.col("part").cast("double").alias("dist"), "sigma")

    def collect_nodes(self, endpoints: bool, batch: int) -> None:
        # With vertices folded away, ends are counted at the end.
        self.keep_sums(self.node_sums(endpoints), deps.node_sums(self.field, endpoints and not self.folded), batch)

    def collect_into(self, name: str, frame: DataFrame, batch: int) -> None:
        with self.field.planning():
            self.tables.append(name, batch, frame)

    def keep_sums(self, name: str, frame: DataFrame, batch: int) -> None:
        with self.field.planning():
            self.kept.append(name, batch, frame, again=self.kept is not self.tables)


def _node_scores(run: _Traversal, normalized: bool, k: int | None, endpoints: bool) -> DataFrame:
    graph = run.whole
    scale = node_scale(graph.n, normalized, graph.directed, k)
    score = rescaled(F.coalesce("total", F.lit(0.0)), scale)
    return graph.vertices.join(run.node_totals(endpoints), "id", "left").select("id", score.alias("centrality"))


def _edge_scores(run: _Traversal, normalized: bool) -> DataFrame:
    graph = run.whole
    scale = edge_scale(graph.n, normalized, graph.directed)
    score = rescaled(F.coalesce("total", F.lit(0.0)), scale)
    return graph.edges.join(run.edge_totals(), ["src", "dst"], "left").select("src", "dst", score.alias("centrality"))


def _chosen(
    graph: Graph, k: int | None, pivots: DataFrame | None, seed: int | None
) -> tuple[Graph, DataFrame | None]:
    """The graph and the sources to start from, None for all vertices."""
    if k is not None and pivots is not None:
        raise ValueError("give k or pivots, not both")
    if k is not None:
        graph = graph.stored(Workspace(graph.vertices.sparkSession, "sampled"))
        pivots = sample_vertices(graph, k, seed)
    return graph, pivots


def node_betweenness(
    graph: Graph,
    k: int | None = None,
    pivots: DataFrame | None = None,
    normalized: bool = True,
    weight: str | None = None,
    endpoints: bool = False,
    seed: int | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """``id, centrality`` for every vertex.

    Estimated from ``k`` sampled sources or from the sources ``id`` given as
    ``pivots``, exact otherwise. ``weight`` names the edge attribute that is
    the edge's length.
    """
    require_bool("normalized", normalized)
    require_bool("endpoints", endpoints)
    graph, pivots = _chosen(graph, k, pivots, seed)
    run = _Traversal(graph, pivots, weight, limits, folding=True)
    for batch in run.run(wanted=(run.node_sums(endpoints),)):
        run.collect_nodes(endpoints, batch)
    return _node_scores(run, normalized, None if pivots is None else run.count, endpoints)


def edge_betweenness(
    graph: Graph,
    normalized: bool = True,
    weight: str | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """``src, dst, centrality`` for every edge."""
    require_bool("normalized", normalized)
    return edge_run(graph, normalized, weight, limits)[0]


def edge_run(
    graph: Graph, normalized: bool, weight: str | None, limits: Limits | None, components: bool = False
) -> tuple[DataFrame, Workspace]:
    """Edge scores and the tables they are read from. ``components`` also writes
    that table of ``id, component``, for undirected graphs: the smallest source
    that reaches a vertex."""
    run = _Traversal(graph, None, weight, limits, folding=not components, numbering=not components)
    for batch in run.run(wanted=("edge_sums",)):
        run.keep_sums("edge_sums", deps.edge_sums(run.field), batch)
        if components:
            named = run.paths().groupBy(F.col("node").alias("id")).agg(F.min("source").alias("component"))
            run.collect_into("named", named, batch)
    if components:
        named = run.tables.parts("named").groupBy("id").agg(F.min("component").alias("component"))
        run.tables.save("components", named)
    return _edge_scores(run, normalized), run.tables


def betweenness(
    graph: Graph,
    normalized: bool = True,
    weight: str | None = None,
    endpoints: bool = False,
    limits: Limits | None = None,
    k: int | None = None,
    pivots: DataFrame | None = None,
    seed: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Vertex scores and edge scores from one traversal, exact or estimated as
    in :func:`node_betweenness`; edge scores are then sums over the sources
    times ``n / k``."""
    require_bool("normalized", normalized)
    require_bool("endpoints", endpoints)
    graph, pivots = _chosen(graph, k, pivots, seed)
    run = _Traversal(graph, pivots, weight, limits, folding=True)
    for batch in run.run(wanted=(run.node_sums(endpoints), "edge_sums")):
        run.collect_nodes(endpoints, batch)
        run.keep_sums("edge_sums", deps.edge_sums(run.field), batch)
    if pivots is None:
        return _node_scores(run, normalized, None, endpoints), _edge_scores(run, normalized)
    edges = _edge_scores(run, normalized).withColumn("centrality", F.col("centrality") * (run.graph.n / max(1, run.count)))
    return _node_scores(run, normalized, run.count, endpoints), edges


def shortest_paths(
    graph: Graph,
    sources: DataFrame,
    weight: str | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """``source, node, dist, sigma`` for every vertex reached from a source:
    the length of the shortest paths there and their number."""
    run = _Traversal(graph, sources, weight, limits)
    for batch in run.run(backward=False):
        run.collect_into("found", run.named(run.paths(), "source", "node").select("source", "node", "dist", "sigma"), batch)
    return run.tables.parts("found").drop("part")


def predecessors(
    graph: Graph,
    sources: DataFrame,
    weight: str | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """``source, node, pred``: each vertex that comes right before ``node`` on
    some shortest path from ``source``."""
    run = _Traversal(graph, sources, weight, limits)
    for batch in run.run(backward=False):
        steps = deps.tight_steps(run.field)
        steps = steps.select("source", F.col("w").alias("node"), F.col("u").alias("pred"))
        run.collect_into("found", run.named(steps, "source", "node", "pred").select("source", "node", "pred"), batch)
    return run.tables.parts("found").drop("part")


def source_dependencies(
    graph: Graph,
    sources: DataFrame,
    weight: str | None = None,
    endpoints: bool = False,
    limits: Limits | None = None,
) -> DataFrame:
    """``source, node, delta``: how much each source depends on each vertex it
    reaches, unscaled."""
    require_bool("endpoints", endpoints)
    run = _Traversal(graph, sources, weight, limits)
    for batch in run.run():
        found = run.named(deps.vertex_dependencies(run.field, endpoints), "source", "node")
        run.collect_into("found", found.select("source", "node", "delta"), batch)
    return run.tables.parts("found").drop("part")


def node_betweenness_centrality(graph: Graph, k=None, normalized=True, weight=None, endpoints=False, seed=None):
    return node_betweenness(graph, k=k, normalized=normalized, weight=weight, endpoints=endpoints, seed=seed)


def edge_betweenness_centrality(graph: Graph, normalized=True, weight=None):
    return edge_betweenness(graph, normalized=normalized, weight=weight)


# Older names of the two calls.
betweenness_centrality = node_betweenness_centrality
