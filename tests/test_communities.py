import random

import pytest
from known import KARATE, KARATE_REMOVALS
from pyspark.sql import functions as F

import geodesis as g


def test_components_of_path_star_and_lonely(spark):
    rows = [(n, n + 1) for n in range(10, 18)] + [(30, n) for n in range(20, 30)]
    graph = g.Graph.from_edges(
        spark.createDataFrame(rows, "src long, dst long"), spark.createDataFrame([(99,)], "id long")
    )
    for limits in (None, g.Limits(broadcast_arcs=0, hub_steps=3)):
        found = {row.id: row.component for row in g.connected_components(graph, limits).collect()}
        expected = {n: 10 for n in range(10, 19)} | {n: 20 for n in range(20, 31)} | {99: 99}
        assert found == expected
    sizes = g.component_sizes(graph, g.connected_components(graph), larger_than=1)
    assert {tuple(row) for row in sizes.collect()} == {(10, 9, 8), (20, 11, 10)}


def test_direction_does_not_matter_for_components(spark):
    rows = spark.createDataFrame([("b", "a"), ("b", "c"), ("z", "y")], "src string, dst string")
    graph = g.Graph.from_edges(rows, directed=True)
    found = {row.id: row.component for row in g.connected_components(graph).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def check_karate(found, removals):
    assert (found[0].step, found[0].src, found[0].n_components) == (0, None, 1)
    assert [(row.src, row.dst) for row in found[1:]] == [(src, dst) for src, dst, _ in removals]
    for row, (_, _, score) in zip(found[1:], removals):
        assert row.score == pytest.approx(score, abs=1e-9)


def test_karate_first_removals(spark):
    graph = g.Graph.from_edges(spark.createDataFrame(KARATE, "src long, dst long"))
    done = g.remove_edges(graph, max_steps=2)
    check_karate(sorted(done.trace.collect()), KARATE_REMOVALS[:2])


def test_karate_falls_apart(spark):
    graph = g.Graph.from_edges(spark.createDataFrame(KARATE, "src long, dst long"))
    done = g.remove_edges(graph, target_components=2)
    trace = sorted(done.trace.collect())
    check_karate(trace, KARATE_REMOVALS)
    assert [row.n_components for row in trace[1:]] == [1] * 10 + [2]
    last = done.sizes.filter("step = 11").collect()
    assert {(row.n_nodes, row.n_edges) for row in last} == {(19, 39), (15, 28)}
    assert done.communities.groupBy("component").count().count() == 2


def test_stops_once_components_are_small(spark):
    rows = [(0, 1), (1, 2), (2, 3), (5, 6)]
    graph = g.Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    done = g.remove_edges(graph, min_component_size=2)
    assert [(row.src, row.dst) for row in sorted(done.trace.collect())[1:]] == [(1, 2)]
    with pytest.raises(ValueError):
        g.remove_edges(g.Graph(graph.vertices, graph.edges, directed=True))


def test_the_larger_of_two_tiny_scores_is_on_top(spark):
    kind = "src long, dst long, centrality double"
    for scale in (1.0, 1e-10, 1e-30):
        near = [(1, 2, 3 * scale), (3, 4, 4 * scale)]
        assert tuple(g.top_edge(spark.createDataFrame(near, kind)).first())[:2] == (3, 4)
        tied = [(3, 4, 4 * scale * (1 + 1e-13)), (1, 2, 4 * scale), (0, 9, scale)]
        assert tuple(g.top_edge(spark.createDataFrame(tied, kind)).first())[:2] == (1, 2)
    assert g.top_edge(spark.createDataFrame([], kind)).count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from geodesis.operators import merging
    from geodesis.workspace import Workspace

    rounds = []
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, name, *a, **b: rounds.append(name) or save(self, name, *a, **b))
    chain = spark.range(2000).selectExpr("(id * 7919) % 2001 AS src", "((id + 1) * 7919) % 2001 AS dst")
    found = merging.smallest_reachable(chain, Workspace(spark, "chain"))
    assert {row.component for row in found.select("component").distinct().collect()} == {0}
    assert found.count() == 2001
    assert len([name for name in rounds if name.endswith("_far")]) <= 15


def plain_scores(vertices, edges):
    """``edge -> score`` over ordered pairs, and ``vertex -> component``."""
    near = {v: set() for v in vertices}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    scores, names = {edge: 0.0 for edge in edges}, {}
    for source in vertices:
        dist, sigma, order = {source: 0}, {source: 1.0}, [source]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        names[source] = min(order)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    part = sigma[v] * (1 + share[w]) / sigma[w]
                    share[v] += part
                    scores[min(v, w), max(v, w)] += part
    n = len(vertices)
    return {edge: score / (n * (n - 1)) for edge, score in scores.items()}, names


def plain_removal(vertices, edges, largest):
    edges, trace, sizes = set(edges), [], {}
    while True:
        scores, names = plain_scores(vertices, edges)
        members = {name: [v for v in vertices if names[v] == name] for name in names.values()}
        inside = {name: sum(names[a] == name for a, _ in edges) for name in members}
        sizes |= {(len(trace), name): (len(of), inside[name]) for name, of in members.items() if len(of) > largest}
        if max(map(len, members.values())) <= largest:
            return trace, sizes, names
        most = max(scores.values())
        top = min(edge for edge, score in scores.items() if score >= most * (1 - 1e-9))
        edges.remove(top)
        trace.append((*top, scores[top], len(set(plain_scores(vertices, edges)[1].values()))))


# States kept from the start, only of parts that are small enough, and never.
@pytest.mark.parametrize("kept", [4_000_000, 70, 0])
def test_removal_of_a_graph_with_cycles_to_its_own_end(spark, kept):
    pick = random.Random(11)
    vertices = list(range(0, 36, 2))
    edges = {(a, b) for a in vertices for b in vertices if a < b and a // 13 == b // 13 and pick.random() < 0.6}
    edges |= {(4, 20), (10, 30), (24, 32), (8, 8)}
    isolated = [98, 99]
    trace, sizes, names = plain_removal(vertices + isolated, edges, 6)
    assert len(trace) >= 5 and len(set(names.values())) > 3
    graph = g.Graph.from_edges(
        spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(v,) for v in vertices + isolated], "id long")
    )
    done = g.remove_edges(graph, min_component_size=6, limits=g.Limits(kept_rows=kept))
    found = sorted(done.trace.collect())
    assert [row.step for row in found] == list(range(len(trace) + 1))
    assert [(row.src, row.dst, row.n_components) for row in found[1:]] == [(a, b, n) for a, b, _, n in trace]
    assert [row.score for row in found[1:]] == pytest.approx([score for *_, score, _ in trace], rel=1e-9)
    assert {(row.step, row.component): (row.n_nodes, row.n_edges) for row in done.sizes.collect()} == sizes
    assert {row.id: row.component for row in done.communities.collect()} == names


def test_only_sources_that_lose_a_path_are_traversed_again(spark, monkeypatch):
    from geodesis.operators import chained
    from geodesis.plans import communities

    asked, named = [], []
    walk, name = chained.traversed, communities._named
    monkeypatch.setattr(chained, "traversed", lambda sources, *a: asked.append(sources.count()) or walk(sources, *a))
    monkeypatch.setattr(communities, "_named", lambda *a: named.append(a[1]) or name(*a))
    # A ring of five with a tail: from the far side of the ring both ends of an edge are as near.
    ring = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (4, 5), (5, 6)]
    graph = g.Graph.from_edges(spark.createDataFrame(ring, "src long, dst long"))
    done = g.remove_edges(graph, min_component_size=4)
    trace = [(row.src, row.dst, row.n_components) for row in sorted(done.trace.collect())]
    expected = plain_removal(list(range(7)), ring, 4)[0]
    assert trace[1:] == [(a, b, n) for a, b, _, n in expected]
    assert asked[0] == 7 and asked[1] == (7 if trace[1][2] == 2 else 6)
    # Components are named at the start and where one falls apart, not otherwise.
    splits = [step for step in range(1, len(trace)) if trace[step][2] > trace[step - 1][2]]
    assert named == [0, *splits] and len(splits) < len(trace)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("width", [1, 3])
def test_chained_rounds_agree_with_rounds_of_their_own(spark, directed, width):
    from geodesis.graph import arcs
    from geodesis.operators import chained

    pick = random.Random(5)
    rows = sorted({(f"n{pick.randrange(25)}", f"n{pick.randrange(25)}") for _ in range(45)})
    graph = g.Graph.from_edges(spark.createDataFrame(rows, "src string, dst string"), directed=directed)
    sources = graph.vertices.select(F.col("id").alias("source"))
    steps = arcs(graph)
    forth, back = chained.step_lists(graph.vertices, steps), chained.step_lists(graph.vertices, steps.select(F.col("u").alias("w"), F.col("w").alias("u")))
    with chained.planning(spark, width):
        state = chained.traversed(sources, forth, back, 12, width)
        found = {(row.source, row.node): (row.dist, row.sigma, row.sigma * row.passed) for row in state.collect()}
        sums = {(row.src, row.dst): row.total for row in chained.edge_sums(state, back, directed, width).collect()}
    assert max(dist for dist, _, _ in found.values()) < 12
    asked = graph.vertices
    paths = {(row.source, row.node): (row.dist, row.sigma) for row in g.shortest_paths(graph, asked).collect()}
    assert {key: value[:2] for key, value in found.items()} == paths
    for row in g.source_dependencies(graph, asked).collect():
        assert found[row.source, row.node][2] == pytest.approx(row.delta, abs=1e-9)
    scale = 1.0 if directed else 0.5
    for row in g.edge_betweenness(graph, normalized=False).collect():
        assert sums.get((row.src, row.dst), 0.0) * scale == pytest.approx(row.centrality, abs=1e-9)
