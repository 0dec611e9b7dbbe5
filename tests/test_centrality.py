import random

import pytest
from known import (
    KARATE,
    KARATE_EDGES,
    KARATE_NODES,
    TEN_DIRECTED,
    TEN_ENDPOINTS,
    TEN_PIVOTS,
    TEN_RAW,
    TEN_WEIGHTED,
    TEN_WEIGHTED_EDGES,
    TREES,
    brute_force,
    ten_edges,
)
from pyspark.sql import functions as F

import geodesis as g

SHUFFLED = g.Limits(broadcast_arcs=0)
SALTED = g.Limits(broadcast_arcs=0, hub_steps=3)
BATCHED = g.Limits(state_rows=130)


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def nodes_of(scores):
    return {row.id: row.centrality for row in scores.collect()}


def edges_of(scores):
    return {(row.src, row.dst): row.centrality for row in scores.collect()}


def close(found, expected):
    assert found.keys() == expected.keys()
    assert found == pytest.approx({key: float(value) for key, value in expected.items()}, abs=1e-9)


@pytest.fixture(scope="module")
def ten(spark):
    rows = frame(spark, ten_edges()).withColumn("weight", 1 + (F.col("src") + F.col("dst")) % 3)
    return g.Graph.from_edges(rows)


def test_karate(spark):
    nodes, edges = g.betweenness(g.Graph.from_edges(frame(spark, KARATE)))
    close(nodes_of(nodes), KARATE_NODES)
    found = edges_of(edges)
    assert len(found) == 78
    close({key: found[key] for key in KARATE_EDGES}, KARATE_EDGES)
    exact = brute_force(range(1, 35), dict.fromkeys(KARATE, 1), False)[1]
    close(found, {key: value / (34 * 33) for key, value in exact.items()})


def test_karate_read_as_directed(spark):
    raw = nodes_of(g.node_betweenness(g.Graph.from_edges(frame(spark, KARATE), directed=True), normalized=False))
    assert sum(raw.values()) == pytest.approx(29)
    assert max(raw, key=raw.get) == 3
    assert raw[3] == pytest.approx(53 / 6)


def test_unnormalized(ten):
    close(nodes_of(g.node_betweenness(ten, normalized=False)), dict(enumerate(TEN_RAW)))


def test_endpoints(ten):
    close(nodes_of(g.node_betweenness(ten, endpoints=True)), dict(enumerate(TEN_ENDPOINTS)))


def test_directed(spark):
    graph = g.Graph.from_edges(frame(spark, ten_edges()), directed=True)
    close(nodes_of(g.node_betweenness(graph)), dict(enumerate(TEN_DIRECTED)))


def test_weighted(ten):
    nodes, edges = g.betweenness(ten, weight="weight")
    close(nodes_of(nodes), dict(enumerate(TEN_WEIGHTED)))
    close(edges_of(edges), TEN_WEIGHTED_EDGES)


def test_given_pivots(spark, ten):
    pivots = spark.createDataFrame([(0,), (3,), (7,), (3,)], "id long")
    close(nodes_of(g.node_betweenness(ten, pivots=pivots)), dict(enumerate(TEN_PIVOTS)))
    with pytest.raises(ValueError):
        g.node_betweenness(ten, pivots=spark.createDataFrame([(77,)], "id long"))


def test_all_vertices_as_sample_is_exact(ten):
    close(nodes_of(g.node_betweenness(ten, k=10, seed=1, normalized=False)), dict(enumerate(TEN_RAW)))


def test_sample_is_exact_in_size_and_repeatable(ten):
    first = {row.id for row in g.sample_vertices(ten, 4, 5).collect()}
    again = g.Graph(ten.vertices.repartition(7), ten.edges)
    assert len(first) == 4
    assert first == {row.id for row in g.sample_vertices(again, 4, 5).collect()}
    for k in (0, 11):
        with pytest.raises(ValueError):
            g.node_betweenness(ten, k=k)
    with pytest.raises(TypeError):
        g.node_betweenness(ten, k=2.0)


def test_directed_raw_sample_is_not_corrected(spark):
    graph = g.Graph.from_edges(frame(spark, [(0, 1), (1, 2)]), directed=True)
    pivots = spark.createDataFrame([(0,)], "id long")
    close(nodes_of(g.node_betweenness(graph, pivots=pivots, normalized=False)), {0: 0, 1: 1, 2: 0})


def test_trees_in_one_forest(spark):
    rows, expected = [], {}
    for number, tree in enumerate(TREES):
        size = len(tree) + 1
        for (u, w), score in tree.items():
            pair = (10 * number + u, 10 * number + w)
            rows.append(pair)
            expected[pair] = score * size * (size - 1) / 2
    found = edges_of(g.edge_betweenness(g.Graph.from_edges(frame(spark, rows)), normalized=False))
    close(found, expected)


def test_path_with_endpoints_exceeds_one(spark):
    graph = g.Graph.from_edges(frame(spark, [(0, 1), (1, 2)]))
    close(nodes_of(g.node_betweenness(graph, endpoints=True)), {0: 2, 1: 3, 2: 2})


def test_empty_graph(spark):
    nodes, edges = g.betweenness(g.Graph.from_edges(frame(spark, [])))
    assert nodes.count() == 0 and edges.count() == 0


def test_tiny_and_lonely(spark):
    lonely = spark.createDataFrame([(5,)], "id long")
    graph = g.Graph.from_edges(frame(spark, [(3, 3)]), lonely)
    nodes, edges = g.betweenness(graph, endpoints=True)
    close(nodes_of(nodes), {3: 0, 5: 0})
    close(edges_of(edges), {(3, 3): 0})


def test_flags_must_be_bool(ten):
    with pytest.raises(TypeError):
        g.node_betweenness(ten, normalized=1)
    with pytest.raises(TypeError):
        g.edge_betweenness(ten, normalized="yes")


@pytest.mark.parametrize("bad", [0.0, -1.0, float("nan"), float("inf")])
def test_unusable_weights(spark, bad):
    rows = spark.createDataFrame([(0, 1, bad)], "src long, dst long, weight double")
    with pytest.raises(ValueError):
        g.node_betweenness(g.Graph.from_edges(rows), weight="weight")


def test_vanishing_weight(spark):
    rows = spark.createDataFrame([(0, 1, 1e18), (1, 2, 1.0)], "src long, dst long, weight double")
    with pytest.raises(ValueError):
        graph = g.Graph.from_edges(rows)
        g.shortest_paths(graph, graph.vertices, weight="weight")


@pytest.mark.parametrize("limits", [None, g.Limits(broadcast_bytes=1)])
def test_string_ids_and_missing_weights(spark, limits):
    rows = spark.createDataFrame([("b", "a", None), ("b", "c", 1.0), ("a", "c", 2.0)], "src string, dst string, km double")
    graph = g.Graph.from_edges(rows)
    found = g.shortest_paths(graph, graph.vertices, weight="km", limits=limits)
    got = {(row.source, row.node): (row.dist, row.sigma) for row in found.collect()}
    assert got["a", "c"] == (2.0, 2.0)
    assert got["a", "b"] == (1.0, 1.0)
    assert got["c", "c"] == (0.0, 1.0)


def mixed_graph(seed, directed):
    """Two components, a hub, a self-loop, a lonely vertex, ties by weight."""
    pick = random.Random(seed)
    vertices = list(range(16))
    weights = {(0, other): pick.choice([1, 2, 0.5]) for other in range(1, 9)}
    while len(weights) < 18:
        u, w = sorted(pick.sample(range(1, 11), 2))
        weights[(w, u) if directed and pick.random() < 0.5 else (u, w)] = pick.choice([1, 1.5, 2, 3])
    weights |= {(11, 12): 1, (12, 13): 2, (11, 13): 3, (13, 14): 0.25, (14, 14): 1}
    if directed:
        weights |= {(13, 11): 1, (5, 0): 2}
    return vertices, weights


@pytest.mark.parametrize(
    "directed, weighted, limits",
    [
        (False, False, None),
        (True, False, None),
        (True, True, None),
        (False, True, SALTED),
        (True, True, SALTED),
        (True, False, SALTED),
        (False, False, SALTED),
        (False, False, SHUFFLED),
        (True, False, BATCHED),
        (False, True, BATCHED),
    ],
)
def test_against_sums_over_pairs(spark, directed, weighted, limits):
    vertices, weights = mixed_graph(3 + directed, directed)
    lengths = weights if weighted else dict.fromkeys(weights, 1)
    rows = [(u, w, float(length)) for (u, w), length in weights.items()]
    graph = g.Graph.from_edges(
        spark.createDataFrame(rows, "src long, dst long, weight double"),
        spark.createDataFrame([(v,) for v in vertices], "id long"),
        directed,
    )
    nodes, edges = g.betweenness(graph, normalized=False, weight="weight" if weighted else None, limits=limits)
    exact_nodes, exact_edges = brute_force(vertices, lengths, directed)
    half = 1 if directed else 2
    close(nodes_of(nodes), {key: value / half for key, value in exact_nodes.items()})
    close(edges_of(edges), {key: value / half for key, value in exact_edges.items()})


def test_estimates_of_both_scores_from_one_traversal(ten):
    nodes, edges = g.betweenness(ten, normalized=False, k=10, seed=1)
    close(nodes_of(nodes), dict(enumerate(TEN_RAW)))
    close(edges_of(edges), edges_of(g.edge_betweenness(ten, normalized=False)))


def test_predecessors_need_no_way_back(spark, ten, monkeypatch):
    from geodesis.operators import dependencies

    def forbidden(*_):
        raise AssertionError("a backward pass")

    monkeypatch.setattr(dependencies, "gather_hops", forbidden)
    monkeypatch.setattr(dependencies, "gather_weighted", forbidden)
    source = spark.createDataFrame([(0,)], "id long")
    for weight in (None, "weight"):
        found = {(row.node, row.pred) for row in g.predecessors(ten, source, weight=weight).collect()}
        assert (8, 0) in found and (2, 8) in found and (8, 9) not in found


def test_tables_can_be_released(spark, ten):
    from geodesis import workspace

    scores = g.node_betweenness(ten)
    assert scores.count() == 10 and workspace._roots
    root = workspace._roots[-1]
    g.release_tables(spark)
    assert not workspace._roots and not workspace.Workspace(spark)._exists(root)


def with_trees(seed):
    """A core with cycles, trees and chains hanging on it, a tree alone, a pair,
    and a lonely vertex; ids are mixed up."""
    pick = random.Random(seed)
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3), (3, 4), (4, 5), (5, 3)]
    size = 6
    for _ in range(14):
        edges.append((pick.randrange(size), size))
        size += 1
    edges += [(size, size + 1), (size + 1, size + 2), (size + 1, size + 3), (size + 3, size + 4), (size + 5, size + 6)]
    size += 8
    names = pick.sample(range(100), size)
    return names, {tuple(sorted((names[a], names[b]))): pick.choice([1, 2, 0.5]) for a, b in edges} | {(names[7], names[7]): 1}


@pytest.mark.parametrize("weighted, limits", [(False, None), (True, None), (False, SHUFFLED), (False, BATCHED), (True, SALTED)])
def test_folding_agrees_with_sums_over_pairs(spark, weighted, limits):
    from dataclasses import replace

    vertices, weights = with_trees(8)
    lengths = weights if weighted else dict.fromkeys(weights, 1)
    graph = g.Graph.from_edges(
        spark.createDataFrame([(a, b, float(x)) for (a, b), x in weights.items()], "src long, dst long, weight double"),
        spark.createDataFrame([(v,) for v in vertices], "id long"),
    )
    exact_nodes, exact_edges = brute_force(vertices, lengths, False)
    for rounds in (8, 1) if limits is None else (8,):
        used = replace(limits or g.Limits(), fold_rounds=rounds)
        nodes, edges = g.betweenness(graph, normalized=False, weight="weight" if weighted else None, limits=used)
        close(nodes_of(nodes), {key: value / 2 for key, value in exact_nodes.items()})
        close(edges_of(edges), {key: value / 2 for key, value in exact_edges.items()})
    plain = replace(limits or g.Limits(), fold_rounds=0)
    ends = [g.node_betweenness(graph, endpoints=True, limits=x, weight="weight" if weighted else None) for x in (limits, plain)]
    close(nodes_of(ends[0]), nodes_of(ends[1]))


def test_a_forest_is_not_traversed(spark, monkeypatch):
    from geodesis.plans import centrality

    walked = []
    walk = centrality.walk_hops
    monkeypatch.setattr(centrality, "walk_hops", lambda field, sources: walked.append((field.size, sources.count())) or walk(field, sources))
    rows = [(k, (k - 1) // 3) for k in range(1, 60)] + [(k, 100) for k in range(101, 110)]
    graph = g.Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    found = nodes_of(g.node_betweenness(graph, normalized=False))
    # A vertex of each of the two trees is left, and no step.
    assert walked == [(0, 2)]
    close(found, nodes_of(g.node_betweenness(graph, normalized=False, limits=g.Limits(fold_rounds=0))))
    assert walked[1] == (2 * len(rows), 70)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("hub_steps", [1_000_000, 2])
def test_rounds_of_a_large_graph_do_not_move_the_steps(spark, directed, hub_steps):
    from geodesis.operators.field import Field
    from geodesis.workspace import Workspace, session_conf

    rows = [(0, k) for k in range(1, 12)] + [(k, k + 1) for k in range(1, 11)]
    tables = Workspace(spark)
    graph = g.Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"), directed=directed).stored(tables)
    field = Field(graph, tables, None, g.Limits(broadcast_arcs=0, hub_steps=hub_steps, broadcast_hubs=100))
    front = spark.range(12).selectExpr("id AS source", "id AS u").repartition(5, "source")
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        for walked in (field.leaving(front), field.entering(front.withColumnRenamed("u", "w"))):
            plan = walked._jdf.queryExecution().executedPlan().toString()
            scan = plan[plan.index("SortMergeJoin") :]
            # One exchange deals out the rows at hand by vertex; the steps are read as they lie.
            assert "Bucketed: true" in scan and scan.count("Exchange hashpartitioning") == 2 - ("REPARTITION_BY_NUM" not in scan)
            assert walked.count() == field.size
    assert len(field._held) == 1 + directed
    names = list(field._held)
    field.release()
    assert not any(spark.catalog.tableExists(name) for name in names)


def test_a_named_run_goes_on_after_its_finished_batches(spark, ten, monkeypatch):
    import uuid
    from dataclasses import replace

    from geodesis.plans import centrality

    named = replace(BATCHED, state_rows=30, fold_rounds=0, run=uuid.uuid4().hex)
    walked, walk, sums = [], centrality.walk_hops, centrality.deps.node_sums

    def failing(field, endpoints):
        if len(walked) == 3:
            raise RuntimeError("the driver is lost")
        return sums(field, endpoints)

    monkeypatch.setattr(centrality, "walk_hops", lambda *a: walked.append(1) or walk(*a))
    monkeypatch.setattr(centrality.deps, "node_sums", failing)
    with pytest.raises(RuntimeError):
        g.node_betweenness(ten, normalized=False, limits=named)
    assert len(walked) == 3
    monkeypatch.setattr(centrality.deps, "node_sums", sums)
    found = g.node_betweenness(ten, normalized=False, limits=named)
    assert len(walked) == 3 + 4 - 2
    close(nodes_of(found), dict(enumerate(TEN_RAW)))
    # Once it is done, nothing is walked again; edges are sums of their own.
    close(nodes_of(g.node_betweenness(ten, normalized=False, limits=named)), dict(enumerate(TEN_RAW)))
    assert len(walked) == 5
    close(edges_of(g.edge_betweenness(ten, limits=named)), edges_of(g.edge_betweenness(ten)))
    other = g.Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    with pytest.raises(ValueError):
        g.node_betweenness(other, limits=named)


def pages_and_targets(name=lambda k: k):
    """Many vertices that only hang on a few common ones."""
    rows = [(name(k), name(100 + k % 3)) for k in range(40)] + [(name(k), name(100 + (k + 1) % 3)) for k in range(0, 40, 4)]
    return rows + [(name(100), name(101))]


@pytest.mark.parametrize("limits", [None, SHUFFLED, SALTED, g.Limits(broadcast_arcs=0, broadcast_hubs=0, hub_steps=5, least_steps_per_task=5)])
def test_sources_of_a_pack_share_their_rows(spark, limits):
    from dataclasses import replace

    from geodesis.operators.hops import PATHS
    from geodesis.plans import centrality

    graph = g.Graph.from_edges(frame(spark, pages_and_targets()))
    used = replace(limits or g.Limits(), fold_rounds=0)
    run = centrality._Traversal(graph, None, None, used)
    for _ in run.run(backward=False):
        rows = run.tables.rows(PATHS)
    # Not a row for each source.
    assert run.field.lanes == (16 if limits else 2) and rows <= graph.n * graph.n / run.field.lanes * 5
    exact = brute_force(range(103), dict.fromkeys(((min(e), max(e)) for e in pages_and_targets()), 1), False)
    nodes, edges = g.betweenness(graph, normalized=False, limits=used)
    close(nodes_of(nodes), {row.id: exact[0][row.id] / 2 for row in graph.vertices.collect()})
    close(edges_of(edges), {key: value / 2 for key, value in exact[1].items()})
    ends = nodes_of(g.node_betweenness(graph, normalized=False, endpoints=True, limits=used))
    close(ends, {key: exact[0][key] / 2 + graph.n - 1 for key in ends})


def test_rows_of_a_common_vertex_are_summed_before_they_move(spark):
    from geodesis.operators.field import Field
    from geodesis.workspace import Workspace

    tables = Workspace(spark)
    graph = g.Graph.from_edges(frame(spark, pages_and_targets())).stored(tables)
    limits = g.Limits(broadcast_arcs=0, hub_steps=5, least_steps_per_task=100)
    field = Field(graph, tables, None, limits, sources=graph.n, packed=True)
    steps = field._by_u.select("place", "u", "w").collect()
    home = {}
    for row in steps:
        if row.u < 100:
            home.setdefault(row.u, set()).add(row.place)
    assert len(home) == 40 and all(len(places) == 1 for places in home.values())
    # What a common vertex sends lies with the one that gets it.
    assert all(home[row.w] == {row.place} for row in steps if row.u >= 100 and row.w < 100)
    assert field.places > 2 and len({row.place for row in steps}) > 1
    field.release()


def test_texts_are_numbered_and_never_broadcast_by_file_size(spark):
    from geodesis.plans import centrality

    name = lambda k: f"https://host-{k}.example/{'x' * 200}"
    graph = g.Graph.from_edges(spark.createDataFrame(pages_and_targets(name), "src string, dst string"))
    for limits in (None, SHUFFLED):
        run = centrality._Traversal(graph, None, None, limits)
        assert run.tables.load("arcs").schema["u"].dataType.simpleString() == "bigint"
        with run.field.planning():
            assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
        run.field.release()
    plain = g.Graph.from_edges(frame(spark, pages_and_targets()))
    nodes, edges = g.betweenness(graph, limits=SHUFFLED)
    exact_nodes, exact_edges = g.betweenness(plain)
    close(nodes_of(nodes), {name(key): value for key, value in nodes_of(exact_nodes).items()})
    expected = {tuple(sorted(map(name, key))): value for key, value in edges_of(exact_edges).items()}
    close(edges_of(edges), expected)


@pytest.mark.parametrize("limits", [None, SHUFFLED, SALTED])
def test_weighted_distances_of_a_pack_share_their_rows(spark, limits):
    from geodesis.operators import weighted
    from geodesis.plans import centrality

    vertices, weights = mixed_graph(5, True)
    edges = [(u, w, float(length)) for (u, w), length in weights.items()]
    graph = g.Graph.from_edges(
        spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(v,) for v in vertices], "id long"), True
    )
    run = centrality._Traversal(graph, None, "weight", limits)
    weighted._relax(run.field, run.sources)
    distances = run.tables.load(weighted.DISTANCES)
    # Not a row for each source.
    assert distances.count() <= graph.n * -(-graph.n // run.field.lanes)
    assert run.field.lanes > 1 or limits is None
    weighted._tighten(run.field)
    found = {(row.source, row.u, row.w) for row in run.tables.load(weighted.TIGHT).collect()}
    run.field.release()
    length = {(s, s): 0.0 for s in vertices}
    for _ in vertices:
        for s in vertices:
            for u, w, step in edges:
                if (s, u) in length and u != w:
                    length[s, w] = min(length.get((s, w), float("inf")), length[s, u] + step)
    assert found == {(s, u, w) for s in vertices for u, w, step in edges if u != w and (s, u) in length and length[s, u] + step == length[s, w]}


def test_lanes_are_expanded_in_compiled_code(spark):
    from geodesis.operators.hops import PATHS, each_source, lanes
    from geodesis.plans import centrality

    graph = g.Graph.from_edges(frame(spark, pages_and_targets()))
    run = centrality._Traversal(graph, None, None, SHUFFLED)
    for _ in run.run(backward=False):
        rows = each_source(run.field, run.tables.parts(PATHS), [F.col(s) > 0 for s in lanes(run.field, "s")], sigma="s")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "Generate" in plan


def rings(number, size=6):
    """Rings with a chord, none of which leads to another, and vertices alone."""
    edges = []
    for ring in range(number):
        at = [ring * 10 + k for k in range(size)]
        edges += [(u, w, float(1 + (u * w) % 3)) for u, w in zip(at, at[1:] + at[:1])] + [(at[0], at[3], 2.0)]
    return edges, [10 * ring + k for ring in range(number) for k in range(size)] + [1_000 + k for k in range(40)]


@pytest.mark.parametrize(("directed", "weight", "arcs"), [(True, None, 2_000_000), (False, None, 30), (True, None, 0), (True, "weight", 30)])
def test_pairs_without_a_path_make_no_batches(spark, monkeypatch, directed, weight, arcs):
    from geodesis.plans import centrality

    edges, vertices = rings(8)
    graph = g.Graph.from_edges(
        spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(v,) for v in vertices], "id long"), directed
    )
    fields, name = [], "walk_hops" if weight is None else "walk_weighted"
    walk = getattr(centrality, name)
    monkeypatch.setattr(centrality, name, lambda field, *a: fields.append(field) or walk(field, *a))
    limits = g.Limits(state_rows=4 * 36 * 4, broadcast_arcs=arcs, fold_rounds=0)
    nodes, ends = [nodes_of(g.node_betweenness(graph, normalized=False, weight=weight, endpoints=x, limits=limits)) for x in (False, True)]
    # All pairs of vertices would be 14 batches.
    batches = len(fields) / 2
    assert graph.n == 88 and batches < 14 and (arcs == 30 or batches <= 4)
    # A group of components whose steps may be broadcast is a small graph.
    assert all(field.small == bool(arcs) for field in fields) and all(field.vertices <= 48 for field in fields)
    found = edges_of(g.edge_betweenness(graph, normalized=False, weight=weight, limits=limits))
    lengths = {(u, w) if directed else (min(u, w), max(u, w)): length if weight else 1 for u, w, length in edges}
    exact = brute_force(vertices, lengths, directed)
    half = 1 if directed else 2
    close(nodes, {key: value / half for key, value in exact[0].items()})
    close(found, {key: value / half for key, value in exact[1].items()})
    close(ends, {key: exact[0][key] / half + (5 * 2 / half if key < 1_000 else 0) for key in ends})


def test_sources_of_a_component_share_packs(spark):
    from geodesis.operators.hops import PACKED
    from geodesis.plans import centrality

    edges = [(u * 50 + c, w * 50 + c) for c in range(40) for u, w in [(k, (k + 1) % 16) for k in range(16)]]
    graph = g.Graph.from_edges(frame(spark, edges), directed=True)
    run = centrality._Traversal(graph, None, None, g.Limits(state_rows=40 * 256, broadcast_arcs=0), folding=True)
    for _ in run.run(backward=False):
        packs = [(row.pack, row.source % 50) for row in run.tables.load(PACKED).collect()]
    assert len(packs) == graph.n and len(set(packs)) == 40
