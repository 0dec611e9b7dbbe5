import pytest
from known import TEN
from pyspark.sql import functions as F

import geodesis as g
from geodesis.graph import Graph, arcs
from geodesis.operators.field import Field, Limits
from geodesis.sources import tables
from geodesis.workspace import Workspace


def pairs(frame):
    return {tuple(row) for row in frame.collect()}


def test_parallel_and_reversed_edges_collapse(spark):
    rows = spark.createDataFrame(
        [(1, 2, 3.0), (2, 1, 2.0), (1, 2, None), (3, 3, 1.0)], "src long, dst long, weight double"
    )
    assert pairs(g.Graph.from_edges(rows).edges) == {(1, 2, 1.0), (3, 3, 1.0)}
    assert pairs(g.Graph.from_edges(rows, directed=True).edges) == {(1, 2, 1.0), (2, 1, 2.0), (3, 3, 1.0)}
    with pytest.raises(ValueError):
        g.Graph.from_edges(rows, duplicates="error")
    same = rows.filter("src = 3").unionByName(rows.filter("src = 3"))
    assert g.Graph.from_edges(same, duplicates="error").edges.count() == 1


def test_vertices_are_declared_ones_and_endpoints(spark):
    rows = spark.createDataFrame([(1, 2)], "src long, dst long")
    graph = g.Graph.from_edges(rows, spark.createDataFrame([(7,), (2,)], "id long"))
    assert [row.id for row in g.sorted_vertices(graph).collect()] == [1, 2, 7]
    assert graph.n == 3


def test_edge_without_an_end_is_refused(spark):
    rows = spark.createDataFrame([(1, None)], "src long, dst long")
    with pytest.raises(Exception, match="edge without dst"):
        g.Graph.from_edges(rows).edges.collect()


def test_adjacency_blocks_hold_all_neighbours(spark):
    edges = spark.range(1, 101).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    graph = g.Graph.from_edges(edges, spark.createDataFrame([(500,)], "id long"))
    rows = g.adjacency(graph, block_size=10).collect()
    hub = [row for row in rows if row.id == 0]
    assert len(hub) > 5
    assert max(len(row.neighbours) for row in hub) < 40
    assert sorted(n for row in hub for n in row.neighbours) == list(range(1, 101))
    assert all(row.neighbours == sorted(row.neighbours) for row in rows)
    assert [row.neighbours for row in rows if row.id == 500] == [[]]
    assert [row.neighbours for row in rows if row.id == 1] == [[0]]


def test_neighbours_of_a_frontier(spark):
    graph = g.Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3), (4, 2)], "src long, dst long"))
    frontier = spark.createDataFrame([(2,), (4,)], "id long")
    assert pairs(g.neighbours(graph, frontier)) == {(2, 1), (2, 3), (2, 4), (4, 2)}


def write(tmp_path, text):
    path = tmp_path / "graph.txt"
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def test_edge_list(spark, tmp_path):
    graph = g.read_edge_list(spark, write(tmp_path, "1 2\r\n2   3\r\n 3\t1"))
    assert pairs(graph.edges) == {(1, 2), (2, 3), (1, 3)}
    assert pairs(g.read_graph(spark, write(tmp_path, "2 1\n"), adjacency=False, directed=True).edges) == {(2, 1)}


@pytest.mark.parametrize("line", ["1", "1 2 3", "a b", "", "# note", "1.5 2"])
def test_malformed_edge_lines(spark, tmp_path, line):
    path = write(tmp_path, f"1 2\n{line}\n2 3\n")
    with pytest.raises(Exception, match="malformed line"):
        g.read_edge_list(spark, path).edges.collect()
    assert pairs(g.read_edge_list(spark, path, mode="drop").edges) == {(1, 2), (2, 3)}


def test_adjacency_list(spark, tmp_path):
    graph = g.read_adjacency_list(spark, write(tmp_path, "\r\n".join([*TEN, "77"])))
    assert graph.n == 11
    assert graph.edges.count() == 12
    path = write(tmp_path, "1 2\n\n3 x\n")
    with pytest.raises(Exception, match="malformed line"):
        g.read_adjacency_list(spark, path).edges.collect()
    assert pairs(g.read_adjacency_list(spark, path, mode="drop").vertices) == {(1,), (2,)}


def test_scores_as_sorted_text(spark, tmp_path):
    nodes = spark.createDataFrame([(10, 0.5), (2, 0.0)], "id long, centrality double")
    edges = spark.createDataFrame([(2, 10, 1.0), (1, 3, 0.25)], "src long, dst long, centrality double")
    g.write_node_scores(nodes, str(tmp_path / "n"), "text")
    g.write_edge_scores(edges, str(tmp_path / "e"), "text")
    assert [row.value for row in spark.read.text(str(tmp_path / "n")).collect()] == ["2: 0.0", "10: 0.5"]
    assert [row.value for row in spark.read.text(str(tmp_path / "e")).collect()] == ["(1, 3): 0.25", "(2, 10): 1.0"]
    with pytest.raises(ValueError):
        g.write_node_scores(nodes, str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("most", [500_000, 0])
def test_a_hub_with_a_third_of_all_edges_is_split(spark, monkeypatch, most):
    from geodesis import graph as relations

    monkeypatch.setattr(relations, "BROADCAST_HUBS", most)
    rows = [(0, n) for n in range(1, 301)] + [(n, n + 1) for n in range(1, 600)]
    graph = g.Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    expected = {(u, w) for u, w in rows} | {(w, u) for u, w in rows}
    frontier = spark.createDataFrame([(0,), (7,)], "id long")
    found = g.neighbours(graph, frontier, block_size=20)
    assert pairs(found) == {pair for pair in expected if pair[0] in (0, 7)}
    listed = g.adjacency(graph, block_size=20)
    blocks = listed.collect()
    assert {(row.id, n) for row in blocks for n in row.neighbours} == expected
    assert max(len(row.neighbours) for row in blocks) < 60


def test_vertices_without_id_are_refused(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    with pytest.raises(Exception, match="vertex without id"):
        g.Graph.from_edges(edges, spark.createDataFrame([(None,)], "id long")).vertices.collect()


def test_lines_of_trade_are_dealt_out_once_for_the_join_and_once_as_edges(spark, tmp_path):
    lines = [(1, 7), (1, 7), (2, 7), (2, 8), (3, 9), (5, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 4), (2, 4), (3, 5), (4, 6), (3, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    made = tables.trade(spark, str(tmp_path)).edges
    # The orders are sent around here.
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, made.select("src", "dst").collect())) == [(8, 15), (8, 17), (10, 19)]


def test_steps_of_a_large_graph_are_laid_out_without_a_copy(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    for directed in (False, True):
        held = Workspace(spark)
        graph = Graph.from_edges(edges, directed=directed).stored(held)
        ground = Field(graph, held, None, Limits(broadcast_arcs=0), packed=True)
        assert not held.has("arcs") and not ground.small
        for steps in (ground._by_u, ground._by_w):
            assert sorted(map(tuple, steps.select("u", "w").collect())) == sorted(map(tuple, arcs(graph).collect()))
        ground.release()
