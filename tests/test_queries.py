"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("GEODESIS_TABLES", "/root/testdata/sf0.001")
# All queries run in the gate; these cover each source, sink and traversal.
CHOSEN = [
    "vertices_web",
    "vertex_counts",
    "edges_duty",
    "edges_trade",
    "edges_lanes",
    "edges_places",
    "steps_web",
    "neighbours_pages",
    "adjacency_relay",
    "edge_list_file",
    "adjacency_list_file",
    "both_score_files",
    "paths_trade_pivots",
    "predecessors_duty_weighted",
    "dependencies_duty_endpoints",
    "node_bc_relay_pivots",
    "edge_bc_lanes_weighted",
    "component_sizes_web",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    texts = entry.text_queries.queries().keys() | {"pipeline"} if entry.text_queries else set()
    assert entry.queries().keys() - texts == entry.oracle_sql().keys() - texts


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, database, name):
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    result = database.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, result)) == sorted(str(tuple(row)) for row in found.select(*columns).collect())


def test_sampled_graphs_are_derived_once(spark, monkeypatch):
    seen, sample = [], entry.g.sample_vertices
    monkeypatch.setattr(entry.g, "sample_vertices", lambda graph, *more: seen.append(graph.kept) or sample(graph, *more))

    def make(spark, folder):
        return entry.g.Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3), (2, 1)], "src long, dst long"))

    found = entry._paths(make)(spark, "")
    # The sample and the traversal read the tables of one derivation.
    assert seen == [True]
    assert sorted((row.source, row.node, row.dist) for row in found.collect()) == [(s, v, abs(s - v)) for s in (1, 2, 3) for v in (1, 2, 3)]
    entry._predecessors(make)(spark, "")
    assert seen == [True, True]
