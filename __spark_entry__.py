"""Registered queries on the given tables, and the SQL each must agree with.

The SQL never follows the library's way: distances and path counts come from a
recursive query, and a score is summed over pairs of ends,
``paths(s,v) * paths(v,t) / paths(s,t)``, instead of being passed backwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import geodesis as g
from geodesis.sources import tables
from geodesis.workspace import Workspace

try:
    import corpus_pipeline
    from geodesis.llm import queries as text_queries
except ImportError:
    corpus_pipeline = text_queries = None

# Raw sums are compared by decimals, scaled scores by digits whatever their size.
DECIMALS = 9
DIGITS = "%.6e"
SEED = 7
PIVOTS = 32
# Edges are removed until no component has more vertices. The SQL is written out
# for so many removals and gives nothing right if more are needed.
LARGEST = 8
WRITTEN_OUT = 60
# The layout of large graphs, with hubs from so few steps that the tables have some.
SHUFFLED = g.Limits(broadcast_arcs=0, hub_steps=50)


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    for name in names:
        frame = frame.withColumn(name, F.round(name, DECIMALS))
    return frame


def _significant(frame: DataFrame, *names: str) -> DataFrame:
    for name in names:
        shown = F.format_string(DIGITS, name).cast("double")
        frame = frame.withColumn(name, F.when(F.col(name).isNotNull(), shown))
    return frame


# -- queries ------------------------------------------------------------------


def _scores(make, **options):
    shown = _significant if options.get("normalized", True) or "k" in options else _rounded

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return shown(g.node_betweenness(make(spark, folder), **options), "centrality")

    return query


def _edge_scores(make, **options):
    shown = _significant if options.get("normalized", True) else _rounded

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return shown(g.edge_betweenness(make(spark, folder), **options), "centrality")

    return query


def _vertex_counts(spark: SparkSession, folder: str) -> DataFrame:
    made = [tables.web, tables.duty, tables.trade, tables.lanes, tables.relay, tables.places]
    frames = [
        make(spark, folder).vertices.agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("graph", F.lit(make.__name__))
        for make in made
    ]
    counts = frames[0]
    for frame in frames[1:]:
        counts = counts.unionByName(frame)
    return counts


def _page_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    frontier = tables.table(spark, folder, "pages").select(F.col("url").alias("id")).distinct()
    return g.neighbours(tables.web(spark, folder), frontier)


def _adjacency(spark: SparkSession, folder: str) -> DataFrame:
    listed = g.adjacency(tables.relay(spark, folder))
    return listed.select("id", "block", F.concat_ws(" ", F.col("neighbours").cast("array<string>")).alias("neighbours"))


def _edge_list_file(spark: SparkSession, folder: str) -> DataFrame:
    path = Workspace(spark, "text").path("edges")
    tables.trade(spark, folder).edges.select(F.concat_ws(" ", "src", "dst")).write.text(path)
    return g.read_edge_list(spark, path).edges


def _adjacency_list_file(spark: SparkSession, folder: str) -> DataFrame:
    path = Workspace(spark, "text").path("lists")
    listed = g.adjacency(tables.relay(spark, folder))
    line = F.concat_ws(" ", F.col("id").cast("string"), F.col("neighbours").cast("array<string>"))
    listed.select(line).write.text(path)
    graph = g.read_adjacency_list(spark, path, directed=True)
    alone = graph.vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))
    return graph.edges.select("src", "dst").unionByName(alone)


def _node_score_file(spark: SparkSession, folder: str) -> DataFrame:
    path = Workspace(spark, "scores").path("nodes")
    g.write_node_scores(g.node_betweenness(tables.duty(spark, folder)), path, "text")
    parts = F.split("value", ": ")
    lines = spark.read.text(path)
    return _significant(lines.select(parts[0].cast("long").alias("id"), parts[1].cast("double").alias("centrality")), "centrality")


def _edge_score_file(spark: SparkSession, folder: str) -> DataFrame:
    path = Workspace(spark, "scores").path("edges")
    g.write_edge_scores(g.edge_betweenness(tables.duty(spark, folder)), path, "csv")
    schema = "src long, dst long, centrality double"
    return _significant(spark.read.schema(schema).option("header", "true").csv(path), "centrality")


def _both_scores(spark: SparkSession, folder: str) -> DataFrame:
    path = Workspace(spark, "scores").path("both")
    g.write_betweenness(tables.web(spark, folder), path)
    nodes = spark.read.parquet(f"{path}/nodes").select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), "centrality")
    return _significant(nodes.unionByName(spark.read.parquet(f"{path}/edges")), "centrality")


def _pivots(spark: SparkSession, folder: str) -> DataFrame:
    return g.sample_vertices(tables.relay(spark, folder), PIVOTS, SEED)


def _stored(spark: SparkSession, folder: str, make) -> g.Graph:
    """The graph of the tables, derived once for its size, sample and traversal."""
    return make(spark, folder).stored(Workspace(spark, "sampled"))


def _sources(graph: g.Graph) -> DataFrame:
    """The pivots of a graph; all of its vertices if it has fewer."""
    return g.sample_vertices(graph, min(PIVOTS, graph.n), SEED)


def _paths(make, **options):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        graph = _stored(spark, folder, make)
        return g.shortest_paths(graph, _sources(graph), **options)

    return query


def _visit_order(spark: SparkSession, folder: str) -> DataFrame:
    found = _paths(tables.web)(spark, folder)
    return found.groupBy("source", "dist").agg(F.count(F.lit(1)).alias("n_nodes"))


def _predecessors(make, weight=None):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        graph = _stored(spark, folder, make)
        return g.predecessors(graph, _sources(graph), weight=weight)

    return query


def _dependencies(endpoints: bool, weight=None):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        graph = _stored(spark, folder, tables.duty)
        found = g.source_dependencies(graph, _sources(graph), endpoints=endpoints, weight=weight)
        return _rounded(found, "delta")

    return query


def _components(spark: SparkSession, folder: str) -> DataFrame:
    return g.connected_components(tables.web(spark, folder))


def _component_sizes(spark: SparkSession, folder: str) -> DataFrame:
    graph = tables.web(spark, folder)
    return g.component_sizes(graph, g.connected_components(graph))


def _top_edge(spark: SparkSession, folder: str) -> DataFrame:
    return _significant(g.top_edge(g.edge_betweenness(tables.web(spark, folder))), "centrality")


def _removal(part: str, **rounded):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        done = g.remove_edges(tables.ferries(spark, folder), min_component_size=LARGEST)
        return _significant(getattr(done, part), *rounded.get("names", ()))

    return query


def entry(spark: SparkSession) -> DataFrame:
    """Betweenness of every page and link target of the web graph."""
    return queries()["node_bc_web"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    web, duty, trade, lanes, relay, places, tolls = (
        tables.web,
        tables.duty,
        tables.trade,
        tables.lanes,
        tables.relay,
        tables.places,
        tables.tolls,
    )
    found = {
        # graph relations
        "vertices_web": lambda spark, folder: g.sorted_vertices(web(spark, folder)),
        "vertices_duty": lambda spark, folder: g.sorted_vertices(duty(spark, folder)),
        "vertex_counts": _vertex_counts,
        "edges_web": lambda spark, folder: g.sorted_edges(web(spark, folder)),
        "edges_duty": lambda spark, folder: g.sorted_edges(duty(spark, folder)),
        "edges_trade": lambda spark, folder: g.sorted_edges(trade(spark, folder)),
        "edges_lanes": lambda spark, folder: g.sorted_edges(lanes(spark, folder)),
        "edges_places": lambda spark, folder: g.sorted_edges(places(spark, folder)),
        "edges_tolls": lambda spark, folder: g.sorted_edges(tolls(spark, folder)),
        "edges_ferries": lambda spark, folder: g.sorted_edges(tables.ferries(spark, folder)),
        "steps_web": lambda spark, folder: g.arcs(web(spark, folder)),
        "steps_duty": lambda spark, folder: g.arcs(duty(spark, folder), "seconds"),
        "neighbours_pages": _page_neighbours,
        "adjacency_relay": _adjacency,
        # text sources and sinks
        "edge_list_file": _edge_list_file,
        "adjacency_list_file": _adjacency_list_file,
        "node_score_file": _node_score_file,
        "edge_score_file": _edge_score_file,
        "both_score_files": _both_scores,
        # shortest paths
        "paths_duty": _paths(duty),
        "paths_web": _paths(web),
        "paths_trade_pivots": _paths(trade),
        "paths_trade_pivots_shuffled": _paths(trade, limits=SHUFFLED),
        "paths_lanes_weighted": _paths(lanes, weight="price"),
        "paths_duty_weighted": _paths(duty, weight="seconds"),
        "paths_tolls_weighted": _paths(tolls, weight="price"),
        "visit_order_web": _visit_order,
        "predecessors_duty": _predecessors(duty),
        "predecessors_duty_weighted": _predecessors(duty, "seconds"),
        # dependencies
        "dependencies_duty": _dependencies(False),
        "dependencies_duty_endpoints": _dependencies(True),
        "dependencies_duty_weighted": _dependencies(False, "seconds"),
        # centrality
        "pivots_relay": _pivots,
        "node_bc_web": _scores(web),
        "node_bc_web_raw": _scores(web, normalized=False),
        "node_bc_web_endpoints": _scores(web, endpoints=True),
        "node_bc_duty": _scores(duty),
        "node_bc_duty_raw": _scores(duty, normalized=False),
        "node_bc_duty_endpoints": _scores(duty, endpoints=True),
        "node_bc_duty_weighted": _scores(duty, weight="seconds"),
        "node_bc_lanes_weighted": _scores(lanes, weight="price"),
        "node_bc_lanes_weighted_endpoints": _scores(lanes, weight="price", endpoints=True),
        "node_bc_tolls_weighted": _scores(tolls, weight="price"),
        "node_bc_duty_weighted_shuffled": _scores(duty, weight="seconds", limits=SHUFFLED),
        "node_bc_relay_pivots_raw": _scores(relay, k=PIVOTS, seed=SEED, normalized=False),
        "node_bc_relay_pivots_endpoints": _scores(relay, k=PIVOTS, seed=SEED, endpoints=True),
        "node_bc_trade_pivots_raw": _scores(trade, k=PIVOTS, seed=SEED, normalized=False),
        "node_bc_trade_pivots_shuffled": _scores(trade, k=PIVOTS, seed=SEED, limits=SHUFFLED),
        "node_bc_places": _scores(places),
        "node_bc_relay_pivots": _scores(relay, k=PIVOTS, seed=SEED),
        "node_bc_trade_pivots": _scores(trade, k=PIVOTS, seed=SEED),
        "edge_bc_web": _edge_scores(web),
        "edge_bc_web_shuffled": _edge_scores(web, limits=SHUFFLED),
        "edge_bc_tolls_weighted": _edge_scores(tolls, weight="price"),
        "edge_bc_duty": _edge_scores(duty),
        "edge_bc_duty_raw": _edge_scores(duty, normalized=False),
        "edge_bc_duty_weighted": _edge_scores(duty, weight="seconds"),
        "edge_bc_lanes_weighted": _edge_scores(lanes, weight="price"),
        # components and communities
        "components_web": _components,
        "component_sizes_web": _component_sizes,
        "top_edge_web": _top_edge,
        "edge_removal_trace": _removal("trace", names=("score",)),
        "edge_removal_sizes": _removal("sizes"),
        "edge_removal_communities": _removal("communities"),
    }
    if text_queries:
        found |= text_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


# -- SQL ----------------------------------------------------------------------

_ENDS = "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
_ONE_WAY = "arcs AS (SELECT src AS u, dst AS w{weight} FROM edges WHERE src <> dst)"
_BOTH_WAYS = (
    "arcs AS (SELECT src AS u, dst AS w FROM edges WHERE src <> dst"
    " UNION SELECT dst, src FROM edges WHERE src <> dst)"
)

_WEB = f"""
  links AS (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
  edges AS (SELECT DISTINCT least(url, target) AS src, greatest(url, target) AS dst FROM links),
  {_ENDS}, {_BOTH_WAYS}"""

_DUTY = f"""
  minutes AS (
    SELECT arg_min(user_id, (ts, event_id)) AS a, arg_max(user_id, (ts, event_id)) AS b,
           extract(second FROM max(ts)) - extract(second FROM min(ts)) + 1 AS seconds
    FROM events GROUP BY date_trunc('minute', ts)),
  edges AS (SELECT a AS src, b AS dst, CAST(min(seconds) AS DOUBLE) AS weight FROM minutes GROUP BY a, b),
  nodes AS (SELECT DISTINCT user_id AS id FROM events),
  {_ONE_WAY.format(weight=", weight")}"""

_TRADE = f"""
  edges AS (
    SELECT DISTINCT least(o_custkey * 2, l_suppkey * 2 + 1) AS src, greatest(o_custkey * 2, l_suppkey * 2 + 1) AS dst
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  {_ENDS}, {_BOTH_WAYS}"""

_LANES = f"""
  edges AS (
    SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst,
           CAST(ceil(min(l_extendedprice)) AS DOUBLE) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY s_nationkey, c_nationkey),
  nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation),
  {_ONE_WAY.format(weight=", weight")}"""

_TOLLS = f"""
  priced AS (
    SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b,
           min(l_extendedprice) AS price
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  edges AS (
    SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst,
           CASE WHEN (a + b) % 7 <> 0 THEN ceil(CAST(price AS DOUBLE) / 250) / 4 ELSE 1 END AS weight FROM priced),
  nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation),
  arcs AS (SELECT src AS u, dst AS w, weight FROM edges WHERE src <> dst
           UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst)"""

_FERRIES = f"""
  sold AS (
    SELECT s_nationkey AS a, arg_max(c_nationkey, (l_extendedprice, l_orderkey, l_linenumber)) AS b
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_returnflag),
  edges AS (SELECT DISTINCT CAST(least(a, b) AS BIGINT) AS src, CAST(greatest(a, b) AS BIGINT) AS dst FROM sold),
  nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)"""

_RELAY = f"""
  edges AS (
    SELECT DISTINCT arg_min(l_partkey, (l_linenumber, l_partkey)) AS src, arg_max(l_partkey, (l_linenumber, l_partkey)) AS dst
    FROM lineitem GROUP BY l_orderkey),
  nodes AS (SELECT p_partkey AS id FROM part),
  {_ONE_WAY.format(weight="")}"""

_PLACES = f"""
  pairs AS (
    SELECT CAST(n_regionkey AS BIGINT) * 4 AS a, CAST(n_nationkey AS BIGINT) * 4 + 1 AS b FROM nation
    UNION SELECT CAST(c_nationkey AS BIGINT) * 4 + 1, c_custkey * 4 + 2 FROM customer
    UNION SELECT CAST(s_nationkey AS BIGINT) * 4 + 1, s_suppkey * 4 + 3 FROM supplier),
  edges AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM pairs),
  nodes AS (
    SELECT src AS id FROM edges UNION SELECT dst FROM edges
    UNION SELECT CAST(r_regionkey AS BIGINT) * 4 FROM region),
  {_BOTH_WAYS}"""

# Distances d and path counts c from every vertex, one distance per recursion.
_HOPS = """
  reach(s, v, d, c) USING KEY (s, v) AS (
    SELECT id, id, 0, CAST(1 AS DOUBLE) FROM nodes
    UNION
    SELECT f.s, a.w, f.d + 1, sum(f.c)
    FROM reach f JOIN arcs a ON a.u = f.v
    LEFT JOIN recurring.reach r ON r.s = f.s AND r.v = a.w
    WHERE r.s IS NULL GROUP BY f.s, a.w, f.d)"""

# The same by weight: as many relaxations as there are vertices, then walks.
_LENGTHS = """
  stay AS (SELECT u, w, weight FROM arcs UNION ALL SELECT id, id, 0 FROM nodes),
  relaxed(k, s, v, d) AS (
    SELECT CAST(0 AS BIGINT), id, id, CAST(0 AS DOUBLE) FROM nodes
    UNION ALL
    SELECT k + 1, s, w, min(d + weight) FROM relaxed JOIN stay ON u = v
    WHERE k < (SELECT count(*) FROM nodes) GROUP BY k + 1, s, w),
  dist AS MATERIALIZED (SELECT s, v, d FROM relaxed WHERE k = (SELECT count(*) FROM nodes)),
  tight AS MATERIALIZED (
    SELECT x.s, a.u, a.w FROM dist x JOIN arcs a ON a.u = x.v
    JOIN dist y ON y.s = x.s AND y.v = a.w AND x.d + a.weight = y.d),
  walks(s, v, h, c) AS (
    SELECT id, id, 0, CAST(1 AS DOUBLE) FROM nodes
    UNION ALL
    SELECT f.s, t.w, f.h + 1, sum(f.c) FROM walks f JOIN tight t ON t.s = f.s AND t.u = f.v GROUP BY f.s, t.w, f.h),
  counted AS (SELECT s, v, sum(c) AS c FROM walks GROUP BY s, v),
  reach AS MATERIALIZED (SELECT s, v, d, c FROM dist JOIN counted USING (s, v))"""

_THROUGH = """
  through AS (
    SELECT a.s, a.v, sum(a.c * b.c / p.c) AS delta
    FROM reach a JOIN reach b ON b.s = a.v JOIN reach p ON p.s = a.s AND p.v = b.v
    WHERE a.d + b.d = p.d AND a.v <> a.s AND b.v <> a.v {only} GROUP BY a.s, a.v)"""

_ALONG = """
  along AS (
    SELECT {key}, sum(a.c * b.c / p.c) AS total
    FROM arcs e JOIN reach a ON a.v = e.u JOIN reach b ON b.s = e.w JOIN reach p ON p.s = a.s AND p.v = b.v
    WHERE a.d + {length} + b.d = p.d GROUP BY 1, 2)"""

# The same scores on larger graphs: every pair sends one unit from its far end
# back to its near end, split at each vertex by the paths that come from there.
_BACK = """
  FROM flow f JOIN reach h ON h.s = f.s AND h.v = f.v
  JOIN arcs e ON e.w = f.v JOIN reach t ON t.s = f.s AND t.v = e.u AND t.d + 1 = h.d"""
_FLOW = f"""
  flow(s, v, k, x) AS (
    SELECT s, v, 0, CAST(1 AS DOUBLE) FROM reach WHERE s <> v
    UNION ALL
    SELECT f.s, e.u, f.k + 1, sum(f.x * t.c / h.c) {_BACK} GROUP BY f.s, e.u, f.k),
  along AS (SELECT {{key}}, sum(f.x * t.c / h.c) AS total {_BACK} GROUP BY 1, 2)"""

_N = "(SELECT count(*) FROM nodes)"
_NODE_NORM = f"(({_N} - 1) * ({_N} - 2))"
_EDGE_NORM = f"({_N} * ({_N} - 1))"
_EITHER = "least(e.u, e.w) AS src, greatest(e.u, e.w) AS dst"
_DIRECTED = "e.u AS src, e.w AS dst"
_SAMPLE = f"pivots AS (SELECT id FROM nodes ORDER BY md5(concat_ws(':', '{SEED}', id)), id LIMIT {PIVOTS})"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(part.strip() for part in parts)


_SCALED, _RAW = f"CAST(printf('{DIGITS}', {{}}) AS DOUBLE)", f"round({{}}, {DECIMALS})"
_NODE_SHARE, _EDGE_SHARE = f"1.0 / {_NODE_NORM}", f"1.0 / {_EDGE_NORM}"
_PIVOT_SHARE = f"(1.0 / {_NODE_NORM} * {_N} / {PIVOTS})"
_FROM_PIVOTS = "AND a.s IN (SELECT id FROM pivots)"


def _node_sql(graph: str, walk: str = _HOPS, factor: str = _NODE_SHARE, shown: str = _SCALED, pivots: bool = False) -> str:
    parts = [graph, walk] + ([_SAMPLE] if pivots else []) + [_THROUGH.format(only=_FROM_PIVOTS if pivots else "")]
    score = shown.format(f"coalesce(total, 0) * {factor}")
    return (
        _with(*parts)
        + f""", summed AS (SELECT v, sum(delta) AS total FROM through GROUP BY v)
        SELECT id, {score} AS centrality FROM nodes LEFT JOIN summed ON v = id"""
    )


def _endpoint_sql(graph: str, walk: str = _HOPS, factor: str = _NODE_SHARE, pivots: bool = False) -> str:
    chosen = "AND s IN (SELECT id FROM pivots)" if pivots else ""
    parts = [graph, walk] + ([_SAMPLE] if pivots else []) + [_THROUGH.format(only=_FROM_PIVOTS if pivots else "")]
    score = _SCALED.format(f"coalesce(total, 0) * {factor}")
    return (
        _with(*parts)
        + f""", parts AS (
          SELECT v, delta FROM through
          UNION ALL SELECT v, 1 FROM reach WHERE s <> v {chosen}
          UNION ALL SELECT s, 1 FROM reach WHERE s <> v {chosen}),
        summed AS (SELECT v, sum(delta) AS total FROM parts GROUP BY v)
        SELECT id, {score} AS centrality FROM nodes LEFT JOIN summed ON v = id"""
    )


def _pivot_sql(graph: str) -> str:
    return _node_sql(graph, factor=_PIVOT_SHARE, pivots=True)


def _edge_sql(
    graph: str, key: str, walk: str = _HOPS, length: str = "1", factor: str = _EDGE_SHARE, shown: str = _SCALED
) -> str:
    score = shown.format(f"coalesce(total, 0) * {factor}")
    return (
        _with(graph, walk, _ALONG.format(key=key, length=length))
        + f"""
        SELECT e.src, e.dst, {score} AS centrality
        FROM edges e LEFT JOIN along a ON a.src = e.src AND a.dst = e.dst"""
    )


def _from_pivots(walk: str) -> str:
    """The walk from the pivots alone."""
    return walk.replace("DOUBLE) FROM nodes", "DOUBLE) FROM pivots")


def _paths_sql(graph: str, walk: str = _HOPS) -> str:
    return (
        _with(graph, _SAMPLE, _from_pivots(walk))
        + " SELECT s AS source, v AS node, CAST(d AS DOUBLE) AS dist, c AS sigma FROM reach"
    )


def _removal_steps() -> str:
    """One block per step: paths, components, scores, the top edge, and the graph
    without it. Once no component is too large there is no top edge, and nothing is
    left for the next steps to do."""
    blocks = [_FERRIES, "edges_0 AS (SELECT src, dst FROM edges)", "going_0 AS (SELECT 1 AS yes)"]
    for step in range(WRITTEN_OUT + 1):
        arcs = (
            f"arcs_{step} AS MATERIALIZED (SELECT src AS u, dst AS w FROM edges_{step} WHERE src <> dst"
            f" UNION SELECT dst, src FROM edges_{step} WHERE src <> dst)"
        )
        walked, along = _HOPS, _ALONG.format(key=_EITHER, length="1")
        for name in ("reach", "arcs", "along"):
            walked, along = (text.replace(name, f"{name}_{step}") for text in (walked, along))
        named = f"members_{step} AS MATERIALIZED (SELECT v AS id, min(s) AS component FROM reach_{step}, going_{step} GROUP BY v)"
        top = (
            f"top_{step} AS MATERIALIZED (SELECT src, dst, total / {_EDGE_NORM} AS score FROM along_{step}"
            f" WHERE total >= (SELECT max(total) FROM along_{step}) * (1 - 1e-9)"
            f" AND (SELECT max(n) FROM (SELECT count(*) AS n FROM members_{step} GROUP BY component)) > {LARGEST}"
            f" ORDER BY src, dst LIMIT 1)"
        )
        rest = (
            f"edges_{step + 1} AS MATERIALIZED (SELECT e.src, e.dst FROM edges_{step} e, top_{step} t"
            f" WHERE e.src <> t.src OR e.dst <> t.dst)"
        )
        blocks += [arcs, walked, named, along.replace(" AS (", " AS MATERIALIZED ("), top, rest]
        blocks.append(f"going_{step + 1} AS MATERIALIZED (SELECT 1 AS yes FROM top_{step})")
    return _with(*blocks)


def _trace_sql() -> str:
    rows = ["SELECT 0 AS step, NULL AS src, NULL AS dst, NULL AS score, count(DISTINCT component) AS n_components FROM members_0"]
    for step in range(1, WRITTEN_OUT + 1):
        count = f"(SELECT count(DISTINCT component) FROM members_{step})"
        rows.append(f"SELECT {step}, src, dst, {_SCALED.format('score')}, {count} FROM top_{step - 1}")
    return _removal_steps() + " " + " UNION ALL ".join(rows)


def _sizes(members: str, edges: str, first: str = "") -> str:
    return (
        f"SELECT {first}component, count(*) AS n_nodes, CAST(coalesce(sum(m), 0) AS BIGINT) AS n_edges FROM {members}"
        f" LEFT JOIN (SELECT src, count(*) AS m FROM {edges} GROUP BY src) ON src = id GROUP BY component"
    )


def _removal_sizes_sql() -> str:
    rows = [
        _sizes(f"members_{step}", f"edges_{step}", f"{step} AS step, ") + f" HAVING count(*) > {LARGEST}"
        for step in range(WRITTEN_OUT + 1)
    ]
    return _removal_steps() + " " + " UNION ALL ".join(rows)


def _removal_communities_sql() -> str:
    rows = [
        f"SELECT id, component FROM members_{step} WHERE NOT EXISTS (SELECT 1 FROM going_{step + 1})"
        for step in range(WRITTEN_OUT + 1)
    ]
    return _removal_steps() + " " + " UNION ALL ".join(rows)


_LISTED = "string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst)"
_MEMBERS = "members AS (SELECT v AS id, min(s) AS component FROM reach GROUP BY v)"
_DEPENDENCIES = f"SELECT s AS source, v AS node, round(coalesce(delta, 0), {DECIMALS}) AS delta"


def oracle_sql() -> dict[str, str]:
    graphs = {"web": _WEB, "duty": _DUTY, "trade": _TRADE, "lanes": _LANES, "relay": _RELAY, "places": _PLACES}
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS graph, n_nodes FROM ({_with(graph)} SELECT count(*) AS n_nodes FROM nodes)"
        for name, graph in graphs.items()
    )
    pairs = "SELECT src, dst FROM edges"
    found = {
        "vertices_web": _with(_WEB) + " SELECT id FROM nodes",
        "vertices_duty": _with(_DUTY) + " SELECT id FROM nodes",
        "vertex_counts": counts,
        "edges_web": _with(_WEB) + " " + pairs,
        "edges_duty": _with(_DUTY) + " SELECT src, dst, weight AS seconds FROM edges",
        "edges_trade": _with(_TRADE) + " " + pairs,
        "edges_lanes": _with(_LANES) + " SELECT src, dst, weight AS price FROM edges",
        "edges_places": _with(_PLACES) + " " + pairs,
        "edges_tolls": _with(_TOLLS) + " SELECT src, dst, weight AS price FROM edges",
        "edges_ferries": _with(_FERRIES) + " " + pairs,
        "steps_web": _with(_WEB) + " SELECT u, w FROM arcs",
        "steps_duty": _with(_DUTY) + " SELECT u, w, weight FROM arcs",
        "neighbours_pages": _with(_WEB) + " SELECT u AS id, w AS neighbour FROM arcs WHERE u IN (SELECT url FROM pages)",
        "adjacency_relay": _with(_RELAY)
        + f" SELECT id, 0 AS block, coalesce(listed, '') AS neighbours FROM nodes"
        + f" LEFT JOIN (SELECT src, {_LISTED} AS listed FROM edges GROUP BY src) ON src = id",
        "edge_list_file": _with(_TRADE) + " " + pairs,
        "adjacency_list_file": _with(_RELAY) + f" {pairs} UNION ALL SELECT id, NULL FROM nodes",
        "node_score_file": _node_sql(_DUTY),
        "edge_score_file": _edge_sql(_DUTY, _DIRECTED),
        "both_score_files": f"SELECT id AS src, NULL AS dst, centrality FROM ({_node_sql(_WEB)})"
        f" UNION ALL SELECT src, dst, centrality FROM ({_edge_sql(_WEB, _EITHER)})",
        "paths_duty": _paths_sql(_DUTY),
        "paths_web": _paths_sql(_WEB),
        "paths_trade_pivots": _paths_sql(_TRADE),
        "paths_trade_pivots_shuffled": _paths_sql(_TRADE),
        "paths_tolls_weighted": _paths_sql(_TOLLS, _LENGTHS),
        "paths_lanes_weighted": _paths_sql(_LANES, _LENGTHS),
        "paths_duty_weighted": _paths_sql(_DUTY, _LENGTHS),
        "visit_order_web": _with(_WEB, _SAMPLE, _from_pivots(_HOPS))
        + " SELECT s AS source, CAST(d AS DOUBLE) AS dist, count(*) AS n_nodes FROM reach GROUP BY s, d",
        "predecessors_duty": _with(_DUTY, _SAMPLE, _from_pivots(_HOPS))
        + " SELECT x.s AS source, a.w AS node, a.u AS pred FROM reach x JOIN arcs a ON a.u = x.v"
        + " JOIN reach y ON y.s = x.s AND y.v = a.w AND x.d + 1 = y.d",
        "predecessors_duty_weighted": _with(_DUTY, _SAMPLE, _from_pivots(_LENGTHS))
        + " SELECT s AS source, w AS node, u AS pred FROM tight",
        "dependencies_duty": _with(_DUTY, _SAMPLE, _HOPS, _THROUGH.format(only=_FROM_PIVOTS))
        + f" {_DEPENDENCIES} FROM reach LEFT JOIN through USING (s, v) WHERE s <> v AND s IN (SELECT id FROM pivots)",
        "dependencies_duty_endpoints": _with(_DUTY, _SAMPLE, _HOPS, _THROUGH.format(only=_FROM_PIVOTS))
        + f" {_DEPENDENCIES.replace('coalesce(delta, 0)', 'coalesce(delta, 0) + 1')}"
        + " FROM reach LEFT JOIN through USING (s, v) WHERE s <> v AND s IN (SELECT id FROM pivots)"
        + " UNION ALL SELECT s, s, CAST(count(*) - 1 AS DOUBLE) FROM reach WHERE s IN (SELECT id FROM pivots) GROUP BY s",
        "dependencies_duty_weighted": _with(_DUTY, _SAMPLE, _LENGTHS, _THROUGH.format(only=_FROM_PIVOTS))
        + f" {_DEPENDENCIES} FROM reach LEFT JOIN through USING (s, v) WHERE s <> v AND s IN (SELECT id FROM pivots)",
        "pivots_relay": _with(_RELAY, _SAMPLE) + " SELECT id FROM pivots",
        "node_bc_web": _node_sql(_WEB),
        "node_bc_web_raw": _node_sql(_WEB, factor="0.5", shown=_RAW),
        "node_bc_web_endpoints": _endpoint_sql(_WEB),
        "node_bc_duty": _node_sql(_DUTY),
        "node_bc_duty_raw": _node_sql(_DUTY, factor="1.0", shown=_RAW),
        "node_bc_duty_endpoints": _endpoint_sql(_DUTY),
        "node_bc_duty_weighted": _node_sql(_DUTY, _LENGTHS),
        "node_bc_lanes_weighted": _node_sql(_LANES, _LENGTHS),
        "node_bc_lanes_weighted_endpoints": _endpoint_sql(_LANES, _LENGTHS),
        "node_bc_tolls_weighted": _node_sql(_TOLLS, _LENGTHS),
        "node_bc_duty_weighted_shuffled": _node_sql(_DUTY, _LENGTHS),
        "node_bc_relay_pivots_raw": _node_sql(_RELAY, factor="1.0", pivots=True),
        "node_bc_relay_pivots_endpoints": _endpoint_sql(_RELAY, factor=_PIVOT_SHARE, pivots=True),
        "node_bc_trade_pivots_raw": _node_sql(_TRADE, factor=f"0.5 * {_N} / {PIVOTS}", pivots=True),
        "node_bc_trade_pivots_shuffled": _pivot_sql(_TRADE),
        "node_bc_places": _node_sql(_PLACES),
        "node_bc_relay_pivots": _pivot_sql(_RELAY),
        "node_bc_trade_pivots": _pivot_sql(_TRADE),
        "edge_bc_web": _edge_sql(_WEB, _EITHER),
        "edge_bc_web_shuffled": _edge_sql(_WEB, _EITHER),
        "edge_bc_tolls_weighted": _edge_sql(_TOLLS, _EITHER, _LENGTHS, "e.weight"),
        "edge_bc_duty": _edge_sql(_DUTY, _DIRECTED),
        "edge_bc_duty_raw": _edge_sql(_DUTY, _DIRECTED, factor="1.0", shown=_RAW),
        "edge_bc_duty_weighted": _edge_sql(_DUTY, _DIRECTED, _LENGTHS, "e.weight"),
        "edge_bc_lanes_weighted": _edge_sql(_LANES, _DIRECTED, _LENGTHS, "e.weight"),
        "components_web": _with(_WEB, _HOPS, _MEMBERS) + " SELECT id, component FROM members",
        "component_sizes_web": _with(_WEB, _HOPS, _MEMBERS) + " " + _sizes("members", "edges"),
        "top_edge_web": f"SELECT * FROM ({_edge_sql(_WEB, _EITHER)}) ORDER BY centrality DESC, src, dst LIMIT 1",
        "edge_removal_trace": _trace_sql(),
        "edge_removal_sizes": _removal_sizes_sql(),
        "edge_removal_communities": _removal_communities_sql(),
    }
    if text_queries:
        found |= text_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
