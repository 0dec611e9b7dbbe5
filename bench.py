"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import geodesis as g
from geodesis.sources import tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Whole graphs and all sources unless a sample is named.
QUERIES = {
    "node_bc_web": lambda spark: g.node_betweenness(tables.web(spark, FOLDER)),
    "edge_bc_web": lambda spark: g.edge_betweenness(tables.web(spark, FOLDER)),
    "node_bc_duty": lambda spark: g.node_betweenness(tables.duty(spark, FOLDER)),
    "edge_bc_duty": lambda spark: g.edge_betweenness(tables.duty(spark, FOLDER)),
    "node_bc_duty_weighted": lambda spark: g.node_betweenness(tables.duty(spark, FOLDER), weight="seconds"),
    "edge_bc_lanes_weighted": lambda spark: g.edge_betweenness(tables.lanes(spark, FOLDER), weight="price"),
    "node_bc_relay_sample_64": lambda spark: g.node_betweenness(tables.relay(spark, FOLDER), k=64, seed=7),
    "node_bc_trade_sample_64": lambda spark: g.node_betweenness(tables.trade(spark, FOLDER), k=64, seed=7),
    "node_bc_trade_sample_64_shuffled": lambda spark: g.node_betweenness(
        tables.trade(spark, FOLDER), k=64, seed=7, limits=g.Limits(broadcast_arcs=0, hub_steps=200)
    ),
    "remove_3_edges_web": lambda spark: g.remove_edges(tables.web(spark, FOLDER), max_steps=3).trace,
    "components_places": lambda spark: g.connected_components(tables.places(spark, FOLDER)),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("geodesis-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up and first compilation are not part of any query.
    g.node_betweenness(tables.duty(spark, FOLDER), k=1, seed=1).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, query in QUERIES.items():
        start = time.perf_counter()
        query(spark).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "betweenness queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
