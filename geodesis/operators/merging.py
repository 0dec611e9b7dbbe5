"""Sets of vertices that hang together, in rounds that grow with the logarithm
of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.workspace import Workspace


def smallest_reachable(edges: DataFrame, tables: Workspace, name: str = "merging") -> DataFrame:
    """``node, component`` for every end of ``edges`` (``src, dst``); the
    component is the smallest id reachable, whatever the direction of edges.

    Every vertex points at a smaller or equal one. In each round, the pointers
    are followed once more (``far``), a vertex hears the smallest ``far`` of its
    neighbours, and both it and the vertex it points at take that if smaller.
    Both sides of every join are plain tables with one row per vertex on one of
    them, so a hub's rows can be split; minima are combined before they move.
    """
    ends = F.array(
        F.struct(F.col("src").alias("u"), F.col("dst").alias("w")),
        F.struct(F.col("dst").alias("u"), F.col("src").alias("w")),
    )
    both = edges.filter("src <> dst").select(F.explode(ends).alias("at")).select("at.u", "at.w")
    tables.save(f"{name}_links", both)
    linked = tables.load(f"{name}_links")
    started = linked.groupBy(F.col("u").alias("node")).agg(F.min("w").alias("low"))
    moved = tables.save(f"{name}_0", started.select("node", F.least("node", "low").alias("at")))["rows"]
    done = 0
    while moved:
        known = tables.load(f"{name}_{done}")
        ahead = known.select(F.col("node").alias("at"), F.col("at").alias("far"))
        tables.save(f"{name}_far", known.select("node", "at").join(ahead, "at"))
        here = tables.load(f"{name}_far")
        told = here.select(F.col("node").alias("w"), F.col("far").alias("heard"))
        heard = linked.join(told, "w").groupBy(F.col("u").alias("node")).agg(F.min("heard").alias("best"))
        tables.save(f"{name}_heard", heard)
        heard = tables.load(f"{name}_heard")
        hooks = here.select("node", "at").join(heard, "node").groupBy(F.col("at").alias("node")).agg(F.min("best").alias("best"))
        offers = (
            here.select("node", F.col("far").alias("best"), F.col("at").alias("was"))
            .unionByName(heard, allowMissingColumns=True)
            .unionByName(hooks, allowMissingColumns=True)
        )
        taken = offers.groupBy("node").agg(F.min("best").alias("at"), F.max("was").alias("was"))
        done += 1
        moved = tables.save(f"{name}_{done}", taken, changed=F.count_if(F.col("at") < F.col("was")))["changed"]
        tables.drop(f"{name}_{done - 1}", f"{name}_far", f"{name}_heard")
    tables.drop(f"{name}_links")
    return tables.load(f"{name}_{done}").select("node", F.col("at").alias("component"))
