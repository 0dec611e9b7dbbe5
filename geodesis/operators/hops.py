"""Shortest paths by number of edges: one round per distance.

Sources are dealt out to packs. State is one row per pack and vertex with a lane for
each source of the pack: the number of shortest paths if the vertex is at the row's
distance from that source, else zero. A step is joined and shuffled once for all
sources of a pack that are equally far on, and lanes are summed as columns.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodesis.operators.field import Field

PATHS = "paths"
PACKED = "packed"
# Sources that are numbered in one place.
NUMBERED = 1_000


def lanes(field: Field, name: str) -> list[str]:
    """The columns that hold a value for each source of a pack."""
    return [f"{name}{k}" for k in range(field.lanes)]


def _bit(k: int) -> Column:
    return F.lit(1 << k).cast("long")


def has(mask: str, k: int) -> Column:
    """Whether a lane is in a mask of lanes."""
    return F.col(mask).bitwiseAND(_bit(k)) != 0


def pack(field: Field, sources: DataFrame) -> DataFrame:
    """Write and return ``pack, lane, source``. Sources with a ``component`` of
    ``size`` vertices share packs with others of it: they meet the same vertices."""
    tables = field.workspace
    dealt, order = F.hash("source"), ["source"]
    if "component" in sources.columns:
        slot = F.pmod(dealt, F.ceil(F.col("size") / NUMBERED).cast("int"))
        dealt, order = F.hash("component", slot), ["component", "source"]
    part = F.pmod(dealt, F.lit(ceil(field.sources / NUMBERED))).cast("long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    dealt = sources.withColumn("part", part).withColumn("place", place)
    number = F.col("part") * F.lit(2**32) + F.floor(F.col("place") / field.lanes)
    tables.save(PACKED, dealt.select(number.alias("pack"), (F.col("place") % field.lanes).alias("lane"), "source"))
    return tables.load(PACKED)


def walk_hops(field: Field, sources: DataFrame) -> int:
    """Write ``pack, node, s0, s1, …, met`` with the distance as part number;
    ``met`` is the mask of the lanes that are not zero.

    All shortest paths to distance d+1 come from distance d, so the counts are
    complete after one sum. Returns the largest distance met.
    """
    tables, counts = field.workspace, lanes(field, "s")
    own = [F.when(F.col("lane") == k, 1.0).otherwise(0.0).alias(s) for k, s in enumerate(counts)]
    bit = F.get(F.array(*map(_bit, range(field.lanes))), F.col("lane").cast("int"))
    rows = tables.append(PATHS, 0, pack(field, sources).select("pack", F.col("source").alias("node"), *own, bit.alias("met")))
    reached = 0
    while True:
        # Walking both ways, a step changes the distance by one at most.
        old = range(reached + 1) if field.directed else range(max(0, reached - 1), reached + 1)
        field.fit(rows, sum(tables.rows(PATHS, distance) for distance in old))
        front = tables.parts(PATHS, [reached]).select("pack", F.col("node").alias("u"), *counts, "met")
        found = (
            field.leaving(field.together(front))
            .groupBy("pack", F.col("w").alias("node"))
            .agg(*[F.sum(s).alias(s) for s in counts], F.bit_or("met").alias("met"))
        )
        seen = field.together(tables.parts(PATHS, old).select("pack", "node", "met"))
        seen = seen.groupBy("pack", "node").agg(F.bit_or("met").alias("seen"))
        left = F.col("met").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        new = field.looked_up(found, seen).withColumn("met", left).filter("met <> 0")
        fresh = [F.when(has("met", k), F.col(s)).otherwise(0.0).alias(s) for k, s in enumerate(counts)]
        with field.planning():
            rows = tables.append(PATHS, reached + 1, new.select("pack", "node", *fresh, "met"))
        if rows == 0:
            return reached
        reached += 1


def each_source(field: Field, rows: DataFrame, kept: list[Column], **values: str) -> DataFrame:
    """A row per source of the lanes for which ``kept`` holds, with the ``source``
    and the ``values``, given by the names that their lanes begin with."""
    one = lambda k: F.struct(F.lit(k).alias("lane"), *[F.col(f"{lane}{k}").alias(name) for name, lane in values.items()])
    told = F.array(*[F.when(kept[k], one(k)) for k in range(field.lanes)])
    lost = {f"{lane}{k}" for lane in ("s", "d", *values.values()) for k in range(field.lanes)}
    own = [name for name in rows.columns if name not in lost]
    # Lanes without a value go after they are rows, which is compiled; a filter of arrays is not.
    told = rows.select(*own, F.explode(told).alias("of")).filter("of IS NOT NULL").select(*own, "of.*")
    packed = field.workspace.load(PACKED)
    few = field.sources <= field.limits.broadcast_rows
    return told.join(F.broadcast(packed) if few else packed, ["pack", "lane"]).drop("pack", "lane")
