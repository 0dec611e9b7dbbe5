"""Shortest paths by summed weights.

Three passes: distances by relaxing improved vertices until none is left, in rows
that hold a lane for each source of a pack, as in a hop-counted traversal; the
tight steps, which are the last steps of shortest paths; and path counts, by
counting walks over tight steps of 0, 1, 2, … steps. The number of steps of the
longest of these walks is the vertex's layer: tight steps only lead to higher
layers, which is the order the dependencies are summed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.operators.field import Field
from geodesis.operators.hops import PATHS, each_source, lanes, pack

DISTANCES = "distances"
TIGHT = "tight"


def _relax(field: Field, sources: DataFrame) -> None:
    """Write ``pack, node, d0, d1, …``: the distance of every reached vertex from
    each source of the pack. A row of a round holds the lanes that improved."""
    tables, dists = field.workspace, lanes(field, "d")
    own = [F.when(F.col("lane") == k, 0.0).alias(d) for k, d in enumerate(dists)]
    rows = tables.append("improved", 0, pack(field, sources).select("pack", F.col("source").alias("node"), *own))
    done = 0
    while True:
        field.fit(rows, tables.rows("improved"))
        front = tables.parts("improved", [done]).select("pack", F.col("node").alias("u"), *dists)
        tried = field.leaving(field.together(front)).groupBy("pack", F.col("w").alias("node")).agg(
            *[F.min(F.col(d) + F.col("weight")).alias(d) for d in dists]
        )
        history = tables.parts("improved")
        if field.few_steps(rows):
            with field.planning():
                count = tables.append("tried", done, tried)
            tried = field.together(tables.parts("tried", [done]).drop("part"))
            history = field.about(history, tried, count, ["pack", "node"])
        least = [F.min(d).alias(b) for d, b in zip(dists, lanes(field, "b"))]
        best = field.together(history).groupBy("pack", "node").agg(*least)
        nearer = lambda d, b: F.when(F.col(b).isNull() | (F.col(d) < F.col(b)), F.col(d)).alias(d)
        better = field.looked_up(tried, best).select("pack", "node", *map(nearer, dists, lanes(field, "b")))
        with field.planning():
            rows = tables.append("improved", done + 1, better.filter(F.coalesce(*dists).isNotNull()))
        if rows == 0:
            break
        done += 1
    field.fit(tables.rows("improved"))
    least = [F.min(d).alias(d) for d in dists]
    tables.save(DISTANCES, field.together(tables.parts("improved")).groupBy("pack", "node").agg(*least))
    tables.drop("improved", "tried")


def _tighten(field: Field) -> None:
    """Write the steps ``source, u, w`` that end a shortest path to ``w``. A step is
    joined once for all sources of a pack."""
    tables, dists = field.workspace, lanes(field, "d")
    known = field.together(tables.load(DISTANCES))
    tails = known.select("pack", F.col("node").alias("u"), *dists)
    heads = known.select("pack", F.col("node").alias("w"), *[F.col(d).alias(h) for d, h in zip(dists, lanes(field, "h"))])
    steps = field.matched(field.leaving(tails), heads, "w")
    flat = lambda d, h, f: F.when(F.col(d) + F.col("weight") == F.col(h), F.col(d) >= F.col(h)).alias(f)
    steps = steps.select("pack", "u", "w", *field.slots, *map(flat, dists, lanes(field, "h"), lanes(field, "f")))
    tight = each_source(field, steps, [F.col(f).isNotNull() for f in lanes(field, "f")], flat="f")
    with field.planning():
        seen = tables.save(TIGHT, tight.select("source", "u", "w", *field.slots, "flat"), flat=F.count_if(F.col("flat")))
    if seen["flat"]:
        raise ValueError("some weights are too small next to the distances to be told from zero")


def _count_walks(field: Field, sources: DataFrame) -> None:
    """Write, per number of steps, how many shortest paths have that many."""
    tables = field.workspace
    start = sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma"))
    rows = tables.append("walks", 0, start)
    field.fit(tables.rows(TIGHT), packs=False)
    tight = field.gathered(tables.load(TIGHT).drop("flat"), "u").persist()
    done = 0
    while True:
        front = field.together(tables.parts("walks", [done]).select("source", F.col("node").alias("u"), "sigma"))
        longer = (
            field.matched(tight, front, "u")
            .groupBy("source", F.col("w").alias("node"))
            .agg(F.sum("sigma").alias("sigma"))
        )
        with field.planning():
            rows = tables.append("walks", done + 1, longer)
        if rows == 0:
            break
        done += 1
    tight.unpersist()


def walk_weighted(field: Field, sources: DataFrame) -> int:
    """Write ``source, node, dist, sigma`` with the layer as part number and the
    tight steps as a table of their own. Returns the highest layer."""
    tables = field.workspace
    _relax(field, sources)
    _tighten(field)
    _count_walks(field, sources)
    counted = (
        field.together(tables.parts("walks"))
        .groupBy("source", "node")
        .agg(F.sum("sigma").alias("sigma"), F.max("part").alias("layer"))
    )
    met = [F.col(d).isNotNull() for d in lanes(field, "d")]
    known = field.together(each_source(field, tables.load(DISTANCES), met, dist="d"))
    with field.planning():
        top = tables.save_parted(
            PATHS, field.looked_up(known, counted).select("source", "node", "dist", "sigma", "layer"), "layer"
        )
    tables.drop("walks", DISTANCES)
    return top
