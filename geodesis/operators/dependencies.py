"""Dependencies of sources on vertices and edges, summed from the far end.

With ``share = (mass + delta) / sigma`` at the head of a step, where ``mass`` is the
number of vertices the head stands for (one, if none are folded), the step carries
``sigma(tail) * share`` of the source's paths, and a vertex's dependency is the
sum over the steps that leave it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodesis.graph import edge_key
from geodesis.operators.field import Field
from geodesis.operators.hops import PACKED, PATHS, each_source, has, lanes
from geodesis.operators.weighted import TIGHT

DEPENDENCIES = "dependencies"


def _share() -> Column:
    return ((F.col("mass") + F.col("delta")) / F.col("sigma")).alias("share")


def _shares(field: Field) -> list[Column]:
    """The share of every lane, zero where the head is not at this distance."""
    share = lambda s, d: (F.col("mass") + F.col(d)) / F.col(s)
    of = zip(lanes(field, "s"), lanes(field, "d"), lanes(field, "p"))
    return [F.when(F.col(s) > 0, share(s, d)).otherwise(0.0).alias(p) for s, d, p in of]


def gather_hops(field: Field, reached: int) -> None:
    """Write ``pack, node, s0, …, d0, …`` with the distance as part number: counts
    and dependencies of every lane."""
    tables, counts, sums = field.workspace, lanes(field, "s"), lanes(field, "d")
    last = tables.parts(PATHS, [reached]).select("pack", "node", *counts, *[F.lit(0.0).alias(d) for d in sums])
    tables.append(DEPENDENCIES, reached, last)
    for distance in range(reached - 1, -1, -1):
        field.fit(tables.rows(DEPENDENCIES, distance + 1))
        heads = field.massed(tables.parts(DEPENDENCIES, [distance + 1]), "node")
        heads = heads.select("pack", F.col("node").alias("w"), *_shares(field))
        passed = (
            field.entering(field.together(heads))
            .groupBy("pack", F.col("u").alias("node"))
            .agg(*[F.sum(p).alias(p) for p in lanes(field, "p")])
        )
        # Steps within a distance or outwards find no partner here.
        here = field.together(tables.parts(PATHS, [distance]).select("pack", "node", *counts))
        of = zip(counts, lanes(field, "p"), sums)
        delta = [(F.col(s) * F.coalesce(p, F.lit(0.0))).alias(d) for s, p, d in of]
        summed = field.looked_up(here, passed).select("pack", "node", *counts, *delta)
        with field.planning():
            tables.append(DEPENDENCIES, distance, summed)


def gather_weighted(field: Field, top: int) -> None:
    """The same with the layer as part number, highest layer first.

    What a layer passes on is filed by the layer it goes to, and picked up when
    that layer's turn comes.
    """
    tables = field.workspace
    ranks = field.together(tables.parts(PATHS).select("source", "node", F.col("part").alias("layer")))
    tails = ranks.select("source", F.col("node").alias("u"), F.col("layer").alias("u_layer"))
    heads = ranks.select("source", F.col("node").alias("w"), F.col("layer").alias("w_layer"))
    steps = field.together(tables.load(TIGHT).drop("flat"))
    with field.planning():
        tables.save_parted("ranked", field.matched(field.matched(steps, tails, "u"), heads, "w"), "w_layer")
    for layer in range(top, 0, -1):
        field.fit(tables.rows(PATHS, layer), tables.rows("ranked", layer), packs=False)
        here = field.together(tables.parts(PATHS, [layer]).select("source", "node", "sigma"))
        here = field.massed(here, "node")
        share = F.col("mass") / F.col("sigma")
        if layer < top:
            arrived = tables.filed("passed", layer)
            here = field.looked_up(here, _arrivals(field, arrived))
            share = share + F.coalesce("passed", F.lit(0.0))
        shares = here.select("source", F.col("node").alias("w"), share.alias("share"))
        steps = field.together(tables.parts("ranked", [layer]).drop("part"))
        sent = (
            field.matched(steps, shares, "w")
            .groupBy("source", F.col("u").alias("node"), "u_layer")
            .agg(F.sum("share").alias("share"))
        )
        with field.planning():
            tables.file("passed", sent, "u_layer")
    field.fit(tables.rows(PATHS), packs=False)
    reached = field.together(tables.parts(PATHS).select("source", "node", "sigma", F.col("part").alias("layer")))
    passed = F.lit(0.0)
    if top > 0:
        reached = field.looked_up(reached, _arrivals(field, tables.filed("passed")))
        passed = F.coalesce("passed", F.lit(0.0))
    delta = (F.col("sigma") * passed).alias("delta")
    with field.planning():
        tables.save_parted(DEPENDENCIES, reached.select("source", "node", "sigma", delta, "layer"), "layer")
    tables.drop("ranked", "passed")


def _arrivals(field: Field, sent: DataFrame) -> DataFrame:
    """``source, node, passed``: shares that reached a vertex, summed."""
    return field.together(sent).groupBy("source", "node").agg(F.sum("share").alias("passed"))


def vertex_dependencies(field: Field, endpoints: bool) -> DataFrame:
    """``source, node, delta`` without the sources themselves; with endpoints,
    a path also counts for its last vertex, and for its source on a row of its
    own with the number of vertices reached."""
    away = field.workspace.parts(DEPENDENCIES).filter(F.col("part") > 0)
    if field.weighted:
        away = away.select("source", "node", "delta")
        starts = field.workspace.parts(DEPENDENCIES, [0]).select("source")
    else:
        met = [F.col(s) > 0 for s in lanes(field, "s")]
        away = each_source(field, away, met, delta="d").select("source", "node", "delta")
        starts = field.workspace.load(PACKED).select("source")
    if not endpoints:
        return away
    others = away.withColumn("delta", F.col("delta") + 1.0)
    own = away.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("delta"))
    at_start = starts.join(own, "source", "left").withColumn("node", F.col("source"))
    return others.unionByName(at_start.select("source", "node", F.coalesce("delta", F.lit(0.0)).alias("delta")))


def _weighed(field: Field, rows: DataFrame, values: list[Column]) -> tuple[DataFrame, Column]:
    """The sum over lanes of a value, times the mass of the lane's source, and the
    rows with what it needs."""
    if not field.has_masses:
        return rows, reduce(add, values)
    masses = field.massed(field.workspace.load(PACKED), "source")
    one = lambda k: F.max(F.when(F.col("lane") == k, F.col("mass")))
    wide = masses.groupBy("pack").agg(*[F.coalesce(one(k), F.lit(0.0)).alias(m) for k, m in enumerate(lanes(field, "m"))])
    few = field.sources <= field.limits.broadcast_rows
    rows = rows.join(F.broadcast(wide) if few else wide, "pack")
    return rows, reduce(add, [value * F.col(m) for value, m in zip(values, lanes(field, "m"))])


def node_sums(field: Field, endpoints: bool) -> DataFrame:
    """``id, total``: dependencies on a vertex summed over sources."""
    if field.weighted:
        found = field.massed(vertex_dependencies(field, endpoints), "source")
        return found.groupBy(F.col("node").alias("id")).agg(F.sum(F.col("delta") * F.col("mass")).alias("total"))
    away = field.workspace.parts(DEPENDENCIES).filter(F.col("part") > 0)
    met = [F.when(F.col(s) > 0, 1.0).otherwise(0.0) for s in lanes(field, "s")]
    values = [F.col(d) for d in lanes(field, "d")]
    rows, total = _weighed(field, away, [value + one for value, one in zip(values, met)] if endpoints else values)
    found = rows.groupBy(F.col("node").alias("id")).agg(F.sum(total).alias("total"))
    if not endpoints:
        return found
    reached = away.groupBy("pack").agg(*[F.sum(one).alias(f"c{k}") for k, one in enumerate(met)])
    number = F.get(F.array(*lanes(field, "c")), F.col("lane"))
    own = field.workspace.load(PACKED).join(reached, "pack", "left")
    found = found.unionByName(own.select(F.col("source").alias("id"), F.coalesce(number, F.lit(0.0)).alias("total")))
    return found.groupBy("id").agg(F.sum("total").alias("total"))


def last_steps(field: Field) -> DataFrame:
    """``source, u, w, sigma, share`` for each step that ends a shortest path, of a
    weighted traversal."""
    tables = field.workspace
    field.fit(tables.rows(PATHS), packs=False)
    state = field.massed(tables.parts(DEPENDENCIES), "node").select("source", "node", "sigma", _share(), "part")
    state = field.together(state)
    heads = state.select("source", F.col("node").alias("w"), "share")
    tails = state.select("source", F.col("node").alias("u"), "sigma")
    steps = field.together(tables.load(TIGHT).drop("flat"))
    return field.matched(field.matched(steps, heads, "w"), tails, "u")


def tight_steps(field: Field) -> DataFrame:
    """``source, u, w`` for each step that ends a shortest path; needs no
    dependencies."""
    tables = field.workspace
    if field.weighted:
        return tables.load(TIGHT).select("source", "u", "w")
    field.fit(tables.rows(PATHS))
    state = field.together(tables.parts(PATHS).select("pack", "node", "met", "part"))
    heads = state.select("pack", F.col("node").alias("w"), F.col("met").alias("head"), (F.col("part") - 1).alias("part"))
    tails = state.select("pack", F.col("node").alias("u"), F.col("met").alias("tail"), "part")
    steps = field.between(heads, tails).select("pack", "u", "w", "head", "tail")
    on = [has("head", k) & has("tail", k) for k in range(field.lanes)]
    return each_source(field, steps, on).select("source", "u", "w")


def edge_sums(field: Field) -> DataFrame:
    """``src, dst, total``: dependencies on an edge summed over sources."""
    key = edge_key(F.col("u"), F.col("w"), field.directed)
    if field.weighted:
        steps = field.massed(last_steps(field), "source")
        return steps.groupBy(*key).agg(F.sum(F.col("sigma") * F.col("share") * F.col("mass")).alias("total"))
    tables = field.workspace
    field.fit(tables.rows(PATHS))
    state = field.massed(tables.parts(DEPENDENCIES), "node")
    heads = state.select("pack", F.col("node").alias("w"), *_shares(field), (F.col("part") - 1).alias("part"))
    tails = tables.parts(DEPENDENCIES).select("pack", F.col("node").alias("u"), *lanes(field, "s"), "part")
    of = zip(lanes(field, "s"), lanes(field, "p"))
    sent = [F.when(F.col(p) > 0, F.col(s) * F.col(p)).otherwise(0.0) for s, p in of]
    steps, total = _weighed(field, field.between(field.together(heads), field.together(tails)), sent)
    return steps.groupBy(*key).agg(F.sum(total).alias("total"))
