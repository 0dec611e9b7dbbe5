"""The ground a traversal walks on, laid out for joins.

A small graph is broadcast and every row of state is kept with its source: one
round is then a single pass without a shuffle of path steps. A large one is
joined by shuffles on the vertex, where the steps of a hub are spread over
slots so that no task gets all of them.

Hop-counted traversals (``packed``) lay a large graph out in places. A step lies at
the place of its tail; the steps of a hub lie at the places of their heads, and what
is known at the hub goes to every place. So what a place sends to a vertex is summed
there before it moves, and few rows move where few vertices have most steps.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from geodesis.graph import Graph, arcs
from geodesis.workspace import Workspace, session_conf


@dataclass(frozen=True)
class Limits:
    """Sizes at which the layout changes; results do not depend on them."""

    broadcast_arcs: int = 2_000_000
    """Most steps of a graph that is sent to every executor."""
    broadcast_bytes: int = 64 * 1024 * 1024
    """Most bytes of ids in those steps."""
    hub_steps: int = 1_000_000
    """Steps of one vertex beyond which they are spread over slots."""
    broadcast_hubs: int = 500_000
    """Most hubs whose slot counts are sent to every executor."""
    broadcast_rows: int = 200_000
    """Most rows of a round's news that are sent to every executor."""
    state_rows: int = 300_000_000
    """Most pairs of source and vertex held at a time; more go in batches."""
    fold_rounds: int = 8
    """Most rounds in which vertices with one neighbour are folded into it."""
    kept_rows: int = 4_000_000
    """Most (source, vertex) rows of a component whose state edge removal keeps."""
    run: str | None = None
    """Name under which sums of finished batches are kept; a later call with the
    same name, graph and options goes on after them, also from a new driver."""
    rows_per_slot: int = 50_000_000
    """Most rows that one slot of a vertex makes in a round: its steps times the
    sources of a batch. More sources mean smaller slots."""
    least_steps_per_task: int = 200_000
    """Path steps of a round worth a task of their own."""
    most_steps_per_task: int = 5_000_000
    """Path steps of a round beyond which more tasks than cores are used."""
    most_steps_per_place: int = 20_000_000
    """Most steps that lie at a place."""
    place_bytes: int = 64 * 1024 * 1024
    """Most bytes of state that a place is sent in a round, but for those of hubs."""


# Sources of a pack; the code of a round with many more is too long to be compiled.
LANES = 16
# Packs for each core, if a small graph has so many sources.
PACKS_PER_CORE = 4
# A vertex with more steps than so many times the places is a hub of all places.
HUB = 4


def unusable_weights() -> Column:
    """How many weights are no lengths, for :func:`refuse_unusable`."""
    usable = (F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf"))
    return F.count_if(~usable)


def refuse_unusable(seen: dict) -> None:
    if seen.get("unusable"):
        raise ValueError(f"{seen['unusable']} steps have a weight that is not a positive number")


def _owner(rows: DataFrame) -> str:
    """What all rows of a source have in common: its pack, if sources share rows."""
    return "pack" if "pack" in rows.columns else "source"


class Field:
    """Steps of one graph under one metric, plus the layout chosen for them."""

    def __init__(
        self,
        graph: Graph,
        workspace: Workspace,
        weight: str | None,
        limits: Limits,
        name: str = "arcs",
        sources: int = 1,
        packed: bool = False,
    ) -> None:
        self.spark = workspace.spark
        self.workspace = workspace
        self.name = name
        self.directed = graph.directed
        self.weighted = weight is not None
        self.limits = limits
        self.sources = max(1, sources)
        self.packed = packed
        self.slot_steps = max(1, min(limits.hub_steps, limits.rows_per_slot // max(1, sources)))
        steps = arcs(graph, weight)
        metrics = {}
        if not isinstance(steps.schema["u"].dataType, NumericType):
            sizes = [F.octet_length(F.col(end).cast("string")) for end in ("u", "w")]
            metrics["bytes"] = F.sum((sizes[0] + sizes[1]).cast("long"))
        if self.weighted:
            metrics["unusable"] = unusable_weights()
        if graph.kept and not metrics:
            # Many steps are laid out from the edges as they lie, not from a copy.
            seen = {"rows": steps.count()}
            workspace.lend(name, steps)
        else:
            seen = workspace.save(name, steps, **metrics)
        refuse_unusable(seen)
        self.size = seen["rows"]
        # Numbers have at most 16 bytes.
        measured = seen["bytes"] or 0 if "bytes" in seen else 32 * self.size
        self.small = self.size <= limits.broadcast_arcs and measured <= limits.broadcast_bytes
        if self.small and not workspace.has(name):
            workspace.save(name, steps)
        self._hubs: dict[str, DataFrame] = {}
        self._held: list[str] = []
        self._masses: DataFrame | None = None
        self.vertices = graph.n
        self.width = 2
        cores = self.spark.sparkContext.defaultParallelism
        self.lanes = min(LANES, ceil(self.sources / (PACKS_PER_CORE * cores)) if self.small else self.sources) if packed or self.weighted else 1
        steps = workspace.load(name)
        if self.small:
            self._by_u = self._by_w = steps
        elif packed:
            self._lay_out_in_places(steps)
        else:
            self._lay_out(steps)

    # -- layout of a large graph ------------------------------------------

    def _lay_out(self, steps: DataFrame) -> None:
        for end in ("u", "w"):
            hubs = (
                steps.groupBy(end)
                .agg(F.count(F.lit(1)).alias("steps"))
                .filter(F.col("steps") > self.slot_steps)
                .select(end, F.ceil(F.col("steps") / self.slot_steps).cast("int").alias("slots"))
            )
            size = F.sum(F.octet_length(F.col(end).cast("string")).cast("long"))
            found = self.workspace.save(f"{self.name}_hubs_{end}", hubs, bytes=size)
            if found["rows"]:
                hubs = self.workspace.load(f"{self.name}_hubs_{end}")
                few = found["rows"] <= self.limits.broadcast_hubs and found["bytes"] <= self.limits.broadcast_bytes
                self._hubs[end] = F.broadcast(hubs) if few else hubs
        for end, other in (("u", "w"), ("w", "u")):
            if end in self._hubs:
                slot = F.pmod(F.xxhash64(other), F.coalesce("slots", F.lit(1))).cast("int")
                steps = steps.join(self._hubs[end], end, "left").withColumn(f"{end}_slot", slot).drop("slots")
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(partitions, ceil(self.size / self.limits.most_steps_per_task))
        self._by_u = self._in_buckets(steps, "u", partitions)
        if self.directed:
            self._by_w = self._in_buckets(steps, "w", partitions)
        else:
            # Every step is there both ways: the same rows, read the other way.
            ends = {"u": "w", "w": "u", "u_slot": "w_slot", "w_slot": "u_slot"}
            renamed = [F.col(name).alias(ends.get(name, name)) for name in self._by_u.columns]
            self._by_w = self._by_u.select(*renamed)

    def _in_buckets(self, steps: DataFrame, end: str, buckets: int) -> DataFrame:
        """The steps as a table in buckets by one end, which rounds join as it lies.
        One task writes each bucket; a lost executor costs no steps."""
        table, key = f"geodesis_{uuid.uuid4().hex}", self._key(end)
        writer = steps.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key)
        writer.option("path", self.workspace.path(f"{self.name}_by_{end}")).saveAsTable(table)
        self._held.append(table)
        return self.spark.table(table)

    def _lay_out_in_places(self, steps: DataFrame) -> None:
        limits, cores = self.limits, self.spark.sparkContext.defaultParallelism
        useful = ceil(self.size * self.sources / self.lanes / limits.least_steps_per_task)
        held = 16 * self.vertices * self.sources
        least = (min(useful, 2 * cores), ceil(self.size / limits.most_steps_per_place), ceil(held / limits.place_bytes))
        self.places = max(2, *least)
        # A value for each place that Spark deals out to a task of its own.
        value, task = F.col("id").cast("int"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(self.places))
        dealt = self.spark.range(32 * self.places).select(value.alias("value"), task.alias("task"))
        self._values = [row["value"] for row in dealt.groupBy("task").agg(F.min("value").alias("value")).orderBy("task").collect()]
        self.places = len(self._values)
        self._hub_rows = 0
        for end in ("u", "w") if self.directed else ("u",):
            counted = steps.groupBy(end).agg(F.count(F.lit(1)).alias("steps"))
            slots = F.ceil(F.col("steps") / self.slot_steps).cast("int")
            slots = F.least(F.when(F.col("steps") > HUB * self.places, self.places).otherwise(slots), F.lit(self.places))
            hubs = counted.select(end, slots.alias("slots")).filter("slots > 1")
            found = self.workspace.save(f"{self.name}_hubs_{end}", hubs)
            if found["rows"]:
                hubs = self.workspace.load(f"{self.name}_hubs_{end}")
                self._hubs[end] = F.broadcast(hubs) if found["rows"] <= limits.broadcast_hubs else hubs
                self._hub_rows = max(self._hub_rows, found["rows"])
        if not self.directed and "u" in self._hubs:
            self._hubs["w"] = self._hubs["u"].withColumnRenamed("u", "w")
        self._by_u = self._in_places(steps, "u", "w")
        if self.directed:
            self._by_w = self._in_places(steps, "w", "u")
        else:
            self._by_w = self._by_u.select("place", F.col("u").alias("w"), F.col("w").alias("u"))

    def _place(self, end: str, slot: Column, slots: Column) -> Column:
        """Where a slot of a vertex lies. If it has one at every place, the slot is
        the place."""
        home = F.when(slots == self.places, 0).otherwise(F.pmod(F.xxhash64(end), F.lit(self.places)))
        return F.get(F.array(*map(F.lit, self._values)), F.pmod(home + slot, F.lit(self.places)).cast("int"))

    def _in_places(self, steps: DataFrame, end: str, other: str) -> DataFrame:
        """The steps as a table in buckets by the place of one end."""
        slots = F.lit(1)
        if end in self._hubs:
            steps, slots = steps.join(self._hubs[end], end, "left"), F.coalesce("slots", F.lit(1))
        rows = steps.select(self._place(end, F.pmod(F.xxhash64(other), slots), slots).alias("place"), "u", "w")
        table = f"geodesis_{uuid.uuid4().hex}"
        writer = rows.repartition(self.places, "place").write.bucketBy(self.places, "place").sortBy(end)
        writer.option("path", self.workspace.path(f"{self.name}_by_{end}")).saveAsTable(table)
        self._held.append(table)
        return self.spark.table(table)

    def _at_places(self, rows: DataFrame, end: str) -> DataFrame:
        """Rows of packs where the steps of a vertex lie."""
        slots = F.lit(1)
        if end in self._hubs:
            rows, slots = rows.join(self._hubs[end], end, "left"), F.coalesce("slots", F.lit(1))
        rows = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))
        rows = rows.withColumn("place", self._place(end, F.col("slot"), slots)).drop("slot", "slots")
        return self._dealt(rows)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in the task of their place, where they are looked up by hash if the
        rows at hubs, which go everywhere, are not too many."""
        rows = rows.repartition(self.places, "place")
        everywhere = self._hub_rows * ceil(self.sources / self.lanes) * (32 + 8 * self.lanes)
        return rows.hint("shuffle_hash") if everywhere <= 4 * self.limits.place_bytes else rows

    @property
    def slots(self) -> list[str]:
        """Columns that tell the slots of a step, if any vertex is a hub."""
        return [f"{end}_slot" for end in ("u", "w") if end in self._hubs]

    def _key(self, end: str) -> list[str]:
        return [end, f"{end}_slot"] if end in self._hubs else [end]

    def _spread(self, rows: DataFrame, end: str) -> DataFrame:
        """Copy the rows of a hub into each of its slots."""
        if end not in self._hubs:
            return rows
        slots = F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)
        return rows.join(self._hubs[end], end, "left").withColumn(f"{end}_slot", F.explode(slots)).drop("slots")

    def release(self) -> None:
        """Give up the tables of the steps; results read none of them."""
        for table in self._held:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._held = []
        self.workspace.drop(self.name, f"{self.name}_hubs_u", f"{self.name}_hubs_w", f"{self.name}_masses")
        self.workspace.drop(f"{self.name}_by_u", f"{self.name}_by_w", f"{self.name}_spots")

    # -- what traversals use -----------------------------------------------

    def fit(self, rows: int, known: int = 0, packs: bool = True) -> None:
        """Choose the number of tasks for a round that walks on from ``rows``
        rows of state and reads ``known`` more: enough for the cores if that is
        much work, few if not. ``packs`` tells that the rows hold lanes."""
        steps = known + rows * (1 + self.size / max(1, self.vertices)) * (max(1, self.lanes // 4) if packs else 1)
        least = ceil(steps / self.limits.most_steps_per_task)
        useful = ceil(steps / self.limits.least_steps_per_task)
        cores = self.spark.sparkContext.defaultParallelism
        self.width = max(2, least, min(useful, 2 * cores))

    def together(self, rows: DataFrame) -> DataFrame:
        """Bring all rows of a source into one partition if the graph is small."""
        return rows.repartition(self.width, _owner(rows)) if self.small else rows

    def gathered(self, steps: DataFrame, end: str) -> DataFrame:
        """Steps of sources, laid out to be matched at one end round after round."""
        return self.together(steps) if self.small else steps.repartition("source", *self._key(end))

    def leaving(self, rows: DataFrame) -> DataFrame:
        """Rows at ``u`` with every step ``u -> w``."""
        return self._walk(rows, "u", self._by_u)

    def entering(self, rows: DataFrame) -> DataFrame:
        """Rows at ``w`` with every step ``u -> w``."""
        return self._walk(rows, "w", self._by_w)

    def _walk(self, rows: DataFrame, end: str, steps: DataFrame) -> DataFrame:
        if self.small:
            return rows.join(F.broadcast(steps), end)
        if self.packed:
            return self._at_places(rows, end).join(steps, ["place", end])
        return self._spread(rows, end).join(steps, self._key(end))

    def matched(self, steps: DataFrame, state: DataFrame, end: str, *more: str) -> DataFrame:
        """Steps of a source joined to that source's state at one end of them."""
        keys = [_owner(steps), *self._key(end), *more]
        state = self._spread(state, end)
        return steps.join(state.hint("shuffle_hash") if self.small else state, keys)

    def between(self, heads: DataFrame, tails: DataFrame) -> DataFrame:
        """Every step ``u -> w`` of a pack with what is known at both ends: ``heads``
        at ``w`` and ``tails`` at ``u`` that have the same ``part``."""
        if self.small:
            return self.matched(self.entering(heads), tails, "u", "part")
        spots = f"{self.name}_spots"
        if not self.workspace.has(spots):
            self.workspace.save(spots, self._by_w.select("u", "place").distinct())
        tails = self._dealt(tails.join(self.workspace.load(spots), "u"))
        return self.entering(heads).join(tails, ["place", "u", "pack", "part"])

    def looked_up(self, rows: DataFrame, other: DataFrame) -> DataFrame:
        """Rows of a source (or pack) and ``node`` with what ``other`` knows about
        them, if anything."""
        if self.small:
            other = other.hint("shuffle_hash")
        return rows.join(other, [_owner(rows), "node"], "left")

    def few_steps(self, rows: int) -> bool:
        """Whether a round from ``rows`` rows of state may bring little news."""
        return rows * self.size <= self.limits.broadcast_rows * max(1, self.vertices)

    def about(self, history: DataFrame, news: DataFrame, count: int, keys: list[str]) -> DataFrame:
        """The part of the history that shares keys with the ``count`` rows of
        news. Few news go to the history, which then need not be shuffled."""
        if count > self.limits.broadcast_rows:
            return history
        return history.join(F.broadcast(news.select(*keys)), keys, "left_semi")

    def stand_for(self, masses: DataFrame) -> None:
        """Take the number of vertices that each ``id`` stands for from ``id,
        mass``; others stand for themselves alone."""
        kind = masses.schema["id"].dataType
        size = F.sum(F.octet_length(F.col("id").cast("string")).cast("long"))
        found = self.workspace.save(f"{self.name}_masses", masses, bytes=size)
        few = found["rows"] <= self.limits.broadcast_hubs and (isinstance(kind, NumericType) or (found["bytes"] or 0) <= self.limits.broadcast_bytes)
        masses = self.workspace.load(f"{self.name}_masses")
        self._masses = F.broadcast(masses) if few else masses

    @property
    def has_masses(self) -> bool:
        return self._masses is not None

    def massed(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows with the ``mass`` of a column: how many vertices it stands for."""
        if self._masses is None:
            return rows.withColumn("mass", F.lit(1.0))
        joined = rows.join(self._masses.withColumnRenamed("id", column), column, "left")
        return joined.withColumn("mass", F.coalesce("mass", F.lit(1.0)))

    def planning(self):
        """Settings under which rows kept with their source, or at a place, are not
        shuffled again for a join on more than that. State is not sent to every
        executor on the strength of its size in files: it unfolds to many times that."""
        if not self.small and not self.packed:
            return session_conf(self.spark)
        return session_conf(
            self.spark,
            spark__sql__requireAllClusterKeysForCoPartition="false",
            spark__sql__autoBroadcastJoinThreshold="-1",
        )
