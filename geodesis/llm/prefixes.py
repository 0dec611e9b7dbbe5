"""Prefix trie of conversations: which beginnings they share.

A node stands for the first ``d`` turns, role and text, of all conversations that
begin with them. Turns become 16-byte digests, and conversations rows of a matrix
of turn ids, padded behind their last turn. Longer ones are cut into panels of
``WIDTH`` turns; a panel's rows carry a digest of all turns before it.

Rows are dealt out by ranges of (digest before, ids), so equal rows and those with
long common beginnings are neighbours, and a large group of them is shared by
several ranges. A task takes blocks of rows in order. ``lexsort`` orders a block, a
mask tells where a column changes, and or-ing it along the columns marks the row
where each node of each depth begins; ``reduceat`` sums up every depth between
these marks. A node at the border of a block or panel stays open: its parts carry a
digest of the whole beginning and are added up afterwards, one row for each part.

Subtrees need no walk over the trie. Each different node is credited to the row
it begins in, which belongs to all of its ancestors; so the words of a subtree's
nodes, and its leaves, are sums over the member rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodesis.workspace import Workspace

# Turns in a panel, and rows of it that are looked at together.
WIDTH = 64
BLOCK = 4096
START = bytes(16)
_NOTHING = hashlib.sha256(b"").hexdigest()


# -- turns --------------------------------------------------------------------


def _read_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, turn, id, words``; the digest tells role and text apart."""
    of = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    told = F.concat(F.octet_length(of(role)).cast("string"), F.lit(":"), of(role), of(text))
    return rows.filter(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.md5(told.cast("binary"))).alias("id"),
        F.regexp_count(of(text), F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"),
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the turns of each conversation as far as this range has them."""
    shard = TaskContext.get().partitionId()
    last, count = None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        fresh = np.append(True, conv[1:] != conv[:-1])
        fresh[0] = conv[0] != last
        at = np.arange(len(conv))
        begun = np.maximum.accumulate(np.where(fresh, at, -count))
        place = at - begun + 1
        last, count = conv[-1], int(place[-1])
        columns = [pa.array(np.full(len(conv), shard, np.int32)), batch.column("conv_id"), pa.array(place), batch.column("id"), batch.column("words")]
        yield pa.record_batch(columns, ["shard", "conv_id", "place", "id", "words"])


def numbered_turns(
    rows: DataFrame, tables: Workspace, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``shard, conv_id, place, id, words`` of every turn, and ``conv_id, shard,
    before, n``: how many turns of a conversation a range has, and how many lie
    before it. A turn's number is ``before + place``. One conversation may fill
    many ranges."""
    order = ["conv_id", "turn", "id"]
    dealt = _read_turns(rows, conv_id, turn, role, text).repartitionByRange(*order).sortWithinPartitions(*order)
    tables.save("placed", dealt.mapInArrow(_placed, "shard int, conv_id long, place long, id binary, words int"))
    placed = tables.load("placed")
    counted = placed.groupBy("conv_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    tables.save("spans", counted.select("conv_id", "shard", before.alias("before"), "n"))
    return placed, tables.load("spans")


def with_shared_starts(placed: DataFrame, spans: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, id, words`` of conversations that begin like others, and
    ``conv_id, total``, their numbers of turns.

    Conversation ``c`` takes the first ``h`` turns of conversation ``c - c %
    every``, as far as there are any, and then its own but for its first ``h``;
    ``h`` is the CRC-32 of its decimal id modulo ``most``."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    heads = placed.join(spans, ["conv_id", "shard"]).withColumn("depth", F.col("before") + F.col("place"))
    heads = heads.filter((F.col("conv_id") % every == 0) & (F.col("depth") < most))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("depth", "id", "words"))).alias("head"))
    owned = spans.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumn("taken", taken)
    owned = owned.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    head = F.coalesce(F.filter("head", lambda x: x["depth"] <= F.col("taken")), F.array().cast(heads.schema["head"].dataType))
    owned = owned.select("conv_id", "own", "taken", head.alias("head"))
    owned = owned.withColumn("shown", F.size("head").cast("long"))
    total = F.col("shown") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))
    shift = spans.join(owned.select("conv_id", "taken", "shown"), "conv_id")
    rest = placed.join(shift, ["conv_id", "shard"]).withColumn("at", F.col("before") + F.col("place"))
    rest = rest.filter("at > taken").select("conv_id", (F.col("shown") + F.col("at") - F.col("taken")).alias("depth"), "id", "words")
    first = owned.select("conv_id", F.explode("head").alias("at")).select("conv_id", "at.depth", "at.id", "at.words")
    return first.unionByName(rest), owned.select("conv_id", total.alias("total"))


def as_given(placed: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, id, words`` and ``conv_id, total`` of conversations as
    they are."""
    turns = placed.join(spans, ["conv_id", "shard"])
    turns = turns.select("conv_id", (F.col("before") + F.col("place")).alias("depth"), "id", "words")
    return turns, spans.groupBy("conv_id").agg(F.sum("n").alias("total"))


# -- panels -------------------------------------------------------------------


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, panel, prefix``: a digest of the turns before each panel."""
    known, prefix = None, START
    for batch in batches:
        prefixes = []
        for conv, own in zip(batch.column("conv_id").to_pylist(), batch.column("own").to_pylist()):
            if conv != known:
                known, prefix = conv, START
            prefixes.append(prefix)
            prefix = hashlib.md5(prefix + own).digest()
        yield pa.record_batch([batch.column("conv_id"), batch.column("panel"), pa.array(prefixes, pa.binary())], ["conv_id", "panel", "prefix"])


def _panels(turns: DataFrame, totals: DataFrame, tables: Workspace, width: int, most: int) -> DataFrame:
    """One row per panel: ``prefix, ids, more, conv_id, panel, words`` and what
    later panels of the conversation hold: ``later_words``, ``later_new`` (words of
    nodes credited to it) and ``later_leaves``."""
    panel = F.expr(f"(depth - 1) div {width}").alias("panel")
    rows = turns.groupBy("conv_id", panel).agg(F.sort_array(F.collect_list(F.struct("depth", "id", "words"))).alias("at"))
    ids = F.unhex(F.array_join(F.transform("at.id", F.hex), ""))
    rows = rows.select("conv_id", "panel", ids.alias("ids"), F.col("at.words").alias("words"))
    last = F.expr(f"(greatest(total, 1) - 1) div {width}")
    none = totals.filter("total = 0").select("conv_id", F.lit(0).cast("long"), F.unhex(F.lit("")), F.array().cast("array<int>"))
    tables.save("panels", rows.union(none.toDF(*rows.columns)))
    panels = tables.load("panels")
    tables.save("long", totals.filter(last > 0).select("conv_id", last.alias("last")))
    # Only conversations of several panels have a digest before a panel.
    several = panels.join(tables.load("long"), "conv_id")
    total = F.aggregate("words", F.lit(0).cast("long"), lambda x, y: x + y)
    told = several.select("conv_id", "panel", F.unhex(F.md5("ids")).alias("own")).repartition("conv_id").sortWithinPartitions("conv_id", "panel")
    tables.save("chained", told.mapInArrow(_chained, "conv_id long, panel long, prefix binary"))
    several = several.join(tables.load("chained"), ["conv_id", "panel"])
    several = several.select("conv_id", "panel", "ids", "words", "prefix", (F.col("panel") < F.col("last")).alias("more"))
    tables.save("several", several)
    several = tables.load("several")
    zero = F.lit(0).cast("long")
    plain = lambda rows: rows.withColumns({"later_words": zero, "later_new": zero, "later_leaves": zero})
    tables.save("credits", _in_ranges(plain(several.filter("panel > 0")), _credits, width, most, _CREDITS))
    credits = _corrected_credits(tables.load("credits"), width)
    later = Window.partitionBy("conv_id").orderBy(F.desc("panel")).rowsBetween(Window.unboundedPreceding, -1)
    after = lambda column: F.coalesce(F.sum(column).over(later), zero)
    several = several.join(credits, ["conv_id", "panel"], "left").withColumns(
        {"later_words": after(total), "later_new": after("new"), "later_leaves": after("leaves")}
    )
    tables.save("lasting", several.drop("new", "leaves"))
    single = panels.join(tables.load("long").select("conv_id"), "conv_id", "left_anti")
    single = plain(single.withColumns({"prefix": F.lit(START), "more": F.lit(False)}))
    return single.unionByName(tables.load("lasting"))


# -- blocks -------------------------------------------------------------------

_CREDITS = "conv_id long, panel long, new long, leaves long, at string, shard int, prefix binary, ids binary, words array<int>"
_NODES = (
    "shard int, block int, place int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long,"
    " ends string, open boolean, key binary, parent_key binary, parent_conv long, first boolean, last boolean, before long,"
    " at string, prefix binary, ids binary, words array<int>"
)
_ROW = ["prefix", "ids", "more", "conv_id", "panel", "words", "later_words", "later_new", "later_leaves"]


def _in_ranges(rows: DataFrame, read, width: int, most: int, schema: str) -> DataFrame:
    """The parts of nodes, or the credits of rows, range by range. Each range also
    tells its first and its last row, under ``at``."""
    order = ["prefix", "ids", "more", "conv_id"]
    dealt = rows.select(*_ROW).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(partial(read, width=width, most=most), schema)


def _dense(values: bytes) -> np.ndarray:
    """Ranks of 16-byte values; equal ones share one."""
    high, low = np.frombuffer(values, ">u8").reshape(-1, 2).T
    order = np.lexsort((low, high))
    fresh = np.zeros(len(order), np.int64)
    fresh[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    ranks = np.empty(len(order), np.int64)
    ranks[order] = fresh.cumsum()
    return ranks


def _common(row: dict | None, other: dict | None) -> int:
    """How many turns two rows have in common, -1 if they are not of one panel."""
    if row is None or other is None or row["prefix"] != other["prefix"]:
        return -1
    most = min(len(row["ids"]), len(other["ids"])) // 16
    return next((k for k in range(most) if row["ids"][16 * k : 16 * k + 16] != other["ids"][16 * k : 16 * k + 16]), most)


class _Block:
    """Rows of a range as a padded matrix of turn ids, with the marks of nodes."""

    def __init__(self, rows: list[dict], before: dict | None, after: dict | None) -> None:
        self.lengths = np.array([len(row["ids"]) // 16 for row in rows])
        depth = self.depth = int(self.lengths.max())
        inside = np.arange(depth) < self.lengths[:, None]
        matrix = np.full((len(rows), depth + 1), -1)
        matrix[:, 0] = _dense(b"".join(row["prefix"] for row in rows))
        matrix[:, 1:][inside] = _dense(b"".join(row["ids"] for row in rows))
        conv = np.array([row["conv_id"] for row in rows])
        more = np.array([row["more"] for row in rows])
        order = np.lexsort((conv, more, *matrix.T[::-1]))
        words = np.zeros((len(rows), depth + 1), np.int64)
        words[:, 1:][inside] = np.concatenate([row["words"] for row in rows])
        matrix, self.conv, self.more, self.lengths = matrix[order], conv[order], more[order], self.lengths[order]
        self.rows = [rows[k] for k in order]
        self.words = words[order].cumsum(axis=1)
        self.total = self.words[:, -1]
        self.later = np.array([[row["later_words"], row["later_new"], row["later_leaves"]] for row in self.rows], np.int64).T

        # Turns in common with the row before; a node begins beyond them.
        changed = np.ones(matrix.shape, bool)
        changed[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
        self.common = np.minimum((~changed).sum(axis=1) - 1, self.lengths)
        self.common[0] = _common(before, self.rows[0])
        changed[0] = np.arange(depth + 1) > self.common[0]
        self.after = _common(self.rows[-1], after)
        self.changed = changed
        self.begins = changed & (np.arange(depth + 1) <= self.lengths[:, None])
        self.new = self.total - self.words[np.arange(len(rows)), np.maximum(self.common, 0)]
        ahead = np.append(self.common[1:], self.after)
        self.leaves = (~self.more & (ahead < self.lengths)).astype(np.int64)

    def key(self, row: int, depth: int) -> bytes:
        prefix, ids = self.rows[row]["prefix"], self.rows[row]["ids"]
        return hashlib.md5(prefix + hashlib.md5(ids[: 16 * depth]).digest()).digest() if depth else prefix


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[_Block, bool, bool]]:
    """Blocks with whether they are the first and the last of their range."""
    held: list[dict] = []
    before = None
    for batch in batches:
        held += batch.to_pylist()
        while len(held) > most:
            rows, held = held[:most], held[most:]
            block = _Block(rows, before, held[0])
            yield block, before is None, False
            before = block.rows[-1]
    if held:
        yield _Block(held, before, None), before is None, True


def _border(names: list[str], block: _Block, first: bool, last: bool, shard: int) -> list[dict]:
    at = [("first", block.rows[0])] * first + [("last", block.rows[-1])] * last
    return [dict.fromkeys(names) | {"at": name, "shard": shard} | {key: row[key] for key in ("prefix", "ids", "words")} for name, row in at]


def _credits(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("panel", pa.int64()), ("new", pa.int64()), ("leaves", pa.int64()), ("at", pa.string())]
        + [("shard", pa.int32()), ("prefix", pa.binary()), ("ids", pa.binary()), ("words", pa.list_(pa.int32()))]
    )
    shard = TaskContext.get().partitionId()
    for block, first, last in _blocks(batches, most):
        rows = []
        for k, row in enumerate(block.rows):
            credit = {"conv_id": row["conv_id"], "panel": row["panel"], "new": int(block.new[k]), "leaves": int(block.leaves[k])}
            place = "+first" * (first and k == 0) + "+last" * (last and k + 1 == len(block.rows))
            rows.append(dict.fromkeys(schema.names) | credit | {"shard": shard, "at": place or None})
        yield pa.RecordBatch.from_pylist(rows + _border(schema.names, block, first, last, shard), schema)


def _nodes(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _NODES.split(", "))])
    shard = TaskContext.get().partitionId()
    for number, (block, first, last) in enumerate(_blocks(batches, most)):
        yield pa.RecordBatch.from_pylist(_border(schema.names, block, first, last, shard), schema)
        count = len(block.rows)
        base = np.array([row["panel"] for row in block.rows]) * width
        shown = [str(conv) for conv in block.conv.tolist()]
        above: tuple = ()
        for depth in range(block.depth + 1):
            marks = block.changed[:, depth].copy()
            marks[0] = True
            starts = np.flatnonzero(marks)
            summed = lambda column: np.add.reduceat(column, starts)  # noqa: B023, E731
            suffix = block.total - block.words[:, max(depth - 1, 0)]
            own = np.where(block.common >= depth, block.new, suffix)
            lowest = np.minimum.reduceat(block.conv, starts)
            convs = np.diff(np.append(starts, count))
            children = summed(block.begins[:, depth + 1].astype(np.int64)) if depth < block.depth else np.zeros(len(starts), np.int64)
            leaves = summed(block.leaves + block.later[2])
            saved = summed(suffix + block.later[0]) - summed(own + block.later[1])
            ended = summed((~block.more & (block.lengths == depth)).astype(np.int64))
            # What may go on in the block before or after, or in the next panel.
            on_first, on_last = starts == 0, np.append(starts[1:], count) == count
            opened = (on_first & (first | (block.common[0] >= depth))) | (on_last & (last | (block.after >= depth)))
            opened |= (depth == width) & summed(block.more.astype(np.int64)).astype(bool)
            rooted = (depth == 0) & (base[starts] > 0)
            opened |= rooted
            for name in (convs, leaves, saved):
                name[rooted] = 0
            valid = np.flatnonzero(block.lengths[starts] >= depth)
            parents = np.searchsorted(above[0], starts, "right") - 1 if depth else np.zeros(len(starts), np.int64)
            columns: dict[str, list] = {name: [] for name in schema.names}
            for k in valid.tolist():
                at, parent = int(starts[k]), int(parents[k])
                line = ",".join(shown[at : at + ended[k]])
                root = bool(rooted[k])
                inner = depth > 0 and not above[2][parent]
                row = {
                    "conv_id": None if root else int(lowest[k]),
                    "ends": line if opened[k] else hashlib.sha256(line.encode()).hexdigest() if line else _NOTHING,
                    "key": block.key(at, depth) if opened[k] else None,
                    "parent_key": block.key(at, depth - 1) if depth and not inner else None,
                    "parent_conv": int(above[1][parent]) if inner else None,
                    "before": int(block.words[0, max(depth - 1, 0)]),
                }
                for name, value in row.items():
                    columns[name].append(value)
            fixed = {"shard": shard, "block": number, "place": depth}
            taken = {"depth": base[starts] + depth, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved": saved}
            # Whether the first row's nodes may go on, and the last row's leaf be none.
            taken |= {"open": opened, "first": on_first & first, "last": on_last & last & bool(block.leaves[-1])}
            made = []
            for field in schema:
                if field.name in fixed:
                    made.append(pa.array([fixed[field.name]] * len(valid), field.type))
                elif field.name in taken:
                    made.append(pa.array(taken[field.name][valid], field.type))
                else:
                    made.append(pa.array(columns[field.name] or [None] * len(valid), field.type))
            yield pa.RecordBatch.from_arrays(made, schema=schema)
            above = (starts, lowest, opened)


# -- borders ------------------------------------------------------------------


def _borders(rows: DataFrame, width: int) -> DataFrame:
    """``shard, shared, shared_words, refuted``: how many turns the first row of
    a range has in common with the last row of the range before it (-1: not of one
    panel), their words, and whether the last row's leaf goes on in the next range.
    One row per range."""
    ends = rows.filter("at IN ('first', 'last')").groupBy("shard").pivot("at", ["first", "last"])
    ends = ends.agg(F.first(F.struct("prefix", "ids", "words")))
    order = Window.orderBy("shard")
    ends = ends.withColumn("past", F.lag("last").over(order))
    start = lambda row, k: F.substring(F.col(f"{row}.ids"), F.lit(1), 16 * k)
    same = F.filter(
        F.sequence(F.lit(1), F.lit(width)),
        lambda k: (F.octet_length(start("past", k)) == 16 * k) & (start("past", k) == start("first", k)),
    )
    shared = F.when(F.col("past.prefix") == F.col("first.prefix"), F.size(same)).otherwise(-1)
    ends = ends.select("shard", "first", "last", shared.alias("shared"))
    words = F.aggregate(F.slice("first.words", F.lit(1), F.greatest("shared", F.lit(0))), F.lit(0).cast("long"), lambda x, y: x + y)
    ahead = F.lead("shared").over(order)
    refuted = F.coalesce(ahead >= F.octet_length("last.ids") / 16, F.lit(False))
    return ends.select("shard", "shared", words.alias("shared_words"), refuted.alias("refuted"))


def _corrected_credits(rows: DataFrame, width: int) -> DataFrame:
    borders = _borders(rows, width)
    credits = rows.filter("conv_id IS NOT NULL").join(borders, "shard", "left")
    first, last = F.coalesce(F.col("at").contains("+first"), F.lit(False)), F.coalesce(F.col("at").contains("+last"), F.lit(False))
    new = F.col("new") - F.when(first, F.col("shared_words")).otherwise(0)
    refuted = last & F.col("refuted") & (F.col("leaves") > 0)
    return credits.select("conv_id", "panel", new.alias("new"), (F.col("leaves") - F.when(refuted, 1).otherwise(0)).alias("leaves"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, ends_sha256`` over the pieces of each key in order."""
    known, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array([known], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key != known:
                if known is not None:
                    yield told()
                known, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
    if known is not None:
        yield told()


def prefix_nodes(
    turns: DataFrame, totals: DataFrame, tables: Workspace, width: int = WIDTH, most: int = BLOCK
) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` of every node, from ``conv_id, depth, id, words``
    (depths from 1 without gaps) and ``conv_id, total``."""
    tables.save("nodes", _in_ranges(_panels(turns, totals, tables, width, most), _nodes, width, most, _NODES))
    rows = tables.load("nodes").filter("at IS NULL")
    parts = rows.filter("open").join(_borders(tables.load("nodes"), width), "shard", "left")
    over = F.col("first") & (F.col("block") == 0) & (F.col("place") <= F.col("shared"))
    kept: Column = F.col("n_convs") > 0
    parts = parts.withColumns(
        {
            "saved": F.col("saved") + F.when(over & kept, F.col("shared_words") - F.col("before")).otherwise(0),
            "n_children": F.col("n_children") - F.when(over & (F.col("place") < F.col("shared")), 1).otherwise(0),
            "n_leaves": F.col("n_leaves") - F.when(F.col("last") & F.col("refuted") & kept, 1).otherwise(0),
        }
    )
    merged = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent_key").alias("parent_key"),
        F.max("parent_conv").alias("parent_conv"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    tables.save("merged", merged)
    merged = tables.load("merged")
    pieces = rows.filter("open AND ends <> ''").select("key", "shard", "block", "ends")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "shard", "block")
    ends = pieces.mapInArrow(_hashed, "key binary, ends_sha256 string")
    named = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    stats = ["depth", "n_convs", "n_children", "n_leaves", "saved"]
    joined = merged.join(named, "parent_key", "left").join(ends, "key", "left")
    joined = joined.select("conv_id", *stats, F.coalesce("parent_conv", "parent").alias("parent"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends"))
    closed = rows.filter("NOT open")
    inner = closed.filter("parent_key IS NULL").select("conv_id", *stats, F.col("parent_conv").alias("parent"), "ends")
    # A parent is looked up once for each block that has it: no key has many rows.
    around = rows.filter("open").select("shard", "block", F.col("key").alias("parent_key")).distinct().join(named, "parent_key")
    outer = closed.filter("parent_key IS NOT NULL").join(around, ["shard", "block", "parent_key"]).select("conv_id", *stats, "parent", "ends")
    return joined.unionByName(inner).unionByName(outer).select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def prefix_trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    arranged=as_given,
    width: int = WIDTH,
    most: int = BLOCK,
) -> DataFrame:
    """Every node of the trie of ``conversations``, a row for each turn.

    ``conv_id`` names a node by the smallest conversation that begins with it, with
    its ``depth``; ``parent_conv_id`` is its parent's name, null for the root.
    ``n_convs`` conversations begin with it; it has ``n_children`` children and
    ``n_leaves`` childless nodes at or below it. ``saved_tokens`` is the sum, at and
    below it, of the words of each node's last turn times the conversations beyond
    the first; ``ends_sha256`` a digest of the ids, ascending and comma-joined, of
    the conversations that end here.

    Turns go by ``turn``, nulls first, equal ones by the digest of role and text.
    Null roles and texts count as empty, repeated rows as further turns, and rows
    without conv_id take no part. ``arranged`` may rearrange the numbered turns
    first; ``width`` turns make a panel and ``most`` rows a block, which decides on
    memory alone. An empty table gives an empty result; further columns are not looked at.
    """
    tables = Workspace(conversations.sparkSession, "prefixes")
    placed, spans = numbered_turns(conversations, tables, conv_id, turn, role, text)
    turns, totals = arranged(placed, spans)
    tables.save("totals", totals)
    return prefix_nodes(turns, tables.load("totals"), tables, width, most)
