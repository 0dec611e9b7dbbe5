"""Lines that recur across documents, found with a tree of line templates.

The tree has a fixed depth: a line goes down by its number of tokens and then by
its leading tokens, where a token with a digit counts as a variable field. At
the leaf the rest of the line is read as a fixed number of fields. A field value
that more than half of the leaf's different lines share is part of the leaf's
template; other fields vary. A line that agrees with the template in enough
fields belongs to it, any other line is a template of its own. Templates met in
two or more documents are dropped from all of them but the first.

With ``Tree.several`` a leaf has more templates than that of its majority: two
lines that agree in enough fields are of one template, whatever else is at the
leaf, and members of the leaf's template only go if they agree in enough fields
with its first one. Lines are gone through by their first document, so to speak: a line goes if
one like it stays in an earlier document, and stays otherwise. So every line that
goes has its like in what is left, also along chains of lines each of which is
only like the next. Rounds find this for all lines at once: in each, a line whose
earliest like is known to stay goes, and one without an earlier like stays.

Lines that may differ in ``d`` fields agree in one of ``d + 1`` groups of
fields, and meet in the cell of that group. Small cells compare their lines; in
large ones a line is summed under each key that leaves out ``d`` more fields, and
lines that agree in the others share a key. Either way finds the same lines. What
the leaf's template has taken meets no more.

A text is read where it lies and leaves one short row of hashes per line. Lines
are summed by their hash before anything else, so a very common one is a single
row wherever lines meet, and leaf majorities are keyed counts: no leaf is ever
held by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.workspace import Workspace

VARIABLE = b"<*>"
# Lines of a cell that are compared with each other; larger cells use keys.
CELL = 400
_DIGIT = re.compile(rb"[0-9]")


@dataclass(frozen=True)
class Tree:
    """Shape of the tree and what counts as the same template."""

    leading: int = 3
    """Tokens on the way to a leaf, after the number of tokens."""
    fields: int = 16
    """Fields of a line at a leaf; longer lines have several tokens in each."""
    similarity: float = 0.8
    """Least share of fields that agree with the leaf's template."""
    least_tokens: int = 4
    """Shorter lines are at no leaf; they only recur if they are exactly repeated."""
    least_points: int = 20
    """Code points from which on a line of few tokens counts like any other."""
    short_documents: int = 10
    """Least number of documents in which a shorter one recurs."""
    several: bool = False
    """Lines that agree in enough fields are a template also against a majority."""

    def spare(self, count: int) -> int:
        """How many of ``count`` fields may differ."""
        return count - int(-(-self.similarity * count // 1))

    def groups(self, count: int) -> list[range]:
        """Fields in one group more than may differ."""
        parts = self.spare(count) + 1
        return [range(count * k // parts, count * (k + 1) // parts) for k in range(parts)]


def line_keys(line: bytes, tree: Tree) -> tuple[int | None, int, list[int]] | None:
    """Hashes of a line's leaf, of the whole line, and of its fields; None for
    blank lines. Lines of few tokens are hashed as they are and have no leaf."""
    tokens = line.split()
    signed = lambda x: x - (x >> 63 << 64)
    if len(tokens) < tree.least_tokens:
        if not tokens:
            return None
        whole = b" ".join(tokens)
        # Very short ones are marked by the lowest bit.
        long = len(whole.decode()) >= tree.least_points
        return None, signed(xxhash.xxh64_intdigest(b"short " + whole) & ~1 | (not long)), []
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(token) else token for token in tokens]
    lead = b" ".join(tokens[: tree.leading])
    leaf = signed(xxhash.xxh64_intdigest(b"%d %s" % (len(tokens), lead)))
    whole = signed(xxhash.xxh64_intdigest(b" ".join(tokens)))
    rest = tokens[tree.leading :]
    count = min(tree.fields, len(rest))
    cuts = [len(rest) * k // count for k in range(count + 1)] if count else [0]
    fields = [xxhash.xxh32_intdigest(b" ".join(rest[a:b])) - (1 << 31) for a, b in zip(cuts, cuts[1:])]
    return leaf, whole, fields


def line_table(docs: DataFrame, tree: Tree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, body, line_no, leaf, line, fields`` of every line that is not
    blank; ``body`` is a hash of the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "body", "line_no", "leaf", "line", "fields"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for key, body, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), batch.column("text")):
                for number, line in enumerate(text.as_py().split(b"\n")):
                    found = line_keys(line, tree)
                    if found is not None:
                        for column, value in zip(columns, (key, body, number, *found)):
                            column.append(value)
                if len(columns[0]) >= 50_000:
                    yield pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds)], names)
                    columns = [[] for _ in names]
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds)], names)

    own = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), own.cast("binary").alias("text"), F.xxhash64(own).alias("body"))
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(read, "doc_id long, body long, line_no int, leaf long, line long, fields array<int>")


def _compared(tree: Tree):
    """``line, low, lead`` over the similar lines of each line, cell by cell: the
    first of them, by document and then by hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def found(rows: list) -> pa.RecordBatch:
            rows = sorted(rows, key=lambda row: (row[2], row[1]))
            line, low = (np.array([row[k] for row in rows], np.int64) for k in (1, 2))
            fields = np.array([row[3] for row in rows], np.int32)
            least = fields.shape[1] - tree.spare(fields.shape[1])
            same = (fields[:, None, :] == fields[None, :, :]).sum(axis=2, dtype=np.int16) >= least
            lead = same.argmax(axis=1)
            return pa.record_batch([pa.array(line), pa.array(low[lead]), pa.array(line[lead])], ["line", "low", "lead"])

        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("cell", "line", "low", "fields"))):
                if held and held[0][0] != row[0]:
                    yield found(held)
                    held = []
                held.append(row)
        if held:
            yield found(held)

    return read


@cache
def _choices(tree: Tree, count: int, group: int) -> np.ndarray:
    inside = tree.groups(count)[group]
    return np.array(list(combinations([k for k in range(count) if k not in inside], tree.spare(count))))


def _left_out(tree: Tree):
    """``key, line, low``: a key for every choice of fields outside the cell's
    group that a similar line may differ in."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, group, line, low, fields in zip(*(batch.column(name).to_pylist() for name in ("cell", "at", "line", "low", "fields"))):
                out = _choices(tree, len(fields), group)
                hashed = [xxhash.xxh64_intdigest(b"%d %d" % (k, field)) for k, field in enumerate(fields)]
                marks = [xxhash.xxh64_intdigest(b"%d out" % k) for k in range(len(fields))]
                gone = np.array(marks, np.uint64) - np.array(hashed, np.uint64)
                total = np.uint64((sum(hashed) + xxhash.xxh64_intdigest(b"%d" % cell)) % 2**64)
                keys = (total + gone[out].sum(axis=1, dtype=np.uint64)).view(np.int64)
                same = [pa.array(np.full(len(keys), value, np.int64)) for value in (line, low)]
                yield pa.record_batch([pa.array(keys), *same], ["key", "line", "low"])

    return read


def _leads(lines: DataFrame, tables: Workspace, tree: Tree) -> DataFrame:
    """``line, first``, the first similar line of each as ``low, line``, for the
    lines that have others at their leaf in a cell."""
    count = F.size("fields")
    cells = F.lit(None).cast("array<struct<at:int,cell:bigint>>")
    for n in range(1, tree.fields + 1):
        if tree.spare(n) > 0:
            made = [
                F.struct(F.lit(k).alias("at"), F.xxhash64("leaf", F.lit(k), F.slice("fields", g.start + 1, len(g))).alias("cell"))
                for k, g in enumerate(tree.groups(n))
            ]
            cells = F.when(count == n, F.array(*made)).otherwise(cells)
    dealt = lines.select("line", F.explode(cells).alias("to")).select("line", "to.at", "to.cell")
    tables.save("dealt", dealt)
    crowded = tables.load("dealt").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tables.save("crowded", crowded)
    met = tables.load("dealt").join(tables.load("crowded"), "cell").join(lines.select("line", "low", "fields"), "line")
    tables.save("met", met.select("cell", "at", "n", "line", "low", "fields"))
    tables.drop("dealt", "crowded")
    few = tables.load("met").filter(F.col("n") <= CELL).repartition("cell").sortWithinPartitions("cell")
    many = tables.load("met").filter(F.col("n") > CELL)
    tables.save("keys", many.mapInArrow(_left_out(tree), "key long, line long, low long"))
    keys = tables.load("keys")
    firsts = keys.groupBy("key").agg(F.min(F.struct("low", "line")).alias("first"))
    told = keys.select("key", "line").join(firsts, "key").select("line", "first")
    near = few.mapInArrow(_compared(tree), "line long, low long, lead long")
    near = near.select("line", F.struct("low", F.col("lead").alias("line")).alias("first"))
    tables.save("leads", told.unionByName(near).groupBy("line").agg(F.min("first").alias("first")))
    tables.drop("met", "keys")
    return tables.load("leads")


def _similar_lines(lines: DataFrame, tables: Workspace, tree: Tree) -> DataFrame:
    """``line, low, first`` of lines that go because one like them stays in
    document ``first``, from ``line, low, leaf, fields, stays``."""
    tables.save("alive_0", lines.withColumn("settled", F.col("stays")))
    gone, done = None, 0
    while True:
        alive = tables.load(f"alive_{done}")
        leads = _leads(alive, tables, tree)
        # A line that meets no other is its own first; lines of one document are no likes.
        open_lines = alive.filter("NOT settled").join(leads, "line", "left")
        own = F.struct("low", "line")
        tables.save("asked", open_lines.select("line", "low", F.coalesce("first", own).alias("first")))
        asked = tables.load("asked")
        staying = alive.filter("settled").select("line").unionByName(asked.filter("first.low = low").select("line"))
        told = asked.filter("first.low < low").join(staying.select(F.col("line").alias("lead")), F.col("first.line") == F.col("lead"), "left_semi")
        name = f"gone_{done}"
        lost = tables.save(name, told.select("line", "low", F.col("first.low").alias("first")))["rows"]
        gone = tables.load(name) if gone is None else gone.unionByName(tables.load(name))
        tables.save("staying", staying)
        left = alive.drop("settled").join(tables.load(name).select("line"), "line", "left_anti")
        left = left.join(tables.load("staying").withColumn("settled", F.lit(True)), "line", "left")
        left = left.withColumn("settled", F.coalesce("settled", F.lit(False)))
        rest = left.filter("NOT settled").select("leaf").distinct()
        done += 1
        tables.save(f"alive_{done}", left.join(rest, "leaf", "left_semi"))
        tables.drop(f"alive_{done - 1}", "leads", "asked", "staying")
        if not lost or not tables.rows(f"alive_{done}"):
            tables.drop(f"alive_{done}")
            return gone


def recurring_lines(
    docs: DataFrame, tree: Tree = Tree(), doc_id: str = "doc_id", text: str = "text", parts: DataFrame | None = None
) -> DataFrame:
    """``doc_id, body, line_nos``: for every text that loses lines, which ones;
    ``body`` is a hash of the text. With ``parts``, ``doc_id, part``, documents of
    one part count as one document."""
    tables = Workspace(docs.sparkSession, "templates")
    read = line_table(docs, tree, doc_id, text)
    if parts is None:
        read = read.withColumn("part", F.col("doc_id"))
    else:
        named = parts.groupBy("doc_id").agg(F.min("part").alias("part"))
        read = read.join(named, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    tables.save("read", read)
    read = tables.load("read")
    lines = read.groupBy("line").agg(
        F.min("part").alias("low"),
        F.max("part").alias("high"),
        F.first("leaf").alias("leaf"),
        F.first("fields").alias("fields"),
    )
    tables.save("lines", lines)
    lines = tables.load("lines")
    leaves = lines.filter("leaf IS NOT NULL").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tables.save("leaves", leaves)

    # Only leaves with several different lines have a template of their own.
    shared = lines.join(tables.load("leaves"), "leaf")
    values = shared.select("leaf", "n", F.posexplode("fields").alias("at", "value"))
    major = values.groupBy("leaf", "at", "value").agg(F.count(F.lit(1)).alias("held"), F.first("n").alias("n"))
    major = major.filter(2 * F.col("held") > F.col("n"))
    # At most one value holds a majority, so at most `fields` rows per leaf.
    made = major.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("template"))
    tables.save("made", made)
    spot = lambda value, at: F.when(F.try_element_at("template", at) == value, 1).otherwise(0)
    agreed = F.aggregate(F.transform("fields", spot), F.lit(0), lambda acc, x: acc + x)
    members = (
        lines.join(tables.load("made"), "leaf")
        .filter(F.size("fields") > 0)
        .filter(agreed >= F.ceil(F.lit(tree.similarity) * F.size("fields")))
        .select("line", "leaf", "low", "high", "fields")
    )
    if tree.several:
        # The first member stands for the template: those that are not like it stay apart.
        stands = members.groupBy("leaf").agg(F.min(F.struct("low", "line", "fields")).alias("stand"))
        alike = F.zip_with("fields", "stand.fields", lambda x, y: F.when(x == y, 1).otherwise(0))
        alike = F.aggregate(alike, F.lit(0), lambda acc, x: acc + x)
        members = members.join(stands, "leaf").filter(alike >= F.ceil(F.lit(tree.similarity) * F.size("fields")))
    tables.save("members", members.select("line", "leaf", "low", "high"))
    members = tables.load("members")
    spans = members.groupBy("leaf").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last")
    tables.save("spans", spans)
    tables.save("general", members.join(tables.load("spans"), "leaf").select("line", "low", "first"))
    general = tables.load("general")
    tables.drop("made", "members", "spans")
    # A line is dropped on the strength of its leaf's template, of itself, or of a similar line.
    literal = lines.filter("low < high").filter("leaf IS NOT NULL OR line % 2 = 0").select("line", F.col("low").alias("first"))
    found = general.select("line", "first").unionByName(literal)
    # Very short lines need more documents.
    short = read.filter("leaf IS NULL AND line % 2 <> 0").select("line", "part").distinct()
    short = short.groupBy("line").agg(F.min("part").alias("first"), F.count(F.lit(1)).alias("n"))
    found = found.unionByName(short.filter(F.col("n") >= tree.short_documents).select("line", "first"))
    if tree.several:
        # What a template has taken is out; the lines that stand for it stay.
        taken = general.select("line", (F.col("low") == F.col("first")).alias("stays"))
        alive = lines.join(tables.load("leaves").select("leaf"), "leaf").join(taken, "line", "left")
        alive = alive.filter("stays IS NULL OR stays").select("line", "low", "leaf", "fields", F.coalesce("stays", F.lit(False)).alias("stays"))
        found = found.unionByName(_similar_lines(alive, tables, tree).select("line", "first"))
    recurring = found.groupBy("line").agg(F.min("first").alias("first"))
    tables.save("recurring", recurring)
    lost = read.select("doc_id", "part", "body", "line_no", "line").join(tables.load("recurring"), "line").filter("part <> first")
    tables.save("lost", lost.groupBy("doc_id", "body").agg(F.collect_set("line_no").alias("line_nos")))
    tables.drop("read", "lines", "leaves", "general", "recurring")
    return tables.load("lost")


def drop_recurring_lines(
    docs: DataFrame,
    tree: Tree = Tree(),
    doc_id: str = "doc_id",
    text: str = "text",
    count: str | None = None,
    drop_emptied: bool = False,
    keep_short: bool = False,
    parts: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text`` in
    all documents but the first (the smallest doc_id) that has the template;
    with ``count``, a further column of that name tells how many of them went.

    Lines are parted by ``\\n``; the rest stay as they are and in order. Lines of
    fewer than ``least_tokens`` tokens only go as exact repeats: found in two
    documents if they have ``least_points`` code points, otherwise in
    ``short_documents``. If only lines shorter than ``least_tokens`` would be left,
    the document says nothing of its own: its text is empty, or the row goes with
    ``drop_emptied``. With ``keep_short`` these lines stay like any other, and that
    holds only if no line with a visible character is left. Lines within one
    document do not recur; with ``parts`` (``doc_id, part``), neither do lines
    within the documents of one part, such as a document and its near copies, and
    the part with the smallest number is the first. Null texts, rows without doc_id
    and other columns are returned as they are; rows that repeat a doc_id count as
    one document, and each loses the lines found in its own text. An empty table
    gives an empty result.
    """
    lost = recurring_lines(docs, tree, doc_id, text, parts)
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`").cast("string")).alias("body"),
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
    )
    body = F.col("row").getField(text)
    joined = rows.join(lost, ["doc_id", "body"], "left")
    joined = joined.withColumn("kept", F.when(F.col("line_nos").isNotNull(), _without(F.split(body, "\n"), F.col("line_nos"))))
    tokens = lambda line: F.size(F.array_remove(F.split(line, "[\\x20\\x09-\\x0D]+"), ""))
    least = 1 if keep_short else tree.least_tokens
    own = F.exists("kept", lambda line: tokens(line) >= least)
    fresh = F.when(F.col("line_nos").isNull(), body).when(own, F.array_join("kept", "\n")).otherwise("")
    columns = [(fresh if name == text else F.col("row").getField(name)).alias(name) for name in docs.columns]
    if count:
        columns.append(F.coalesce(F.size("line_nos"), F.lit(0)).alias(count))
    if drop_emptied:
        joined = joined.filter(F.col("line_nos").isNull() | own)
    return joined.select(*columns)


def _without(parts, numbers):
    """The elements of an array but for those at ``numbers``, in linear time:
    every number and every place is tagged, sorted together, and what stands
    alone stays."""
    places = F.transform(parts, lambda part, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), part.alias("part")))
    gone = F.transform(numbers, lambda i: F.struct(i.alias("i"), F.lit(0).alias("kind"), F.lit("").alias("part")))
    order = F.sort_array(F.concat(gone, places))
    size = F.size(order)
    before = F.concat(F.slice(order, 1, F.lit(1)), F.slice(order, 1, F.greatest(size - 1, F.lit(0))))
    flagged = F.zip_with(order, before, lambda x, y: F.struct(x["part"].alias("part"), ((x["kind"] == 1) & ((x["i"] != y["i"]) | (y["kind"] == 1))).alias("stays")))
    return F.transform(F.filter(flagged, lambda x: x["stays"]), lambda x: x["part"])
