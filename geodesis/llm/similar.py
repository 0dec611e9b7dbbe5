"""Near-duplicate documents by the share of word shingles they have in common.

Two documents are linked if the Jaccard similarity of their sets of shingles (of
five lower-cased words) is at least 80 percent, and linked documents form
components. Every such link is checked on the sets themselves; only where to look is
left to minimum hashes. Of ``BANDS`` bands of ``ROWS`` minima each, a pair at the
bound shares at least one but for 1 in 8 million, whatever the size of the corpus.

Documents with equal sets are one class from the start. In each bucket (band and
its minima) all classes are first held against the smallest; links are checked and
merged. Where a bucket then still holds several components, its classes meet with
their sets in one task, or, if they are many, in a task for each pair of salts. A
sketch of a byte for each minimum tells which of them are likely to be similar, and
these are checked there, likeliest first, unless they hang together by then. So no
pair is ever written: a large group of near copies gives at most one link for each
class and cell, whether its classes are similar or not quite.
A pair at the bound looks unlikely to its sketches (``LIKELY``) in 1 of 5,000 cases.
Sets are made again for those classes alone that share a bucket.

To drop near duplicates, SimHash comes first: fingerprints of the same shingles, as
``simhash`` takes them, are joined in its tries, and documents that differ in as few
bits as it allows are linked, whatever their sets. Every fingerprint takes part, also
where texts with equal sets repeat their shingles differently. The minima then link
what more bits part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.llm import simhash
from geodesis.operators.merging import smallest_reachable
from geodesis.workspace import Workspace

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 40, 5
SEED = 42
# Shingles whose hashes are permuted at once.
SHINGLES = 1 << 10
# Least share of equal minima for a pair to be checked, in percent.
LIKELY = 70
# Classes of a cell; crowded buckets are dealt out over more cells.
CELL = 2_000
# Shingles that half of a cell may hold, and partners that are checked at once.
ROOM = 4_000_000
CHECKED = 64
# Ids that go to the rows they are looked for in; with more, both are shuffled.
FEW = 2_000_000

_pick = np.random.default_rng(SEED)
_FACTORS = _pick.integers(0, 2**31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _pick.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The set of hashed word shingles, sorted; a text with fewer words is one
    shingle, a text without words has none."""
    hashed = xxhash.xxh64_intdigest
    words = np.array([hashed(word, SEED) for word in (text or b"").lower().split()], np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    found = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        found = found * _BASE + words[k : k + len(found)]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(32)
    return np.unique(found)


def minima(found: np.ndarray) -> np.ndarray:
    """The least of each permutation; ``found`` is not empty."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), SHINGLES):
        np.minimum(least, (_FACTORS * short[at : at + SHINGLES] + _SHIFTS).min(axis=1), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """One hash of the minima of each band."""
    bands = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        bands = (bands + column) * _BASE
        bands ^= bands >> np.uint64(29)
    return bands.view(np.int64)


def sketches(rows: DataFrame, width: int = WIDTH, printed: bool = False) -> DataFrame:
    """``doc_id, whole, size, bands, sketch, bits`` of every row of ``doc_id, text``:
    a hash of the set, its size, the hash of each band and a byte of each minimum
    (none for an empty set), and the fingerprint if ``printed``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, size, bands, sketch, bits = [], [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), width)
                whole.append(xxhash.xxh64_intdigest(found.tobytes()))
                size.append(len(found))
                least = minima(found) if len(found) else None
                bands.append([] if least is None else bands_of(least))
                sketch.append(b"" if least is None else least.astype(np.uint8).tobytes())
                bits.append(simhash.fingerprint(text.as_py(), width) if printed else 0)
            columns = [batch.column("doc_id"), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(size, pa.int32())]
            columns += [pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            columns.append(pa.array(np.array(bits, np.uint64).view(np.int64)))
            yield pa.record_batch(columns, ["doc_id", "whole", "size", "bands", "sketch", "bits"])

    return rows.mapInArrow(read, "doc_id long, whole long, size int, bands array<long>, sketch binary, bits long")


def sets(rows: DataFrame, width: int = WIDTH, packed: bool = False) -> DataFrame:
    """``doc_id, whole, found``: the set of every row of ``doc_id, text``, as bytes
    if ``packed``."""
    kind = pa.binary() if packed else pa.list_(pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(text.as_py(), width) for text in batch.column("text")]
            whole = np.array([xxhash.xxh64_intdigest(found.tobytes()) for found in made], np.uint64).view(np.int64)
            found = pa.array([x.tobytes() if packed else x.view(np.int64) for x in made], kind)
            yield pa.record_batch([batch.column("doc_id"), pa.array(whole), found], ["doc_id", "whole", "found"])

    return rows.mapInArrow(read, f"doc_id long, whole long, found {'binary' if packed else 'array<long>'}")


def _among(rows: DataFrame, ids: DataFrame, count: int, how: str = "left_semi") -> DataFrame:
    """The rows whose id is one of ``ids``, a table of one column with ``count`` rows.
    So many texts or sets stay where they lie for few ids."""
    return rows.join(F.broadcast(ids) if count <= FEW else ids, ids.columns, how)


def _sets_of(wanted: DataFrame, count: int, rows: DataFrame, width: int, packed: bool = False) -> DataFrame:
    """``whole, found`` of the ``count`` classes ``doc_id, whole`` that are wanted."""
    # A doc_id may stand for several texts: the hash of the set tells which one is meant.
    made = sets(_among(rows, wanted.select("doc_id").distinct(), count), width, packed)
    return _among(made, wanted.select("whole"), count).dropDuplicates(["whole"]).select("whole", "found")


def _links(pairs: DataFrame, rows: DataFrame, tables: Workspace, label: str, width: int, percent: int) -> DataFrame:
    """The ``src, dst`` of ``pairs`` (of classes, by hash) that are similar enough."""
    tables.save(f"{label}_pairs", pairs)
    pairs = tables.load(f"{label}_pairs")
    classes = tables.load("classes").select("whole", F.col("rep").alias("doc_id"))
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("whole")).distinct().join(classes, "whole")
    count = tables.save(f"{label}_wanted", wanted)["rows"]
    tables.save(f"{label}_sets", _sets_of(tables.load(f"{label}_wanted"), count, rows, width))
    of = lambda name: tables.load(f"{label}_sets").select(F.col("whole").alias(name), F.col("found").alias(f"{name}_set"))
    both = pairs.join(of("src"), "src").join(of("dst"), "dst")
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    united = F.size("src_set") + F.size("dst_set") - shared
    tables.save(f"{label}_links", both.filter(100 * shared >= percent * united).select("src", "dst"))
    tables.drop(f"{label}_pairs", f"{label}_wanted", f"{label}_sets")
    return tables.load(f"{label}_links")


def _linked(percent: int):
    """``src, dst`` of classes that meet in a cell and are similar enough, as many as
    it takes to join what hangs together there."""

    def linked(rows: list[tuple]) -> list[tuple[int, int]]:
        whole, size, label, salt = (np.array([row[k] for row in rows], np.int64) for k in (1, 2, 3, 4))
        sketch = np.frombuffer(b"".join(row[6] for row in rows), np.uint8).reshape(len(rows), -1)
        found = [np.frombuffer(row[8], np.uint64) for row in rows]
        # A pair is checked in the first band it shares, and one of a salt with itself apart.
        bands, inner = np.array([row[7] for row in rows]), len(np.unique(salt)) == 1
        earlier = bands[:, : rows[0][5]]
        names, counts = np.unique(label, return_counts=True)
        asking = np.flatnonzero(label != names[counts.argmax()])
        links = []
        for at in range(0, len(asking), 32):
            own = asking[at : at + 32]
            equal = (sketch[own, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.int16)
            fits = 100 * equal.astype(np.int64) >= LIKELY * sketch.shape[1]
            # No pair whose sizes are too far apart can be similar enough.
            fits &= 100 * np.minimum(size[own, None], size[None, :]) >= percent * np.maximum(size[own, None], size[None, :])
            if not inner:
                fits &= salt[own, None] != salt[None, :]
            for k, row in enumerate(own):
                others = np.flatnonzero(fits[k] & (label != label[row]) & ~(earlier[row] == earlier).any(axis=1))
                others = others[np.argsort(-equal[k, others], kind="stable")]
                while len(others := others[label[others] != label[row]]):
                    some, others = others[:CHECKED], others[CHECKED:]
                    joined = np.concatenate([found[other] for other in some])
                    place = np.minimum(np.searchsorted(found[row], joined), size[row] - 1)
                    starts = np.cumsum(size[some]) - size[some]
                    shared = np.add.reduceat((found[row][place] == joined).astype(np.int64), starts)
                    for other in some[100 * shared >= percent * (size[row] + size[some] - shared)]:
                        if label[other] != label[row]:
                            links.append(tuple(sorted((int(whole[row]), int(whole[other])))))
                            label[label == label[other]] = label[row]
        return links

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*linked(rows))) or [(), ()]
            return pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["src", "dst"])

        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("cell", "whole", "size", "part", "salt", "band", "sketch", "bands", "found"))):
                if held and held[0][0] != row[0]:
                    yield told(held)
                    held = []
                held.append(row)
        if held:
            yield told(held)

    return read


def _cells(members: DataFrame, merged: DataFrame) -> DataFrame:
    """``cell, whole, size, part, salt, band`` of the buckets that hold several
    components. Any two classes of a bucket share a cell."""
    parted = members.select("band", "value", "whole", "size").join(merged, "whole", "left")
    parted = parted.withColumn("part", F.coalesce("part", "whole"))
    told = [F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("held")]
    mixed = parted.groupBy("band", "value").agg(*told).filter("low < high")
    salts = F.ceil(F.greatest(F.col("n") / (CELL // 2), F.col("held") / ROOM)).cast("int")
    mixed = mixed.select("band", "value", salts.alias("salts"))
    rows = parted.join(mixed, ["band", "value"])
    salt = F.pmod(F.xxhash64("whole"), F.col("salts")).cast("int")
    rows = rows.withColumn("salt", salt).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cell = F.xxhash64("band", "value", F.least("salt", "other"), F.greatest("salt", "other"))
    return rows.select(cell.alias("cell"), "whole", "size", "part", "salt", "band")


def similar_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    printed: bool = False,
) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs`` with a doc_id.

    ``component_id`` is the smallest doc_id reachable over links. Null and
    wordless texts are copies of each other, and so are texts with the same set.
    An empty table gives an empty result; further columns are not looked at. With
    ``printed``, documents that SimHash links are linked too.
    """
    tables = Workspace(docs.sparkSession, "similar")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.filter("doc_id IS NOT NULL")
    tables.save("sketches", sketches(rows, width, printed))
    read = tables.load("sketches")
    of_class = [F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")]
    tables.save("classes", read.groupBy("whole").agg(*of_class))
    if printed:
        # Fingerprints count repeats, sets do not: a class may have several.
        tables.save("printed", read.select("whole", "bits").distinct())
    # Of the sketches, only what is returned is held any longer.
    tables.save("texts", read.select("doc_id", "whole"))
    read = tables.load("texts")
    tables.drop("sketches")
    dealt = tables.load("classes").select("whole", "size", F.posexplode("bands").alias("band", "value"))
    crowded = dealt.groupBy("band", "value").agg(F.min("whole").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    tables.save("crowded", crowded)
    tables.save("members", dealt.join(tables.load("crowded"), ["band", "value"]).select("band", "value", "low", "whole", "size"))
    members = tables.load("members")
    tables.drop("crowded")

    stars = members.filter("low <> whole").select(F.col("low").alias("src"), F.col("whole").alias("dst")).distinct()
    if printed:
        tables.save("printed_links", _printed(tables))
        tables.drop("printed", "prints", "sizes")
        # What is linked already needs no check.
        stars = stars.join(tables.load("printed_links"), ["src", "dst"], "left_anti")
    near = _links(stars, rows, tables, "star", width, percent)
    if printed:
        near = near.unionByName(tables.load("printed_links"))
    merging = Workspace(docs.sparkSession, "similar")
    merged = smallest_reachable(near, merging)
    parted = merged.select(F.col("node").alias("whole"), F.col("component").alias("part"))
    cells = tables.save("cells", _cells(members, parted))["rows"]
    tables.drop("members")
    if cells:
        count = tables.save("wanted", tables.load("cells").select("whole").distinct())["rows"]
        wanted = _among(tables.load("classes"), tables.load("wanted"), count)
        tables.save("mixed", wanted.select("whole", F.col("rep").alias("doc_id"), "sketch", "bands"))
        tables.drop("wanted")
        mixed = tables.load("mixed")
        tables.save("mixed_sets", _sets_of(mixed.select("doc_id", "whole"), count, rows, width, packed=True))
        known = mixed.select("whole", "sketch", "bands").join(tables.load("mixed_sets"), "whole")
        dealt = tables.load("cells").join(known, "whole").repartition("cell").sortWithinPartitions("cell")
        if tables.save("cell_links", dealt.mapInArrow(_linked(percent), "src long, dst long").distinct())["rows"]:
            # What hangs together only changes where links were found.
            merging.discard()
            merging = Workspace(docs.sparkSession, "similar")
            merged = smallest_reachable(near.unionByName(tables.load("cell_links")), merging)
        tables.drop("mixed", "mixed_sets")

    classes = tables.load("classes").join(merged.withColumnRenamed("node", "whole"), "whole", "left")
    classes = classes.select("whole", "rep", F.coalesce("component", "whole").alias("part"))
    tables.save("named", classes)
    tables.drop("classes", "cells", "star_links", "printed_links", "cell_links")
    merging.discard()
    lowest = tables.load("named").groupBy("part").agg(F.min("rep").alias("component_id"))
    tables.save("components", tables.load("named").join(lowest, "part").select("whole", "component_id"))
    tables.drop("named")
    return read.join(tables.load("components"), "whole").select("doc_id", "component_id")


def _printed(tables: Workspace) -> DataFrame:
    """``src, dst`` of classes that hang together by any of their fingerprints, each
    with one that it hangs together with."""
    classes = tables.load("printed")
    tables.save("prints", classes.groupBy("bits").agg(F.min("whole").alias("rep")))
    prints = tables.load("prints")
    same = classes.join(prints, "bits").select(F.col("rep").alias("src"), F.col("whole").alias("dst"))
    apart = simhash.links(prints, tables, simhash.BITS)
    found = same.unionByName(apart).filter("src <> dst")
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, of which the doc_id names its component;
    rows without doc_id stay. Rows that share a doc_id stay or go together. Documents
    are near duplicates if SimHash links them or their sets are similar enough."""
    found = similar_documents(docs, doc_id, text, printed=True, **options)
    lost = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    tables = Workspace(docs.sparkSession, "similar")
    count = tables.save("lost", lost)["rows"]
    return _among(docs, tables.load("lost"), count, "left_anti").select(*docs.columns)
