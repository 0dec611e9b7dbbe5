"""Near-duplicate documents by SimHash and a binary-trie self-join.

A fingerprint of 64 bits is taken of every whole text. Fingerprints that differ
in at most ``bits`` bits are linked, and linked documents form components.

The join: with ``bits + 1`` blocks of a fingerprint, two linked fingerprints
agree in one block at least. For every block the fingerprints are dealt out by
its value, which is the top of a trie whose first levels are that block; below
it, pairs of trie nodes are walked down together, adding up differing bits, and
a pair is left as soon as it has more than ``bits``. A task keeps only which
fingerprints hang together, never the pairs, so a cell with many close
fingerprints gives one row each. Cells above a bound are split into smaller
cells of salts ``(i, j)``; each pair of fingerprints still meets in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.operators.merging import smallest_reachable
from geodesis.workspace import Workspace

WIDTH = 3
BITS = 3
SEED = 42
# A cell with more fingerprints than this, and than HOT times the mean, is split.
CELL = 1_000
CELL_MOST = 20_000
HOT = 4
# Shingles whose bits are counted at once, and node pairs walked at once.
SHINGLES = 1 << 15
PAIRS = 1 << 18


# -- fingerprints -------------------------------------------------------------


def fingerprint(text: str | bytes | None, width: int = WIDTH) -> int:
    """SimHash of one text: a bit is set if over half the hashes of its word
    shingles have it; zero for a text without words."""
    if isinstance(text, str):
        text = text.encode()
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    ends = ends[width - 1 :]
    line = b" ".join(words)
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES):
        spans = zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist())
        hashes = np.array([hashed(line[a:b]) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, bits``: a row for every row of ``docs``, bits as signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column("text")), np.uint64, len(batch))
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "bits"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, bits long")


# -- the walk over node pairs -------------------------------------------------


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the sets of ``u[i]`` and ``v[i]``; ``label`` holds the smallest
    member of every element's set before and after."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def hanging_together(codes: np.ndarray, starts: np.ndarray, shared: int, bits: int) -> np.ndarray:
    """For every code the position of the first code it hangs together with.

    ``codes`` are sorted, different and agree in their ``shared`` leading bits
    within each cell; cells begin at ``starts``.
    """
    label = np.arange(len(codes))
    zeros: dict[int, np.ndarray] = {}

    def middle(depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the second child of the nodes ``low..high`` begins."""
        if depth not in zeros:
            clear = (codes >> np.uint64(63 - depth)) & np.uint64(1) == 0
            zeros[depth] = np.concatenate(([0], np.cumsum(clear)))
        return low + zeros[depth][high] - zeros[depth][low]

    ends = np.append(starts[1:], len(codes))
    wide = ends - starts > 1
    low, high = starts[wide], ends[wide]
    stack = [(shared, low, high, low, high, np.zeros(len(low), np.int8))]
    while stack:
        depth, *nodes = stack.pop()
        if len(nodes[0]) > PAIRS:
            for at in range(0, len(nodes[0]), PAIRS):
                stack.append((depth, *(x[at : at + PAIRS] for x in nodes)))
            continue
        a, a_end, b, b_end, differ = nodes
        leaves = (a_end - a == 1) & (b_end - b == 1)
        if leaves.any():
            u, v = a[leaves], b[leaves]
            near = np.bitwise_count(codes[u] ^ codes[v]) <= bits
            _join(label, u[near], v[near])
            a, a_end, b, b_end, differ = (x[~leaves] for x in nodes)
        if not len(a) or depth == 64:
            continue
        a_mid, b_mid = middle(depth, a, a_end), middle(depth, b, b_end)
        same = a == b
        children = [
            (a, a_mid, b, b_mid, differ, None),
            (a_mid, a_end, b_mid, b_end, differ, None),
            (a, a_mid, b_mid, b_end, differ + 1, differ < bits),
            (a_mid, a_end, b, b_mid, differ + 1, (differ < bits) & ~same),
        ]
        parts = []
        for x, x_end, y, y_end, more, allowed in children:
            go = (x_end > x) & (y_end > y) & ~((x == y) & (x_end - x == 1))
            go = go if allowed is None else go & allowed
            parts.append([z[go] for z in (x, x_end, y, y_end, more)])
        joined = [np.concatenate(z) for z in zip(*parts)]
        if len(joined[0]):
            stack.append((depth + 1, *joined))
    return label


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of whole cells, a good many at a time; cells arrive in one piece."""
    held: list[dict[str, np.ndarray]] = []
    rows = 0

    def taken() -> dict[str, np.ndarray]:
        return {name: np.concatenate([x[name] for x in held]) for name in held[0]}

    for batch in batches:
        if not len(batch):
            continue
        part = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        held.append(part)
        rows += len(batch)
        if rows < CELL_MOST:
            continue
        table = taken()
        cut = int(np.searchsorted(_cell_numbers(table), _cell_numbers(table)[-1]))
        if cut:
            yield {name: x[:cut] for name, x in table.items()}
        held = [{name: x[cut:] for name, x in table.items()}]
        rows = len(held[0]["bits"])
    if held:
        yield taken()


def _cell_numbers(table: dict[str, np.ndarray]) -> np.ndarray:
    """0, 0, 1, 2, 2, ...: one number for each run of equal keys."""
    keys = [table[name] for name in ("block", "value", "i", "j")]
    changes = np.zeros(len(keys[0]), bool)
    for key in keys:
        changes[1:] |= key[1:] != key[:-1]
    return np.cumsum(changes)


def _trie_join(blocks: int, bits: int):
    step = 64 // blocks

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            cells = _cell_numbers(table)
            codes = table["bits"].view(np.uint64)
            turn = (table["block"].astype(np.uint64) * np.uint64(step)) % np.uint64(64)
            back = (np.uint64(64) - turn) % np.uint64(64)
            turned = np.where(turn == 0, codes, (codes << turn) | (codes >> back))
            order = np.lexsort((turned, cells))
            turned, cells, rep = turned[order], cells[order], table["rep"][order]
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            label = hanging_together(turned, starts, step, bits)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.record_batch([pa.array(rep[moved]), pa.array(rep[label[moved]])], ["src", "dst"])

    return joined


def links(classes: DataFrame, tables: Workspace, bits: int) -> DataFrame:
    """``src, dst``: enough links between class representatives to keep together
    what hangs together. ``classes`` is ``bits, rep``."""
    blocks = bits + 1
    step = 64 // blocks
    value = lambda b: F.shiftrightunsigned(F.shiftleft("bits", b * step), 64 - step)
    dealt = classes.select(
        "bits",
        "rep",
        F.explode(F.array(*[F.struct(F.lit(b).alias("block"), value(b).alias("value")) for b in range(blocks)])).alias("at"),
    ).select("bits", "rep", "at.block", "at.value")
    tables.save("sizes", dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = tables.load("sizes")
    mean = sizes.agg(F.avg("n")).first()[0] or 0
    most = int(min(max(CELL, HOT * mean), CELL_MOST))
    # At most blocks * 2**step sizes exist, and at most rows / most are above.
    hot = sizes.filter(F.col("n") > most).select("block", "value", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    salted = (
        dealt.join(hot if step > 20 else F.broadcast(hot), ["block", "value"], "left")
        .withColumn("salt", F.pmod(F.xxhash64("bits"), salts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), salts - 1)))
        .select(
            "block",
            "value",
            F.least("salt", "other").alias("i"),
            F.greatest("salt", "other").alias("j"),
            "bits",
            "rep",
        )
    )
    keys = ["block", "value", "i", "j"]
    cells = salted.repartition(*keys).sortWithinPartitions(*keys)
    return cells.mapInArrow(_trie_join(blocks, bits), "src long, dst long").distinct()


# Older name of the call.
_links = links


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, bits: int = BITS
) -> DataFrame:
    """``doc_id, bits, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included. A null or wordless text has fingerprint zero and is linked like
    any other. Repeated rows are copies of each other. A row without doc_id
    carries no links: it gets the component of documents with its fingerprint,
    or null if there are none. An empty table gives an empty result; further
    columns are not looked at.
    """
    if not 0 <= bits < 16:
        raise ValueError("bits must lie in 0..15")
    tables = Workspace(docs.sparkSession, "simhash")
    tables.save("prints", fingerprints(docs, doc_id, text, width))
    prints = tables.load("prints")
    tables.save("classes", prints.filter("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("rep")))
    classes = tables.load("classes")
    tables.save("links", links(classes, tables, bits))
    merged = smallest_reachable(tables.load("links"), tables)
    named = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    tables.save("named", named.select("bits", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(tables.load("named"), "bits", "left").select("doc_id", "bits", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, of which the doc_id names its component;
    rows without doc_id stay. Rows that share a doc_id stay or go together."""
    found = near_duplicates(docs, doc_id, text, **options)
    lost = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(lost, doc_id, "left_anti").select(*docs.columns)
