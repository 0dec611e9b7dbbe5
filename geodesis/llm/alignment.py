"""Alignment of the tokens of two tokenizers, and how common their pairs are.

Both tokenizers run over a text where it lies. The ends of their tokens, as byte
offsets, are two sorted lists. The texts at hand are laid end to end, so that
there is one pair of lists whatever the lengths of texts, and the merging of the
two is cut into pieces of equal work: piece ``k`` begins where the first ``k *
STEP`` ends of the merged order are done, a place that binary searches along the
diagonals of the merge find without merging. A piece is merged by itself. Each
different end in it closes one stretch of bytes that lies in one token of either
side, and so tells one overlapping pair; an end of both sides closes a group. Token
numbers run on over all pieces, which stitches groups that reach over their
borders.

Each text leaves its numbers and a compact list of its different pairs. Pairs are
summed in the tasks, then by a shuffle. Common ones, at most ``COMMON`` of them, are
broadcast and looked up where the lists lie; rarer ones meet their counts in a
join, where none of them has many rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from geodesis.llm.packing import _byte_marks
from geodesis.workspace import Workspace

# Ends that a piece of a merge has, and bytes of texts that are aligned at once.
STEP = 1 << 14
CHUNK = 1 << 20
# Pairs with their counts that are broadcast, and that a task sums at once.
COMMON = 1 << 20
SUMMED = 1 << 22
# Parts of texts a task remembers, twice over, and the longest of them.
REMEMBERED = 250_000
REMEMBERED_LENGTH = 48
# A space amid white space belongs to no part alone.
_AROUND = re.compile(r"\s \s")

_OWN = "doc_id {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


# -- tokens -------------------------------------------------------------------


class TokenPair:
    """A byte-level tokenizer (A) and one of pieces (B), and the bytes of their
    tokens. A reads a text with a space before it, which B adds by itself.

    Where neither joins anything over a single space, the parts between spaces are
    tokenised once and remembered, each with the space before it. Other texts,
    such as those with several spaces in a row, are tokenised whole.
    """

    def __init__(self, level: bytes, pieces: bytes) -> None:
        self.a = Tokenizer.from_buffer(level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        byte = {mark: bytes([k]) for k, mark in enumerate(_byte_marks())}
        shown = lambda entry: b"".join(byte.get(x) or x.encode() for x in entry)
        self.bytes_a = [shown(self.a.id_to_token(k) or "") for k in range(self.a.get_vocab_size())]
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Ids after each of the signs that may stand before them.
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        self.names = [f"{sign}{k}" for sign in ",;|" for k in range(self.most)]
        settings = json.loads(level)
        cut = settings["pre_tokenizer"] or {}
        by_words = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not settings["normalizer"]
        listed = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.parted = by_words and not any("▁" in piece.lstrip("▁") for piece in listed)
        self._parts: dict[str, tuple[bytes, bytes] | None] = {}
        self._older: dict[str, tuple[bytes, bytes] | None] = {}

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    @property
    def pairs(self) -> int:
        """How many pairs of ids there are."""
        return len(self.bytes_a) * len(self.bytes_b)

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides as little-endian unsigned 32-bit integers; None where
        either side's bytes are not those of the text with a space before it."""
        spaced = [" " + text for text in texts]
        lines = [line.encode() for line in spaced]
        left = [found.ids for found in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        right = self.b.encode(texts, num_threads=1)
        line, sizes = b"".join(lines), np.fromiter(map(len, lines), np.int64)
        cuts, packed, shown, same = [], [], [], np.ones(len(texts), bool)
        for ids, parts, widths in ((left, self.bytes_a, self.size_a), (right, self.bytes_b, self.size_b)):
            flat = np.fromiter(chain.from_iterable(ids), "<u4")
            cut = np.append(0, np.fromiter(map(len, ids), np.int64).cumsum())
            ends = np.append(0, widths[flat].cumsum())[cut]
            same &= np.diff(ends) == sizes
            shown.append(b"".join(map(parts.__getitem__, flat.tolist())))
            cuts.append((4 * cut).tolist())
            packed.append(flat.tobytes())
        if not (same.all() and shown[0] == shown[1] == line):
            for k in range(len(texts)):
                same[k] = all(b"".join(map(parts.__getitem__, ids[k])) == lines[k] for ids, parts in ((left, self.bytes_a), (right, self.bytes_b)))
        (a, b), (cut_a, cut_b) = packed, cuts
        return [(a[cut_a[k] : cut_a[k + 1]], b[cut_b[k] : cut_b[k + 1]]) if same[k] else None for k in range(len(texts))]

    def _cut(self, text: str) -> list[str] | None:
        """The parts between single spaces, None for a text to be taken whole."""
        parts = text.split(" ") if self.parted else [""]
        return None if "" in parts or _AROUND.search(text) else parts

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none where either side's bytes are not those of the
        text with a space before it."""
        if len(self._parts) > REMEMBERED:
            self._older, self._parts = self._parts, {}
        known, older = self._parts, self._older
        cut = [self._cut(text) if text else None for text in texts]
        new = set().union(*(parts for parts in cut if parts)).difference(known)
        # What is met again outlives the others.
        known.update({part: older[part] for part in new.intersection(older)})
        new = list(new.difference(known))
        known.update(zip(new, self._whole(new)))
        found = []
        for text, parts in zip(texts, cut):
            own = list(map(known.__getitem__, parts)) if parts else [None]
            if None in own:
                own = self._whole([text]) if text else [None]
            sides = [b"".join([part[side] for part in own if part]) for side in (0, 1)]
            found.append(tuple(np.frombuffer(side, "<u4") for side in sides))
        for part in new:
            if len(part) > REMEMBERED_LENGTH:
                del known[part]
        return found


# -- merging ------------------------------------------------------------------


def diagonal_cuts(a: np.ndarray, b: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """How many of the ends ``a`` and ``b`` come before each piece of a merge, and
    at last how many there are. Equal ends fall into one piece."""
    total = len(a) + len(b)
    at = np.arange(0, total, step)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        more = low < high
        # Of equal ends, that of `a` comes first.
        first = more.copy()
        first[more] = a[middle[more]] <= b[at[more] - middle[more] - 1]
        low = np.where(first, middle + 1, low)
        high = np.where(more & ~first, middle, high)
    other = at - low
    inside = (low > 0) & (other < len(b))
    other[inside] += a[low[inside] - 1] == b[other[inside]]
    return np.append(low, len(a)), np.append(other, len(b))


def _piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different ends in order, the tokens they lie in, and which are ends of both."""
    merged = np.sort(np.concatenate((a, b)), kind="stable")
    again = np.zeros(len(merged), bool)
    again[1:] = merged[1:] == merged[:-1]
    last = np.append(~again[1:], True) if len(merged) else again
    ends = merged[last]
    return ends, np.searchsorted(a, ends), np.searchsorted(b, ends), again[last]


def overlaps(a: np.ndarray, b: np.ndarray, step: int = STEP) -> tuple[np.ndarray, ...]:
    """``end, token of a, token of b, whether both end here`` of every overlap of
    two rows of tokens over the same bytes, given by their strictly rising ends."""
    left, right = diagonal_cuts(a, b, step)
    found = []
    for i, j, p, q in zip(left[:-1], right[:-1], left[1:], right[1:]):
        ends, x, y, both = _piece(a[i:p], b[j:q])
        found.append((ends, x + i, y + j, both))
    if not found:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*found))


def aligned_texts(tokens: TokenPair, texts: list[str | None], step: int = STEP) -> Iterator[tuple]:
    """``n_a, n_b, n_groups, n_links, groups, pairs, times`` of each text:
    ``groups`` like ``a1,a2|b1;a3|b2,b3``, the different ``pairs`` of ids that
    overlap as ``a * len(b) + b`` in order, and how often each does."""
    encoded = tokens.encode(texts)
    a, b = (np.concatenate([row[side] for row in encoded]).astype(np.int64) for side in (0, 1))
    ends_a, ends_b = tokens.size_a[a].cumsum(), tokens.size_b[b].cumsum()
    ends, at_a, at_b, both = overlaps(ends_a, ends_b, step)
    counts = [np.array([len(row[side]) for row in encoded], np.int64) for side in (0, 1)]
    stops = np.concatenate(([0], ends_a))[counts[0].cumsum()]
    # Texts without tokens have no bytes here, so ends before a stop are its own.
    text_of = np.searchsorted(stops, ends)
    keys, times = np.unique(text_of * tokens.pairs + a[at_a] * len(tokens.bytes_b) + b[at_b], return_counts=True)
    links = np.bincount(text_of, minlength=len(texts))
    groups = np.bincount(text_of[both], minlength=len(texts))
    cut = np.searchsorted(keys, np.arange(len(texts) + 1) * tokens.pairs)
    # Written out, each group's tokens of A stand before those of B.
    to_a, to_b = (np.append(0, at[both] + 1) for at in (at_a, at_b))
    group_a, group_b = (np.repeat(np.arange(len(to) - 1), np.diff(to)) for to in (to_a, to_b))
    line = np.empty(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + to_b[group_a]] = a
    line[np.arange(len(b)) + to_a[group_b + 1]] = b
    line[to_a[:-1] + to_b[:-1]] += tokens.most
    line[to_a[1:] + to_b[:-1]] += 2 * tokens.most
    name = tokens.names.__getitem__
    written = np.append(0, (counts[0] + counts[1]).cumsum())
    for k in range(len(texts)):
        shown = "".join(map(name, line[written[k] : written[k + 1]].tolist()))[1:]
        own = slice(cut[k], cut[k + 1])
        yield int(counts[0][k]), int(counts[1][k]), int(groups[k]), int(links[k]), shown, keys[own] - k * tokens.pairs, times[own]


# -- over a table -------------------------------------------------------------


_loaded: dict[tuple[int, int], TokenPair] = {}


def _tokens(key: tuple[int, int], shared) -> TokenPair:
    """One per Python worker and pair of tokenizers."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TokenPair(*shared.value)
    return _loaded[key]


def _reader(key: tuple[int, int], shared, keep_groups: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(key, shared)
        kind = np.dtype("<u4" if tokens.pairs < 1 << 32 else "<u8")

        def made(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            rows = []
            for *numbers, groups, pairs, times in aligned_texts(tokens, texts):
                digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                steps = np.diff(pairs, prepend=0).astype(kind).tobytes()
                rows.append((*numbers, digest, steps, times.astype("<u4").tobytes(), groups if keep_groups else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups"]
            return pa.record_batch([ids, *[pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]], names)

        for batch in batches:
            at, size, texts = 0, 0, []
            for k, value in enumerate(batch.column("text")):
                texts.append(value.as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK or k + 1 == len(batch):
                    yield made(batch.column("doc_id").slice(at, len(texts)), texts)
                    at, size, texts = k + 1, 0, []

    return read


def _pairs_of(row_pairs: bytes, width: int) -> np.ndarray:
    return np.frombuffer(row_pairs, f"<u{width}").cumsum(dtype=np.int64)


def _summed(width: int):
    """``pair, n``: in how many rows of lists each pair is, task by task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            keys, at = np.unique(np.concatenate((known, *waiting)), return_inverse=True)
            weights = np.concatenate((counts, np.ones(len(at) - len(counts), np.int64)))
            summed = np.zeros(len(keys), np.int64)
            np.add.at(summed, at, weights)
            return keys, summed

        def told() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(known), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.record_batch([pa.array(known[part]), pa.array(counts[part])], ["pair", "n"])

        for batch in batches:
            for value in batch.column("pairs"):
                waiting.append(_pairs_of(value.as_py(), width))
                held += len(waiting[-1])
                if held >= SUMMED:
                    known, counts = merged()
                    waiting, held = [], 0
                    if len(known) >= SUMMED:
                        yield from told()
                        known, counts = known[:0], counts[:0]
        known, counts = merged()
        yield from told()

    return read


def _looked_up(names: list[str], width: int, size_b: int, shared):
    """Rows with what their common pairs add, and the pairs that are not common."""
    pairs, counts, best = shared

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, most = pairs.value, counts.value, best.value
        for batch in batches:
            n_best, count_sum, rare, rare_times = [], [], [], []
            for row, often in zip(batch.column("pairs"), batch.column("times")):
                own = _pairs_of(row.as_py(), width)
                times = np.frombuffer(often.as_py(), "<u4").astype(np.int64)
                at = np.searchsorted(known, own)
                found = np.zeros(len(own), bool)
                if len(known):
                    found = known[np.minimum(at, len(known) - 1)] == own
                count = n[at[found]]
                n_best.append(int(times[found][count == most[own[found] // size_b]].sum()))
                count_sum.append(int((times[found] * count).sum()))
                rare.append(own[~found])
                rare_times.append(times[~found])
            told = [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            told += [pa.array(x, pa.list_(pa.int64())) for x in (rare, rare_times)]
            kept = [batch.column(name) for name in names]
            yield pa.record_batch([*kept, *told], [*names, "n_best", "count_sum", "rare", "rare_times"])

    return read


def align_tokens(
    docs: DataFrame, level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", keep_groups: bool = False
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[,
    groups]`` for every row of ``docs``.

    ``level`` and ``pieces`` are the paths of a byte-level tokenizer (A) and of a
    piece model (B), read on the driver. Groups end where tokens of both end.
    Links are pairs of an A and a B token that share bytes. A pair of ids counts in
    how many rows it is linked; ``n_best`` of a row's links have the highest count
    of their A id, ties included, and ``count_sum`` adds up the counts of all.

    Null and empty texts, and texts that either tokenizer does not give back byte
    by byte, have no tokens: zeros and an empty ``groups_sha256``. Long texts are
    aligned whole. Repeated rows and rows without doc_id count like any other;
    further columns are not looked at; an empty table gives an empty result.
    """
    content = []
    for path in (level, pieces):
        with open(path, "rb") as file:
            content.append(file.read())
    spark = docs.sparkSession
    tokens = TokenPair(*content)
    size_a, size_b, width = len(tokens.bytes_a), len(tokens.bytes_b), 4 if tokens.pairs < 1 << 32 else 8
    key = (zlib.crc32(content[0]), zlib.crc32(content[1]))
    tables = Workspace(spark, "alignment")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    own = _OWN.format(key=rows.schema["doc_id"].dataType.simpleString())
    read = rows.mapInArrow(_reader(key, spark.sparkContext.broadcast(content), keep_groups), f"{own}, pairs binary, times binary, groups string")
    tables.save("aligned", read.withColumn("mark", F.monotonically_increasing_id()))
    aligned = tables.load("aligned")

    summed = aligned.select("pairs").mapInArrow(_summed(width), "pair long, n long")
    tables.save("counts", summed.groupBy("pair").agg(F.sum("n").alias("n")))
    counts = tables.load("counts")
    side_a = F.expr(f"pair div {size_b}")
    # One row per A id at most.
    tables.save("best", counts.groupBy(side_a.alias("a")).agg(F.max("n").alias("most")))
    best = np.zeros(size_a, np.int64)
    for row in tables.load("best").collect():
        best[row["a"]] = row["most"]
    # Counts by their number of bits: the lowest from which on all are common.
    bits = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    number, least = 0, 65
    for row in sorted(bits, key=lambda row: -row["bits"]):
        number += row["pairs"]
        if number > COMMON:
            break
        least = row["bits"]
    common = counts.filter(F.length(F.bin("n")) >= least).toArrow()
    order = np.argsort(common["pair"].to_numpy())
    shared = [spark.sparkContext.broadcast(x) for x in (common["pair"].to_numpy()[order], common["n"].to_numpy()[order], best)]

    names = [name for name in aligned.columns if name not in ("pairs", "times")]
    looked = aligned.mapInArrow(
        _looked_up(names, width, size_b, shared),
        f"{own}, groups string, mark long, n_best long, count_sum long, rare array<long>, rare_times array<long>",
    )
    tables.save("looked", looked)
    tables.drop("aligned")
    looked = tables.load("looked")
    rare = looked.select("mark", F.explode(F.arrays_zip("rare", "rare_times")).alias("at")).select("mark", "at.*")
    rare = rare.withColumnRenamed("rare", "pair").join(counts, "pair")
    rare = rare.join(F.broadcast(tables.load("best")), side_a == F.col("a"))
    added = rare.groupBy("mark").agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("rare_times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("rare_times") * F.col("n")).alias("more_sum"),
    )
    if number > COMMON:
        looked = looked.join(added, "mark", "left")
    else:
        looked = looked.withColumns({"more_best": F.lit(0), "more_sum": F.lit(0)})
    return looked.select(
        "doc_id",
        *["n_a", "n_b", "n_groups", "n_links"],
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
        *(["groups"] if keep_groups else []),
    )
