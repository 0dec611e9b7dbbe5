"""Byte-level BPE of whole texts, encoded by a merge replay over many words at once.

A task gathers the distinct words of a batch of texts that it has not met yet
and lays them out as one chain of symbols. An index leads from the rank of a
token pair to the positions where that pair stands; the merges are replayed in
the order of their ranks, each at all its positions from left to right, and only
the two neighbours of a merged pair enter the index anew. Words met before come
from a bounded store, so a word is not replayed for each of its occurrences.
Nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words a task remembers, and the longest of them.
REMEMBERED = 300_000
REMEMBERED_LENGTH = 64
# Signs that may follow the letters of a word; none begins a contraction.
SIGNS = ".,!?;:*$%&#|()-\""
# Bytes of new words replayed together.
REPLAYED = 4 << 20

# A word can begin at a space that visible text follows, whatever the pattern
# says before it; all marks some library calls white space are left out.
_BREAK = re.compile(r"(?= [^\s\x1c-\x1f\x85])")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, a line each: base64, space, number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Numbers(dict):
    """Numbers of strings in the order they are first asked for."""

    def __init__(self) -> None:
        self.order: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self.order)
        self.order.append(key)
        return number


class Vocabulary:
    """Ranks and the pattern that cuts text into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys()))
        self.single = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        self.top = max(ranks.values(), default=0) + 1
        self.bytes_joined = np.full((256, 256), -1)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.bytes_joined[token[0], token[1]] = rank
        # Whether letters and signs are words of their own, with the space before them.
        self.plain = all(kind in pattern.split("|") for kind in (r" ?\p{L}+", r" ?[^\s\p{L}\p{N}]+"))
        self._words: dict[str, bytes] = {}
        self._chunks, self._ids = _Numbers(), []

    def _segments(self, token: np.ndarray, other: np.ndarray, rank: np.ndarray):
        """For a token, what it joins with on one side and the ranks of that."""
        order = np.lexsort((other, token))
        starts = np.searchsorted(token[order], np.arange(self.top + 1)).tolist()
        other, rank = other[order].astype(np.int32), rank[order].astype(np.int32)
        return lambda at: (other[starts[at] : starts[at + 1]], rank[starts[at] : starts[at + 1]])

    @cached_property
    def after_token(self):
        left, right, rank = self._joins
        return self._segments(left, right, rank)

    @cached_property
    def before_token(self):
        left, right, rank = self._joins
        return self._segments(right, left, rank)

    @cached_property
    def _joins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left token, right token and rank of all two tokens that make a token."""
        ranks = self.ranks
        found = [
            (left, right, rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None
        ]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word, all merges of a rank at a time."""
        if not words:
            return []
        lengths = np.array([len(word) for word in words])
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = len(raw)
        last = np.zeros(size, bool)
        last[ends[lengths > 0] - 1] = True
        places = np.arange(size, dtype=np.int32)
        after = np.where(last, -1, places + 1).astype(np.int32)
        before = np.where(np.concatenate(([True], last[:-1])), -1, places - 1).astype(np.int32)
        symbol = self.single[raw].astype(np.int32)
        rank = np.full(size, -1, np.int32)
        rank[:-1] = self.bytes_joined[raw[:-1], raw[1:]]
        rank[last] = -1
        odd: list[np.ndarray] = []
        low = 0
        while low < self.top:
            # Positions are indexed a range of ranks at a time; what merges bring
            # for later ranks waits in `rank` until its range comes.
            high = min(self.top, max(64, 2 * low) if low < 2048 else low + 2048)
            placed = np.flatnonzero((rank >= low) & (rank < high))
            low = high
            if not len(placed):
                continue
            listed = rank[placed]
            order = np.argsort(listed, kind="stable")
            placed, listed = placed[order], listed[order]
            cuts = np.flatnonzero(np.diff(listed)) + 1
            index = {int(rank[spots[0]]): [spots] for spots in np.split(placed, cuts)}
            heap = list(index)
            heapify(heap)
            while heap:
                now = heappop(heap)
                if (held := index.pop(now, None)) is not None:
                    self._merge(now, held, high, symbol, after, before, rank, index, heap, odd)
        stay = symbol >= 0
        kept = np.concatenate(([0], np.cumsum(stay)))[np.concatenate(([0], ends))]
        found = np.split(symbol[stay].astype("<u4"), kept[1:-1])
        # Where a merge opened one of lower rank, the rest of the word comes after that.
        for at in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")) if odd else ():
            found[at] = self._alone(words[at])
        return found

    def _merge(self, now, held, high, symbol, after, before, rank, index, heap, odd) -> None:
        """Merge the pairs of rank ``now`` at the positions ``held``, from left to
        right, and index their neighbours of ranks below ``high``."""
        spots = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        spots = spots[rank[spots] == now]
        if not len(spots):
            return
        gone = after[spots]
        touching = np.flatnonzero(gone[:-1] == spots[1:])
        if len(touching):
            free = np.ones(len(spots), bool)
            for at in touching.tolist():
                free[at + 1] = not free[at]
            spots, gone = spots[free], gone[free]
        follow = after[gone]
        inner = follow >= 0
        # What a merge meets before the next one of its word is done as well.
        met = np.where(inner, symbol[follow], -1)
        symbol[spots] = now
        symbol[gone] = -1
        rank[gone] = -1
        after[spots] = follow
        before[follow[inner]] = spots[inner]
        rank[spots] = -1
        back = before[spots]
        back = back[back >= 0]
        rank[back] = -1
        tokens, ranks = self.after_token(now)
        if len(early := tokens[ranks < now]):
            odd.append(spots[np.isin(met, early)])
        news = []
        for at, others, segment in ((spots[inner], follow[inner], self.after_token), (back, back, self.before_token)):
            tokens, ranks = segment(now)
            if len(tokens) and len(at):
                near = symbol[others]
                where = np.minimum(np.searchsorted(tokens, near), len(tokens) - 1)
                hit = tokens[where] == near
                if hit.any():
                    at, made = at[hit], ranks[where[hit]]
                    rank[at] = made
                    if (sooner := made < now).any():
                        odd.append(at[sooner])
                    if (soon := made < high).any():
                        news.append((at[soon], made[soon]))
        for at, made in news:
            order = np.argsort(made, kind="stable")
            at, made = at[order], made[order]
            cuts = np.flatnonzero(np.diff(made)) + 1
            for part, found in zip(np.split(at, cuts), made[np.concatenate(([0], cuts))].tolist()):
                if found in index:
                    index[found].append(part)
                else:
                    index[found] = [part]
                    heappush(heap, found)

    def _alone(self, word: bytes) -> np.ndarray:
        """Ids of one word, a merge at a time: the lowest rank first, then the
        leftmost."""
        part = [word[at : at + 1] for at in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        rank = [self.ranks.get(a + b, -1) for a, b in zip(part, part[1:])] + [-1]
        heap = [(found, at) for at, found in enumerate(rank) if found >= 0]
        heapify(heap)
        while heap:
            found, at = heappop(heap)
            if rank[at] != found:
                continue
            gone = after[at]
            part[at] += part[gone]
            part[gone], rank[gone], after[at] = b"", -1, after[gone]
            if after[at] < len(word):
                before[after[at]] = at
            for left, right in ((at, after[at]), (before[at], at)):
                if left >= 0:
                    rank[left] = self.ranks.get(part[left] + part[right], -1) if right < len(word) else -1
                    if rank[left] >= 0:
                        heappush(heap, (rank[left], left))
        return np.array([self.ranks[x] for x in part if x], "<u4")

    def _pieces(self, chunk: str) -> list[str]:
        """The words of a chunk. Letters with signs behind them, the common
        case, are told apart without the pattern."""
        letters = chunk.rstrip(SIGNS)
        if letters[letters[:1] == " " :].isalpha() and self.plain:
            return [letters, chunk[len(letters) :]] if len(letters) < len(chunk) else [letters]
        return self.pattern.findall(chunk)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks not met before."""
        if len(self._words) > REMEMBERED:
            self._words.clear()
        words = self._words
        pieces = [self._pieces(chunk) for chunk in chunks]
        new = list(set().union(*pieces).difference(words))
        words.update(zip(new, (ids.tobytes() for ids in self.replay([word.encode() for word in new]))))
        found = [b"".join([words[piece] for piece in listed]) for listed in pieces]
        for word in new:
            if len(word) > REMEMBERED_LENGTH:
                del words[word]
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        if len(self._ids) > REMEMBERED:
            self._chunks, self._ids = _Numbers(), []
        chunks, ids = self._chunks, self._ids
        cut = [list(map(chunks.__getitem__, _BREAK.split(text))) for text in texts]
        new = chunks.order[len(ids) :]
        for portion in self._portions(new):
            ids.extend(self._learn(portion))
        for numbers in cut:
            yield b"".join(map(ids.__getitem__, numbers))
        for number in range(len(ids) - len(new), len(ids)):
            if len(chunks.order[number]) > REMEMBERED_LENGTH:
                # What is long is not kept; its number is not used again.
                del chunks[chunks.order[number]]
                chunks.order[number], ids[number] = "", b""

    @staticmethod
    def _portions(chunks: list[str]) -> Iterator[list[str]]:
        start, size = 0, 0
        for at, chunk in enumerate(chunks):
            size += len(chunk)
            if size >= REPLAYED:
                yield chunks[start : at + 1]
                start, size = at + 1, 0
        yield chunks[start:]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(key: int, shared, pattern: str) -> Vocabulary:
    """One per Python worker, rank file and pattern."""
    if (key, pattern) not in _loaded:
        _loaded.clear()
        _loaded[key, pattern] = Vocabulary(shared.value, pattern)
    return _loaded[key, pattern]


def _sent(spark: SparkSession, path: str):
    """The ranks as a broadcast, and a number that tells them from others."""
    ranks = read_ranks(path)
    return hash(frozenset(ranks.items())), spark.sparkContext.broadcast(ranks)


def _slices(column: pa.Array, size: int = 1 << 21) -> Iterator[list]:
    """Values of a column, about ``size`` characters at a time."""
    held, length = [], 0
    for value in column:
        value = value.as_py()
        held.append(value)
        length += len(value)
        if length >= size:
            yield held
            held, length = [], 0
    if held:
        yield held


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row: the token ids of its whole text, as binary
    of little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file, read on the driver and sent around
    (its size does not depend on the input); ``pattern`` cuts text into words.
    A null text counts as empty and has no ids. Repeated rows and rows without
    doc_id are encoded like any other; other columns are not looked at.
    """
    key, shared = _sent(docs.sparkSession, ranks)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(key, shared, pattern)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text")):
                ids = pa.array(list(vocabulary.encode(texts)), pa.binary())
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), ids], ["doc_id", "ids"])
                at += len(texts)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` for rows ``doc_id, ids``: the bytes the ids stand for."""
    key, shared = _sent(encoded.sparkSession, ranks)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(key, shared, pattern)
        for batch in batches:
            texts = pa.array([vocabulary.decode(ids.as_py()) for ids in batch.column("ids")], pa.binary())
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, ids binary, decoded binary")
