"""Token counts under a unigram model, by dynamic programming over a shared trie.

White space parts a text into pre-tokens, each with a mark for the space before
it. A task inserts the different pre-tokens it meets into a trie. A node holds
the best score of any division of its prefix into vocabulary pieces and how many
pieces that takes, worked out from the nodes above it when the node is made. So
a prefix that many pre-tokens share is scored once, and a pre-token that ends at
a node reads its count there. The trie lives in the task and is begun anew when
it has grown to a bound; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import inf, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

SPACE = "▁"
NODES = 600_000
# Longer pre-tokens share nothing worth keeping.
SHARED_LENGTH = 256


def piece_scores(model: bytes) -> dict[str, float]:
    """Log-probabilities of the pieces of a model file. The file ranks its
    pieces by how common they are; the n-th is given a share of 1/n."""
    pieces = SentencePieceProcessor(model_proto=model)
    listed = [
        pieces.id_to_piece(k)
        for k in range(pieces.get_piece_size())
        if not (pieces.is_control(k) or pieces.is_unknown(k) or pieces.is_byte(k) or pieces.is_unused(k))
    ]
    total = log(sum(1 / (k + 1) for k in range(len(listed))))
    return {piece: -log(k + 1) - total for k, piece in enumerate(listed)}


class Trie:
    """Prefixes of pre-tokens with their best score and its number of pieces.

    A node also keeps the places from where to here a piece may still be under
    way; only these are looked at when a node is added below it.
    """

    def __init__(self, scores: dict[str, float], nodes: int = NODES) -> None:
        self.limit = nodes
        # What has no piece goes as bytes, each worse than any piece.
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.begun = {piece[:size]: -inf for piece in scores for size in range(1, len(piece))} | scores
        self._clear()

    def _clear(self) -> None:
        self.below: dict[int, int] = {}
        self.score, self.pieces, self.open = [0.0], [0], [()]
        self.ends: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of the best division of a word, with the mark for the space
        before it: highest score, then fewest."""
        known = self.ends.get(word)
        if known is not None:
            return known
        token = SPACE + word.decode()
        if len(token) > SHARED_LENGTH:
            return self._alone(token)
        if len(self.score) > self.limit:
            self._clear()
        below, score, pieces, opened = self.below, self.score, self.pieces, self.open
        node, path = 0, [0]
        for at, mark in enumerate(token):
            step = node << 21 | ord(mark)
            follow = below.get(step)
            if follow is None:
                follow = below[step] = len(score)
                best, fewest, alive = self._forward(token, at, score[node], pieces[node], opened[node], path, score, pieces)
                score.append(best)
                pieces.append(fewest)
                opened.append(alive)
            node = follow
            path.append(node)
        self.ends[word] = pieces[node]
        return pieces[node]

    def _forward(self, token, at, best, fewest, alive, path, score, pieces) -> tuple[float, int, tuple[int, ...]]:
        """Score, pieces and open places of the prefix up to ``at``, from those
        of shorter ones; ``path`` has their places in ``score`` and ``pieces``."""
        width = len(token[at].encode())
        best, fewest = best + width * self.byte, fewest + width
        begun, still = self.begun, []
        for start in (*alive, at):
            worth = begun.get(token[start : at + 1])
            if worth is not None:
                still.append(start)
                before = path[start]
                whole = score[before] + worth
                if whole > best or (whole == best and pieces[before] < fewest - 1):
                    best, fewest = whole, pieces[before] + 1
        return best, fewest, tuple(still)

    def _alone(self, token: str) -> int:
        """The count of a pre-token of any length, by itself."""
        score, pieces, alive, path = [0.0], [0], (), range(len(token) + 1)
        for at in range(len(token)):
            best, fewest, alive = self._forward(token, at, score[at], pieces[at], alive, path, score, pieces)
            score.append(best)
            pieces.append(fewest)
        return pieces[-1]


_loaded: dict[int, Trie] = {}


def _trie(key: int, shared) -> Trie:
    """One per Python worker and vocabulary."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Trie(shared.value)
    return _loaded[key]


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` for every row of ``docs``.

    ``model`` is the path of a piece vocabulary, read on the driver. Pre-tokens
    are parted by space, tab, line feed, vertical tab, form feed and return. A
    null or empty text has none. Characters without a piece count as their
    UTF-8 bytes. Repeated rows and rows without doc_id are counted like any
    other; other columns are not looked at; an empty table gives an empty
    result.
    """
    with open(model, "rb") as file:
        content = file.read()
    key = zlib.crc32(content)
    shared = docs.sparkSession.sparkContext.broadcast(piece_scores(content))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(key, shared)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                found = Counter((text.as_py() or b"").split())
                words.append(found.total())
                known = trie.ends
                counts = [(times, known.get(word) or trie.count(word)) for word, times in found.items()]
                tokens.append(sum(times * count for times, count in counts))
            columns = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.record_batch(columns, ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_words long, n_tokens long")
