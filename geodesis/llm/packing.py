"""Packing of tokenised documents into sequences, best fit in bounded space.

Tokens are counted first, next to the texts. Only the short rows of pieces are
then dealt out, in the order of a hash, to packers. A packer takes its pieces as
they come and keeps a fixed number of open sequences in a bitset keyed by their
free space: a piece goes where it leaves least room, which is the lowest bit at
or above its length. When a new sequence is needed and all places are taken, the
fullest open one is closed.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geodesis.workspace import Workspace

ROOM = 2048
END = 0
# Open sequences of a packer, and tokens dealt to one packer.
OPEN = 1024
TOKENS_PER_PACKER = 1 << 23
PACKERS = 20_000
# Words a task remembers, and the longest of them in bytes.
REMEMBERED = 400_000
REMEMBERED_LENGTH = 48
# Signs that may follow the letters of a word; none begins a contraction.
SIGNS = b".,!?;:*$%&#|()-\""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _byte_marks() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: visible
    ones for themselves, the others numbered from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {byte: 256 + k for k, byte in enumerate(sorted(set(range(256)) - set(visible)))}
    return [chr(others.get(byte, byte)) for byte in range(256)]


_MARKS = dict(enumerate(_byte_marks()))


class _Words(dict):
    """Ids by word, made when first asked for and remembered within bounds."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        made = self.make(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = made
        return made


class WordTokens:
    """Ids of texts for tokenizers that never join what white space parts.

    Words are remembered. Where the tokenizer lowers case and keeps runs of
    letters apart from other characters, so are the letters of a word: they go
    to the merges directly, whatever signs follow them.
    """

    def __init__(self, model: bytes) -> None:
        self.tokenizer = Tokenizer.from_buffer(model)
        self.merges = self.tokenizer.model
        self._words = _Words(self._word)
        self._letters: dict[bytes, bytes] = {}
        self._signs: dict[bytes, bytes] = {b"": b""}
        self.splits_letters = self._splits_letters(json.loads(model))

    @staticmethod
    def _splits_letters(settings: dict) -> bool:
        """Whether normalising is NFC, white space and lower case alone, and a run
        of letters and a run of signs are pieces of their own, taken as bytes."""
        steps = (settings.get("normalizer") or {}).get("normalizers", [])
        cuts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [step["type"] for step in steps] != ["NFC", "Replace", "Lowercase"] or [cut["type"] for cut in cuts] != ["Split", "ByteLevel"]:
            return False
        kinds = cuts[0]["pattern"].get("Regex", "").split("|")
        plain = not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
        signs = all(len(kind) in (2, 3) and kind[0] == "'" for kind in kinds[:-3])
        return plain and signs and kinds[-3:] == ["[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+"]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, marks: str) -> bytes:
        ids = [token.id for token in self.merges.tokenize(marks)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _signed(self, signs: bytes) -> bytes:
        found = self._signs.get(signs)
        if found is None:
            if len(self._signs) > REMEMBERED:
                self._signs = {b"": b""}
            found = self._signs[signs] = self._ids(signs.decode())
        return found

    def _word(self, word: bytes) -> bytes:
        letters = word.rstrip(SIGNS)
        if not self.splits_letters:
            return self._ids(word.decode())
        if letters.isalpha():
            low = marks = letters.lower()
        else:
            # Beyond these letters, composing and lower case are left to the tokenizer.
            text = letters.decode()
            marks = text.lower()
            if not text.isalpha() or max(text) >= "\u0250" or not marks.isalpha():
                return self._ids(word.decode())
            low = marks.encode()
        found = self._letters.get(low)
        if found is None:
            if len(self._letters) > REMEMBERED:
                self._letters.clear()
            found = self._letters[low] = self._merged(low.decode() if marks is low else low.decode("latin-1").translate(_MARKS))
        signs = word[len(letters) :]
        return found + self._signed(signs) if signs else found

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of UTF-8 texts as little-endian unsigned 32-bit integers."""
        known = self._words.__getitem__
        for text in texts:
            yield b"".join(map(known, text.split()))


_loaded: dict[int, WordTokens] = {}


def _tokens(key: int, shared) -> WordTokens:
    """One per Python worker and tokenizer."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordTokens(shared.value)
    return _loaded[key]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    room: int = ROOM,
    end: int = END,
    keep_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``
    (little-endian unsigned 32-bit) of the pieces of every document's tokens,
    the ``end`` id included. ``tokenizer`` is the path of a tokenizer file whose
    tokens never reach over white space; it is read on the driver."""
    with open(tokenizer, "rb") as file:
        content = file.read()
    key = zlib.crc32(content)
    shared = docs.sparkSession.sparkContext.broadcast(content)
    closing = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(key, shared)
        for batch in batches:
            at, size = 0, 0
            texts = []
            for k, value in enumerate(batch.column("text")):
                texts.append(value.as_py())
                size += len(texts[-1])
                if size >= 1 << 20 or k + 1 == len(batch):
                    yield pieces(batch.column("doc_id").slice(at, len(texts)), tokens.encode(texts))
                    at, size, texts = k + 1, 0, []

    def pieces(ids: pa.Array, encoded: Iterator[bytes]) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], [], []]
        for document, body in zip(ids.to_pylist(), encoded):
            body += closing
            for piece, start in enumerate(range(0, len(body), 4 * room)):
                part = body[start : start + 4 * room]
                row = (document, piece, start // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)
                for column, value in zip(columns, row):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    found = rows.mapInArrow(cut, PIECES)
    return found if keep_ids else found.drop("ids")


class Packer:
    """Sequences being filled. ``place`` gives number and offset for a piece."""

    def __init__(self, room: int, places: int) -> None:
        self.room, self.places = room, places
        self.free = 0  # bit f is set if an open sequence has f free
        self.open: dict[int, list[int]] = {}
        self.count = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        if length > self.room:
            raise ValueError(f"a piece of {length} does not fit into {self.room}")
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.count == self.places:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.room, self.made
            self.made += 1
        left = space - length
        if left:
            self.open.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.count += 1
        return number, self.room - space

    def _take(self, space: int) -> int:
        numbers = self.open[space]
        number = numbers.pop()
        if not numbers:
            del self.open[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return number


def pack(pieces: DataFrame, tokens: int, room: int = ROOM, places: int = OPEN) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``. ``tokens`` is the sum of their
    lengths and decides on the number of packers. Sequence ids are unique; a
    piece longer than ``room`` is an error."""
    packers = max(1, min(PACKERS, ceil(tokens / TOKENS_PER_PACKER)))
    names = pieces.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        packer = Packer(room, places)
        for batch in batches:
            placed = [packer.place(length) for length in batch.column("length").to_pylist()]
            numbers = pa.array([first + number for number, _ in placed], pa.int64())
            offsets = pa.array([offset for _, offset in placed], pa.int64())
            yield pa.record_batch([*batch.columns, numbers, offsets], [*names, "sequence_id", "offset"])

    # The order of arrival is fixed, so a packer that is run again packs alike.
    order = [F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32"]
    dealt = pieces.repartition(packers, "doc_id", "piece", "ids_crc32").sortWithinPartitions(*order)
    kinds = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    return dealt.mapInArrow(packed, f"{kinds}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    room: int = ROOM,
    places: int = OPEN,
    end: int = END,
    keep_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``:
    a row for each piece of every row of ``docs``.

    A null or empty text is the ``end`` id alone. Only documents longer than
    ``room`` are cut. Repeated rows are packed as often as they occur; rows
    without doc_id are packed with a null id; other columns are not looked at.
    An empty table gives an empty result.
    """
    tables = Workspace(docs.sparkSession, "packing")
    pieces = token_pieces(docs, tokenizer, room, end, keep_ids, doc_id, text)
    seen = tables.save("pieces", pieces, tokens=F.coalesce(F.sum("length"), F.lit(0)))
    return pack(tables.load("pieces"), seen["tokens"], room, places)
