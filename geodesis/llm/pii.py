"""Personal data in texts, plain or disguised, at its place in the source.

Plain identifiers are found in the text as it stands. For disguised ones the
text goes through transducers, each of which rewrites some spots and knows for
every character it puts out which source characters it came from: look-alike
characters, digits spelled out in words, and words or brackets that stand for
``@`` and ``.``. The same finders then read the normalised text, and what they
find is mapped back to the source. Only texts that hold a sign of a disguise are
normalised, which is seen without the transducers. Each text is worked on where it lies; nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# -- plain identifiers --------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield "email", start, free
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[Span]:
    """Four numbers at a time of every dotted run."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(short := part.lstrip("0")) <= 3 and int(short or "0") <= 255 for part in four):
                yield "ip", start, end
            start = end + 1


def _checks_out(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for found in _NUMBER.finditer(text):
        if found.end() - found.start() < 13:
            continue
        digits = found.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _checks_out(digits):
            yield "card", found.start(), found.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(found.group())) <= 15:
                yield "phone", found.start(), found.end()


def plain(text: str) -> list[Span]:
    """Identifiers of a text as it stands, by kind and then by place."""
    found = list(emails(text))
    if _DIGITS.search(text):
        for finder in (addresses, cards, phones):
            found.extend(finder(text))
    return found


# -- transducers --------------------------------------------------------------

# Characters that look like another one.
_LOOKALIKES = dict(
    zip("АВЕЅІЈКМНОРСТХУавеѕіјкмнорстхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABESIJKMHOPCTXYabesijkmhopctxyABEZHIKMNOPTYXovp")
)
_LOOKALIKES |= {"․": ".", "。": ".", "．": ".", "·": ".", "•": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-"}
_LOOKALIKES |= {mark: " " for mark in "      　"}
# Words for the digits from zero to nine in four languages.
_DIGIT_WORDS = {
    word: str(digit)
    for language in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(language.split())
} | {"oh": "0"}
# Words for the signs in four languages.
_AT_WORDS = "at|arroba|arobase|klammeraffe"
_DOT_WORDS = "dot|punkt|punto|point"
# Common endings of host names.
_ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|eu|us|uk|ca|au|nz|ie|de|at|ch|fr|be|es|it|pt|nl|lu|dk|se|no|fi|pl|cz|ru|ua|gr|tr|in|cn|jp|kr|br|mx|ar|cl"


# Characters that show nothing, soft hyphens among them.
_HIDDEN_MARKS = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _table() -> dict[int, str]:
    """Look-alikes, digits of other scripts, full-width ASCII, and letters and
    digits that are only another style of a plain one."""
    table = {ord(a): b for a, b in _LOOKALIKES.items()}
    table |= {0xFF01 + k: chr(0x21 + k) for k in range(0x5E)}
    for code in range(0x0660, 0x1E95A):
        if unicodedata.decimal(chr(code), None) is not None and code not in table:
            table[code] = str(unicodedata.decimal(chr(code)))
    for code in range(0x2100, 0x1FBFA):
        kind, _, plain_code = unicodedata.decomposition(chr(code)).partition(" ")
        if kind == "<font>" and " " not in plain_code and 0x21 <= int(plain_code, 16) < 0x7F:
            table.setdefault(code, chr(int(plain_code, 16)))
    return table


_TABLE = _table()
_STRANGE = re.compile("[" + re.escape("".join(map(chr, _TABLE)) + _HIDDEN_MARKS) + "]")
_HIDDEN = re.compile(f"[{_HIDDEN_MARKS}]")
_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ ]+)?{_WORD}(?:[ -]{{1,3}}{_WORD})+(?!\w)", re.I)
_ONE_WORD = re.compile(rf"plus|{_WORD}", re.I)
_AT_BRACKET = re.compile(rf"[ ]{{0,3}}{_OPEN}[ ]{{0,3}}(?:{_AT_WORDS}|@)[ ]{{0,3}}{_CLOSE}[ ]{{0,3}}", re.I)
_DOT_BRACKET = re.compile(rf"[ ]{{0,3}}{_OPEN}[ ]{{0,3}}(?:{_DOT_WORDS}|\.)[ ]{{0,3}}{_CLOSE}[ ]{{0,3}}", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_DOT_SPOT = rf"(?:[ ]+(?:{_DOT_WORDS})[ ]+|[ ]{{0,3}}{_OPEN}[ ]{{0,3}}(?:{_DOT_WORDS}|\.)[ ]{{0,3}}{_CLOSE}[ ]{{0,3}})"
# A bare word only stands for @ before a disguised dot and a common ending.
_AT_WORD = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])[ ]+(?:{_AT_WORDS})[ ]+"
    rf"(?={_LABEL}(?:\.{_LABEL}){{0,9}}{_DOT_SPOT}(?:{_LABEL}(?:\.|{_DOT_SPOT})){{0,9}}(?:{_ENDINGS})(?![A-Za-z0-9-]))",
    re.I,
)
_DOT_WORD = re.compile(rf"(?<=[A-Za-z0-9-])[ ]+(?:{_DOT_WORDS})[ ]+(?=[A-Za-z0-9])", re.I)
# The same with underscores for spaces.
_AT_UNDER = re.compile(
    rf"(?<=[A-Za-z0-9])_(?:{_AT_WORDS})_(?={_LABEL}(?:(?:\.|_(?:{_DOT_WORDS})_){_LABEL}){{0,9}}_(?:{_DOT_WORDS})_(?:{_ENDINGS})(?![A-Za-z0-9-]))",
    re.I,
)
_DOT_UNDER = re.compile(rf"(?<=[A-Za-z0-9-])_(?:{_DOT_WORDS})_(?=[A-Za-z0-9])", re.I)
_GAP = re.compile(r"\s")
_SIGN = re.compile(rf"{_OPEN}[ ]{{0,3}}(?:{_AT_WORDS}|{_DOT_WORDS}|[@.])[ ]{{0,3}}{_CLOSE}|[ ](?:{_DOT_WORDS})[ ]|(?<!\w){_WORD}[ -]{{1,3}}{_WORD}(?!\w)|_(?:{_DOT_WORDS})_", re.I)
_BRACKET_SIGN = re.compile(rf"{_OPEN}[ ]{{0,3}}(?:{_AT_WORDS}|{_DOT_WORDS}|[@.])[ ]{{0,3}}{_CLOSE}", re.I)


# Texts of the first 256 characters are looked through as bytes: in lower case,
# with spaces for all that is no part of a word.
def _bare(code: int) -> int:
    low = chr(code).lower()
    return ord(low) if (low.isalnum() or low == "_") and len(low) == 1 and ord(low) < 256 else ord(" ")


_BARE = bytes(map(_bare, range(256)))
_STRANGE_BYTES = [bytes([code]) for code in {*_TABLE, *map(ord, _HIDDEN_MARKS)} if code < 256]
_CUES = frozenset(word.encode("latin-1") for word in (*_DIGIT_WORDS, *_DOT_WORDS.split("|")))
_UNDER_CUES = [f"_{word}_".encode() for word in _DOT_WORDS.split("|")]


def signs(text: str) -> tuple[bool, bool]:
    """Whether a text holds characters to be replaced, and whether it holds a
    sign of words or brackets that stand for something else."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return _STRANGE.search(text) is not None, _SIGN.search(text) is not None
    strange = any(mark in raw for mark in _STRANGE_BYTES)
    if any(mark in raw for mark in (b"(", b"[", b"{", b"<")) and _BRACKET_SIGN.search(text):
        return strange, True
    bare = raw.translate(_BARE)
    if _CUES.isdisjoint(bare.split()) and not any(cue in bare for cue in _UNDER_CUES):
        return strange, False
    return strange, _SIGN.search(text) is not None


class Normalised:
    """A text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray) -> None:
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, source: str) -> Normalised:
        """Look-alikes are replaced one for one, so places stay the same."""
        places = np.arange(len(source) + 1)
        return cls(source.translate(_TABLE), places[:-1], places[1:])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Normalised:
        """The spots ``start, end`` in order replaced; all characters of a
        replacement stand for the whole spot."""
        if not edits:
            return self
        texts, starts, ends, at = [], [], [], 0
        for low, high, put in edits:
            texts += [self.text[at:low], put]
            starts += [self.start[at:low], np.full(len(put), self.start[low])]
            ends += [self.end[at:low], np.full(len(put), self.end[high - 1])]
            at = high
        texts.append(self.text[at:])
        starts.append(self.start[at:])
        ends.append(self.end[at:])
        return Normalised("".join(texts), np.concatenate(starts), np.concatenate(ends))

    def replace(self, pattern: re.Pattern, put: str) -> Normalised:
        return self.rewrite([(*found.span(), put) for found in pattern.finditer(self.text)])


def _spelled_digits(norm: Normalised) -> Normalised:
    """Runs of spelled digits become digits without anything between."""
    edits = []
    for run in _SPELLED.finditer(norm.text):
        words = list(_ONE_WORD.finditer(norm.text, *run.span()))
        for word, after in zip(words, [*words[1:], None]):
            put = _DIGIT_WORDS.get(word.group().lower(), "+")
            edits.append((word.start(), after.start() if after else word.end(), put))
    return norm.rewrite(edits)


TRANSDUCERS: tuple[Callable[[Normalised], Normalised], ...] = (
    lambda norm: norm.replace(_HIDDEN, ""),
    _spelled_digits,
    lambda norm: norm.replace(_AT_BRACKET, "@"),
    lambda norm: norm.replace(_AT_WORD, "@"),
    lambda norm: norm.replace(_AT_UNDER, "@"),
    lambda norm: norm.replace(_DOT_BRACKET, "."),
    lambda norm: norm.replace(_DOT_UNDER, "."),
    lambda norm: norm.replace(_DOT_WORD, "."),
)


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, at their source places.
    One that overlaps a known one of its kind is only taken if it is more of the
    same unbroken string, as where a look-alike cut the known one short."""
    if not any(signs(text)):
        return []
    norm = Normalised.of(text)
    for transducer in TRANSDUCERS:
        norm = transducer(norm)
    added = []
    for kind, low, high in plain(norm.text):
        start, end = int(norm.start[low]), int(norm.end[high - 1])
        if text[start:end] != norm.text[low:high]:
            met = [(a, b) for other, a, b in known if kind == other and start < b and a < end]
            whole = all(start <= a and b <= end for a, b in met) and (start, end) not in met
            if not met or (whole and not _GAP.search(text, start, end)):
                added.append((kind, start, end))
    return added


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, base`` of all personal data of a text in code points,
    ordered by kind as in ``KINDS`` and then by start."""
    if not text:
        return []
    base = plain(text)
    found = [(*span, True) for span in base] + [(*span, False) for span in disguised(text, base)]
    return sorted(found, key=lambda span: (KINDS.index(span[0]), span[1], span[2]))


# -- on tables ----------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``; ``spans`` is an array of
    ``kind, start, end, base``, in code points with the end exclusive.

    A null text has no spans. Repeated rows and rows without doc_id are read
    like any other; other columns are not looked at; an empty table gives an
    empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), x)) for x in spans(text.as_py())] for text in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(read, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def listed(found: Column, only_base: bool = False) -> Column:
    """An array of spans as ``kind:start:end``, comma-joined."""
    chosen = F.filter(found, lambda x: x["base"]) if only_base else found
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that
    overlap become one, under the kind that begins first."""
    found = sorted((start, end, kind) for kind, start, end, _ in spans(text))
    parts, at = [], 0
    for start, end, kind in found:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; null texts and all
    other columns, whatever their names, are returned as they are, and so are
    repeated rows. An empty table gives an empty result."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            fresh = [value if value is None else redacted(value) for value in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(fresh, batch.schema.field(at).type))

    return docs.mapInArrow(read, docs.schema)
