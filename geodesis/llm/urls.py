"""Verdicts on urls: rules for hosts first, then a weighted vocabulary.

Where a rule fits, the longest decides. Any other url is run once through an
Aho-Corasick automaton of all terms: one strict term, or several different soft
ones, reject it. A term counts only where no letter or digit touches it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\W_]")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Terms:
    """The vocabulary; its size is that of a list somebody keeps by hand."""

    strict: tuple[str, ...] = (
        "porn", "porno", "xxx", "xvideos", "hentai", "nsfw", "milf", "camgirl", "camgirls", "escorts",
        "warez", "cracked", "keygen", "viagra", "cialis", "phishing", "malware",
    )
    soft: tuple[str, ...] = (
        "sex", "sexy", "nude", "adult", "erotic", "fetish", "casino", "poker", "slots", "bet", "bets", "betting",
        "gambling", "jackpot", "win", "free", "cheap", "pills", "pharma", "pharmacy", "loan", "loans", "payday",
        "torrent", "crack", "hack", "ads", "track", "tracker", "click", "popup", "replica",
    )
    soft_hits: int = 2
    """Different soft terms that reject together."""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#`` in lower case,
    and the rest up to ``?`` or ``#``; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``name, verdict`` of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda rule: (len(rule.name), rule.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        made = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, made).otherwise(found)
    return found


class Automaton:
    """All terms in one automaton."""

    def __init__(self, terms: Terms) -> None:
        self.least = terms.soft_hits
        self.words = ahocorasick.Automaton()
        for kind, listed in (("soft", terms.soft), ("strict", terms.strict)):
            for term in listed:
                self.words.add_word(term.lower(), (term.lower(), kind))
        self.words.make_automaton()

    def hits(self, url: str | None) -> tuple[list[str], list[str]]:
        """Different strict and soft terms of a url, sorted."""
        found: dict[str, set[str]] = {"strict": set(), "soft": set()}
        text = (url or "").lower()
        if len(self.words):
            for end, (term, kind) in self.words.iter(text):
                start = end + 1 - len(term)
                if (start == 0 or not _WORD.match(text[start - 1])) and not _WORD.match(text[end + 1 : end + 2]):
                    found[kind].add(term)
        return sorted(found["strict"]), sorted(found["soft"])


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], terms: Terms = Terms(), page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict, soft`` for every row.

    ``rule`` is null where none fits; then the terms decide, which ``strict``
    and ``soft`` list. A null or empty url, or one without ``://``, has an empty
    host and path, so no rule fits; a null one has no terms and is allowed.
    Repeated rows and rows without page_id are judged like any other; only the
    two columns are read; an empty table gives an empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        kinds = pa.list_(pa.string())
        for batch in batches:
            hits = [automaton.hits(value.as_py()) for value in batch.column("url")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array([x for x, _ in hits], kinds), pa.array([x for _, x in hits], kinds)],
                ["page_id", "url", "strict", "soft"],
            )

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()
    found = rows.mapInArrow(read, f"page_id {kind}, url string, strict array<string>, soft array<string>")
    host, path = host_and_path(F.col("url"))
    rejected = (F.size("strict") > 0) | (F.size("soft") >= terms.soft_hits)
    parted = found.withColumn("host", host).withColumn("path", path)
    ruled = parted.withColumn("ruled", rule_for(F.col("host"), F.col("path"), rules))
    return ruled.select(
        "page_id",
        "host",
        "path",
        F.col("ruled.name").alias("rule"),
        F.coalesce("ruled.verdict", F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        "strict",
        "soft",
    )
