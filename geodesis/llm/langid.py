"""Language of documents, in two steps: the family first, then the language in it.

Texts become vectors of hashed runs of one to three characters. Linear support
vector machines, one for every two families and one for every two languages of a
family, vote at each step. They are trained side by side, each in a task of its
own on a bounded sample of labelled documents; predicting reads every text once,
where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geodesis.llm.sampling import SPARE
from geodesis.workspace import Workspace

UNKNOWN = "und"
# Families of languages by their codes. Others are their own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi bn pa mr gu ur ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "sinitic": "zh yue wuu",
    "dravidian": "ta te kn ml",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = re.compile(r"[^\W\d_]+")
_TURN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Size of the model and of what it learns from."""

    buckets: int = 1 << 13
    """Length of a text's vector."""
    longest: int = 3
    """Most characters of a run."""
    per_language: int = 800
    """Most labelled documents of a language that are learned from: those with
    the lowest hash of their id."""
    rounds: int = 12
    """Passes over the sample."""
    cost: float = 10.0
    """Weight of an error against the width of the margin."""


def family(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0].split("_")[0], language)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and their weights, of length one together."""
    letters = " " + " ".join(_LETTERS.findall(text.lower())) + " "
    codes = np.frombuffer(letters.encode("utf-32-le"), "<u4").astype(np.uint64)
    counts = np.zeros(settings.buckets)
    runs = np.zeros(len(codes), np.uint64)
    for width in range(1, settings.longest + 1):
        if len(codes) < width:
            break
        runs = (runs[: len(codes) - width + 1] + codes[width - 1 :] + np.uint64(width)) * _TURN
        runs ^= runs >> np.uint64(29)
        counts += np.bincount((runs % np.uint64(settings.buckets)).astype(np.int64), minlength=settings.buckets)
    held = np.flatnonzero(counts)
    weights = np.sqrt(counts[held])
    return held, weights / np.linalg.norm(weights)


def train(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights, the last one the offset, of a linear support vector machine by
    dual coordinate ascent in a fixed order."""
    weights = np.zeros(settings.buckets + 1)
    alphas = np.zeros(len(rows))
    # Both sides weigh the same, however many rows they have.
    bound = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())) * settings.cost * len(rows)
    order = np.random.default_rng(0)
    for _ in range(settings.rounds):
        for k in order.permutation(len(rows)):
            held, values = rows[k]
            gain = 1 - signs[k] * (weights[held] @ values + weights[-1])
            step = np.clip(alphas[k] + gain / 2, 0, bound[k]) - alphas[k]
            if step:
                alphas[k] += step
                weights[held] += step * signs[k] * values
                weights[-1] += step * signs[k]
    return weights


def machines(sample: DataFrame, settings: Settings) -> DataFrame:
    """``step, low, high, weights``: positive weights speak for ``low``.

    ``sample`` is ``lang, held, weight, number``, bounded per language;
    ``number`` counts a language's rows from 1.
    """
    languages = sorted(row[0] for row in sample.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for language in languages:
        families.setdefault(family(language), []).append(language)
    # A family takes part with as many rows as a language, shared evenly.
    tasks = [("family", a, b, x, -(-settings.per_language // len(families[side])), side == a) for a, b in combinations(sorted(families), 2) for side in (a, b) for x in families[side]]
    tasks += [("language", a, b, x, settings.per_language, x == a) for inside in families.values() for a, b in combinations(inside, 2) for x in (a, b)]
    kinds = "step string, low string, high string, lang string, most int, first boolean"
    parts = sample.sparkSession.createDataFrame(tasks, kinds)

    def learned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "number"])
        rows = list(zip(group["held"], group["weight"]))
        weights = train(rows, np.where(group["first"], 1, -1), settings)
        return pd.DataFrame({"step": [group["step"].iloc[0]], "low": [group["low"].iloc[0]], "high": [group["high"].iloc[0]], "weights": [weights]})

    dealt = sample.join(F.broadcast(parts), "lang").filter("number <= most")
    return dealt.groupBy("step", "low", "high").applyInPandas(learned, "step string, low string, high string, weights array<double>")


class Judge:
    """Votes of trained machines."""

    def __init__(self, languages: list[str], found: list[tuple[str, str, str, np.ndarray]], settings: Settings) -> None:
        self.settings = settings
        self.inside: dict[str, list[str]] = {}
        for language in languages:
            self.inside.setdefault(family(language), []).append(language)
        self.pairs = [(step, low, high) for step, low, high, _ in found]
        self.weights = np.array([x for *_, x in found]).reshape(len(found), settings.buckets + 1)

    def _winner(self, names: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name with most duels won, then with the larger sum of margins,
        and how sure that is: the worst of its duels."""
        votes = {name: (0, 0.0) for name in names}
        for (low, high), margin in margins.items():
            best = low if margin >= 0 else high
            for name, signed in ((low, margin), (high, -margin)):
                votes[name] = (votes[name][0] + (name == best), votes[name][1] + signed)
        chosen = max(sorted(names), key=votes.__getitem__)
        duels = [margin if low == chosen else -margin for (low, high), margin in margins.items() if chosen in (low, high)]
        return chosen, 1 / (1 + np.exp(-4 * min(duels))) if duels else 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.inside or not has_letter(text):
            return UNKNOWN, 0.0
        held, values = vector(text, self.settings)
        decisions = self.weights[:, held] @ values + self.weights[:, -1] if len(self.pairs) else []
        margins = {pair: float(x) for pair, x in zip(self.pairs, decisions)}
        kin, first = self._winner(list(self.inside), {(a, b): x for (step, a, b), x in margins.items() if step == "family"})
        near = set(self.inside[kin])
        chosen, second = self._winner(self.inside[kin], {(a, b): x for (step, a, b), x in margins.items() if step == "language" and a in near})
        return chosen, float(first * second)


def predict_languages(
    docs: DataFrame,
    learn: Column,
    settings: Settings = Settings(),
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``.

    Learned from are rows where ``learn`` holds and language, text and doc_id
    are not null, at most ``per_language`` of each language; the prediction of a
    row looks at its text alone. A text that is null or has no letter is
    ``und`` with score 0, and so is every text if there is nothing to learn
    from. With one language, all others are that one. Repeated rows get equal
    results. Further columns are not looked at; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    tables = Workspace(spark, "langid")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), learn.alias("learn")
    )
    usable = rows.filter("learn AND doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    # Ids only. Hashes above a share that surely holds enough are left out first,
    # so no more than a few times `per_language` rows of a language meet.
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    tables.save("sizes", ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("size")))
    share = F.lit(SPARE * settings.per_language) / F.col("size")
    low = ids.join(tables.load("sizes"), "lang").filter((F.col("hash") / 2.0**64 + 0.5) < share)
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    numbered = low.select("doc_id", "lang", "hash").distinct().withColumn("number", F.row_number().over(order))
    tables.save("chosen", numbered.filter(F.col("number") <= settings.per_language))
    chosen = tables.load("chosen").select("doc_id", "lang", "number")
    texts = usable.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(x.as_py(), settings) for x in batch.column("text")]
            held = pa.array([x for x, _ in found], pa.list_(pa.int32()))
            weight = pa.array([x for _, x in found], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("lang"), held, weight, batch.column("number")], ["lang", "held", "weight", "number"])

    sample = texts.select("lang", "number", "text").mapInArrow(measured, "lang string, held array<int>, weight array<double>, number int")
    tables.save("sample", sample.dropDuplicates(["lang", "number"]))
    sample = tables.load("sample")
    languages = sorted(row[0] for row in sample.select("lang").distinct().collect())
    # One row for every two families or languages: bounded by their number.
    found = [(x["step"], x["low"], x["high"], np.array(x["weights"])) for x in machines(sample, settings).collect()] if len(languages) > 1 else []
    shared = spark.sparkContext.broadcast(Judge(languages, sorted(found, key=lambda x: x[:3]), settings))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            made = [judge.predict(x.as_py()) for x in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())]
            yield pa.record_batch(columns, ["doc_id", "lang_pred", "score"])

    return rows.select("doc_id", "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double")
