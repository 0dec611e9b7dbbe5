"""Quality of documents by rules and by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are estimated: one of trusted documents,
one of the whole corpus. A document's score is the mean over its n-grams of the
logarithm of the ratio of the two, so it does not grow with length, and it is
held against a fixed threshold: no document is drawn by chance. N-grams are
single tokens and pairs of neighbours, where a token is a run of letters and
digits or a run of other visible characters, and case counts.

Everything is built-in functions. Texts are never shuffled: the corpus is
summed into a fixed number of buckets, and the ratios come back as one array
that a scalar subquery hands to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodesis.llm.sampling import lowest_hashes

_SYMBOLS = "[#*$%&|<>]"
_VISIBLE = "[^\\x20\\x09-\\x0D]"
_SPACE = "[\\x20\\x09-\\x0D]+"
_MARKS = "([^\\p{L}\\p{N}\\x20\\x09-\\x0D]+)"


@dataclass(frozen=True)
class Rules:
    """Bounds of the verdict; none depends on the size of the corpus."""

    least_words: int = 50
    """Fewer words fail."""
    most_repeated: int = 50
    """A higher percentage of words in repeated windows fails."""
    window: int = 3
    """Words of a window."""
    buckets: int = 1 << 16
    """Hash buckets of n-grams, and so the length of the array of ratios."""
    smoothing: float = 1.0
    """Added to the count of every bucket, times its share in the corpus for
    the trusted side, so that rare n-grams say little."""
    trusted: int = 20_000
    """Most trusted documents that are learned from: those with the lowest hash
    of their id. This bounds what is sent to the tasks."""
    threshold: float = -0.3
    """Documents whose score is lower are rejected."""


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _neighbours(name: str, make) -> Column:
    """``make(x, y)`` of every two neighbours of an array column. No lambda
    looks back at the whole array, so nothing is ever computed per element twice."""
    shorter = F.greatest(F.size(name) - 1, F.lit(0))
    return F.zip_with(F.slice(name, 1, shorter), F.slice(name, 2, shorter), make)


def _held(rows: DataFrame, name: str) -> DataFrame:
    """``rows``; a later filter is not moved before this point, which would
    evaluate the costly columns once more for each mention of them."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


def with_base(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` with a text column ``text`` (not null), plus the base counts."""
    width = rules.window
    # Two windows of a text with one 64-bit hash: less likely than a flipped bit in memory.
    listed = rows.withColumn("words", words(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    found = listed.withColumn("windows", F.transform("words", lambda word: F.xxhash64(word)))
    heads = found.withColumn("hashes", F.col("windows"))
    for k in range(1, width):
        rest = F.slice("hashes", k + 1, F.greatest(F.size("hashes") - k, F.lit(0)))
        shorter = F.slice("windows", 1, F.size(rest))
        heads = heads.withColumn("windows", F.zip_with(shorter, rest, lambda window, word: F.xxhash64(window, word)))
    repeats = heads.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = repeats.withColumn("ordered", F.when(F.col("repeats"), placed))
    both = _neighbours("ordered", lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    covered = ordered.withColumn("covered", F.array_distinct(F.flatten(both)))
    positions = F.flatten(F.transform("covered", lambda i: F.array(*[i + k for k in range(width)])))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(_VISIBLE))
    counted = (
        covered.withColumn("n_repeat_words", F.when(F.col("repeats"), F.size(F.array_distinct(positions))).otherwise(0).cast("long"))
        .withColumn("lines", lines)
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", (F.length("text") - F.length(F.regexp_replace("text", _SYMBOLS, ""))).cast("long"))
        .drop("words", "hashes", "windows", "repeats", "ordered", "covered", "lines")
    )
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    return _held(counted, "based").withColumn("base_failed", failed)


def with_grams(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` with ``grams``: the bucket of every n-gram of ``text``."""
    tokens = words(F.regexp_replace("text", _MARKS, " $1 "))
    hashed = rows.withColumn("_hashes", F.transform(tokens, lambda token: F.xxhash64(token)))
    bucket = lambda h: F.pmod(h, F.lit(rules.buckets)).cast("int")
    pairs = _neighbours("_hashes", lambda x, y: bucket(F.xxhash64(x, y)))
    return hashed.withColumn("grams", F.concat(F.transform("_hashes", bucket), pairs)).drop("_hashes")


def trusted_ids(labels: DataFrame, rules: Rules, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` of at most ``rules.trusted`` documents labelled as good and not toxic."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(doc_id).cast("long").alias("doc_id"))
    return lowest_hashes(good.filter("doc_id IS NOT NULL").distinct(), "doc_id", rules.trusted)


def ratios(docs: DataFrame, trusted: DataFrame, rules: Rules, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row with ``ratios``: for every bucket the logarithm of its share in
    trusted documents over its share in the corpus ``docs``. ``trusted`` is a
    bounded frame of ids. Without trusted documents all ratios are zero."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = rows.join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    grams = with_grams(marked, rules).select(F.coalesce("good", F.lit(0)).alias("good"), F.explode_outer("grams").alias("bucket"))
    counted = grams.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    every = docs.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counted, "bucket", "left").na.fill(0, ["raw", "good"])
    # At most `buckets` rows from here on.
    sums = filled.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("all"),
        F.sum("raw").alias("raws"),
        F.sum("good").alias("goods"),
    )
    weight = F.lit(rules.smoothing * rules.buckets)

    def ratio(x: Column) -> Column:
        share = (x["raw"] + rules.smoothing) / (F.col("raws") + weight)
        trusted_share = (x["good"] + weight * share) / (F.col("goods") + weight)
        return F.log(trusted_share / share)

    return sums.select(F.transform("all", ratio).alias("ratios"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    rules: Rules = Rules(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with ``n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    A null text counts as empty: it has no words, score 0, and fails. Repeated
    rows get equal verdicts and count as often as they occur; so does a row
    without doc_id, which is never a trusted one. With an empty ``labels``
    every score is 0. An empty table gives an empty result. Columns of ``docs``
    keep their names inside ``row``, whatever these are.
    """
    table = ratios(docs, trusted_ids(labels, rules), rules, doc_id, text)
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = (
        with_grams(rows, rules)
        .withColumn("ratios", table.scalar())
        .withColumn("total", F.aggregate("grams", F.lit(0.0), lambda acc, bucket: acc + F.get("ratios", bucket)))
        .withColumn("score", F.when(F.size("grams") == 0, 0.0).otherwise(F.col("total") / F.size("grams")))
        .drop("grams", "ratios", "total")
    )
    based = with_base(_held(scored, "scored"), rules)
    return based.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= rules.threshold)).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, unchanged."""
    return judge(docs, labels, rules, doc_id, text).filter("kept").select("row.*")
