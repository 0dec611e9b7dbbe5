"""Exact duplicates, with frequent texts settled before the shuffle.

Texts are equal when they are identical after lower-casing A to Z. Every text is
read once, where it lies, and leaves its SHA-256 digest. Spark's ``freqItems``, a
Misra-Gries summary, names the digests that may hold more than one row in
``SHARE``; an exact count over these few verifies them and finds the row of each
that stays. At most ``SHARE`` verified winners are broadcast, and their copies are
settled where they are read. What remains has at most one row in ``SHARE`` under a
digest and is shuffled by digest in the ordinary way.

Of equal texts, the row with the largest id stays; a null id counts as the
smallest. If several rows have that id, or only nulls, any one of them stays, so
exactly one row of a group does. A null text counts as empty. An empty table gives
an empty result; further columns are not looked at.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodesis.workspace import Workspace

# A digest with more than one row in so many is frequent.
SHARE = 4096


def digest(text: Column) -> Column:
    """SHA-256 of a text after lower-casing A to Z, in lower-case hex."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    return F.sha2(F.translate(known, ascii_uppercase, ascii_lowercase).cast("binary"), 256)


def frequent_digests(digests: DataFrame, rows: int) -> DataFrame:
    """``digest, last, n`` of every digest that has more than one in ``SHARE`` of
    the ``rows`` rows ``doc_id, digest, mark``: ``last`` is its largest
    ``doc_id, mark``."""
    named = digests.freqItems(["digest"], 1 / SHARE)
    named = named.select(F.explode("digest_freqItems").alias("digest"))
    counted = digests.join(F.broadcast(named), "digest").groupBy("digest").agg(*[column.alias(name) for name, column in _group().items()])
    return counted.filter(F.col("n") * SHARE > rows)


def _group() -> dict[str, Column]:
    return {"last": F.max(F.struct("doc_id", "mark")), "n": F.count(F.lit(1))}


def _digests(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Tables of all digests and of the frequent ones."""
    tables = Workspace(docs.sparkSession, "exact")
    read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), digest(F.col(f"`{text}`")).alias("digest"))
    rows = tables.save("digests", read.withColumn("mark", F.monotonically_increasing_id()))["rows"]
    tables.save("frequent", frequent_digests(tables.load("digests"), rows))
    return tables.load("digests"), tables.load("frequent")


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of
    ``docs``: the id of the row that stays, how many rows have the text, and
    whether this row is the one that stays."""
    digests, frequent = _digests(docs, doc_id, text)
    settled = digests.join(F.broadcast(frequent), "digest")
    same = Window.partitionBy("digest")
    others = digests.join(F.broadcast(frequent), "digest", "left_anti")
    others = others.select("*", *[column.over(same).alias(name) for name, column in _group().items()])
    return settled.unionByName(others).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("mark") == F.col("last.mark")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, unchanged and with all their columns.

    Rows of a frequent text go where they are read; one row of each other text is
    picked while texts are shuffled by digest."""
    _, frequent = _digests(docs, doc_id, text)
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        digest(F.col(f"`{text}`")).alias("digest"),
    )
    rows = rows.join(F.broadcast(frequent.select("digest", "last")), "digest", "left")
    rows = rows.filter(F.col("last").isNull() | F.col("doc_id").eqNullSafe(F.col("last.doc_id")))
    return rows.groupBy("digest").agg(F.max_by("row", F.struct("doc_id")).alias("row")).select("row.*")
