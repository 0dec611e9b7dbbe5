"""From raw documents to packed sequences, one operator after the other.

Null and empty texts and rows without doc_id are handled as each operator says:
the first stage rejects texts of fewer than 50 words, so none of them gets further.
Repeated rows are rows like others until the near duplicates go; rows that share a
doc_id then stay or go together. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodesis.llm import packing, pii, quality, similar, templates
from geodesis.llm.queries import WORD_TOKENIZER, table
from geodesis.workspace import Workspace


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, folder, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first, and so
    do documents that have no others. What near copies have in common is no
    evidence of a template: they count as one document here, and lose the same
    lines, so that the next stage still sees how alike they are."""
    alike = similar.similar_documents(docs).select("doc_id", F.col("component_id").alias("part"))
    return templates.drop_recurring_lines(docs, templates.Tree(several=True), drop_emptied=True, keep_short=True, parts=alike)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group stays. Two documents are near duplicates if their
    SimHash fingerprints, joined in tries, differ in at most three bits, or if four
    fifths of the shingles of five words that they have between them are in both;
    minimum hashes find those, and the sets decide."""
    return similar.drop_similar(docs)


def redact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where every piece of every document goes."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact),
    ("packing", pack),
]

# Hashes, a tree of templates and tokenizers: not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    tables = Workspace(spark, "pipeline")
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        tables.save(name, stage(spark, docs, folder))
        docs = tables.load(name)
    return docs
