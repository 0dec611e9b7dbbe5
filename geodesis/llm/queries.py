"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodesis.llm import (
    alignment,
    byte_bpe,
    exact,
    langid,
    packing,
    pii,
    prefixes,
    quality,
    simhash,
    templates,
    token_counts,
    topk,
    urls,
)

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
QUERY_STEP = 50
RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _op1(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _op2(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[of(kind) for kind in pii.KINDS],
        F.sha2(pii.listed(F.col("spans"), only_base=True).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.predict_languages(docs, ~_held_out(F.col("doc_id")))
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), PIECE_MODEL)


def _op5(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judge(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("row.doc_id", *counts, "base_failed", "kept", "score")


def _op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return templates.drop_recurring_lines(docs, templates.Tree(several=True), count="n_dropped", keep_short=True)


def _op7(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _op8(spark: SparkSession, folder: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, folder, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, BYTE_RANKS, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _op9(spark: SparkSession, folder: str) -> DataFrame:
    return topk.largest_products(table(spark, folder, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


def _op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), WORD_TOKENIZER)


def _op11(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokens(table(spark, folder, "documents"), BYTE_TOKENIZER, PIECE_MODEL)


def _op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, folder, "conversations"), arranged=prefixes.with_shared_starts)


def _op13(spark: SparkSession, folder: str) -> DataFrame:
    return exact.find_copies(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": _op1,
        "op2_personal_data": _op2,
        "op3_language": _op3,
        "op4_token_counts": _op4,
        "op5_quality": _op5,
        "op6_line_templates": _op6,
        "op7_urls": _op7,
        "op8_byte_bpe": _op8,
        "op9_largest_products": _op9,
        "op10_packing": _op10,
        "op11_alignment": _op11,
        "op12_prefixes": _op12,
        "op13_exact": _op13,
    }


def _terms_sql(listed: tuple[str, ...]) -> str:
    """How many of the terms stand in column ``low`` with nothing touching them."""
    one = "CAST(regexp_matches(low, '(^|[^\\p{L}\\p{N}])' || '%s' || '($|[^\\p{L}\\p{N}])') AS INTEGER)"
    return " + ".join(one % term for term in listed)


def _rules_sql() -> str:
    cases = "".join(
        f" WHEN (host = '{rule.host}' OR suffix(host, '.{rule.host}')) AND starts_with(path, '{rule.path}') THEN '{rule.name}'"
        for rule in sorted(RULES, key=lambda rule: -len(rule.name))
    )
    verdicts = "".join(f" WHEN '{rule.name}' THEN '{rule.verdict}'" for rule in RULES)
    return f"CASE{cases} END AS rule), judged AS (SELECT *, CASE rule{verdicts} END AS ruled FROM ruled)"


# CRC-32 by its table of 256 remainders; 3988292384 is the reversed polynomial.
_PREFIXES_SQL = """
  WITH remainders AS (
    SELECT list(list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
                            lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS rest
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
  given AS (
    SELECT conv_id, turn, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS shown,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
  placed AS (
    SELECT conv_id, md5(shown) AS id, words,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(shown)) AS place
    FROM given),
  taking AS (
    SELECT conv_id, xor(list_reduce(
             list_concat([4294967295], list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1),
                                                      lambda i: CAST(ord(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
             lambda c, b: xor(rest[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM placed), remainders),
  gathered AS (
    SELECT t.conv_id, p.place, p.id, p.words FROM taking t JOIN placed p ON p.conv_id = t.conv_id - t.conv_id % 20 AND p.place <= h
    UNION ALL SELECT t.conv_id, p.place + 4, p.id, p.words FROM taking t JOIN placed p ON p.conv_id = t.conv_id AND p.place > h),
  turns AS (SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM gathered),
  paths AS MATERIALIZED (
    SELECT conv_id, depth, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM taking),
  lengths AS (SELECT conv_id, max(depth) AS total FROM paths GROUP BY conv_id),
  nodes AS MATERIALIZED (
    SELECT node, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CASE WHEN depth = total THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
    FROM paths JOIN lengths USING (conv_id) GROUP BY node),
  children AS (
    SELECT substr(node, 1, len(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
  below AS (SELECT DISTINCT p.node AS node, q.node AS lower FROM paths p JOIN paths q ON p.conv_id = q.conv_id AND p.depth <= q.depth),
  sums AS (
    SELECT below.node, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves,
           CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
    FROM below JOIN nodes n ON n.node = below.lower LEFT JOIN children c ON c.node = below.lower GROUP BY below.node)
  SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
         sha256(n.ends) AS ends_sha256
  FROM nodes n JOIN sums USING (node) LEFT JOIN children c ON c.node = n.node
  LEFT JOIN nodes p ON n.depth > 0 AND p.node = substr(n.node, 1, len(n.node) - 32)"""


def oracle_sql() -> dict[str, str]:
    terms = urls.Terms()
    cut = "CASE WHEN position('://' IN u) > 0 THEN substr(u, position('://' IN u) + 3) ELSE '' END"
    rules = _rules_sql()
    return {
        "op7_urls": f"""
  WITH read AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
  cut AS (SELECT page_id, lower(u) AS low, {cut} AS rest FROM read),
  parted AS (
    SELECT page_id, low,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut),
  ruled AS (SELECT *, {rules.split("), judged")[0]} FROM parted),
  judged{rules.split("), judged")[1].removesuffix(")")})
  SELECT page_id, host, path, rule,
         coalesce(ruled, CASE WHEN {_terms_sql(terms.strict)} > 0 OR {_terms_sql(terms.soft)} >= {terms.soft_hits}
                         THEN 'block' ELSE 'allow' END) AS verdict
  FROM judged""",
        "op9_largest_products": f"""
  WITH codes AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS code FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.code, c.code) AS BIGINT) AS score
    FROM codes q JOIN codes c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id),
  ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
  SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
        "op12_prefixes": _PREFIXES_SQL,
        "op13_exact": """
  WITH read AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM documents)
  SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
         doc_id = max(doc_id) OVER same AS kept, sha256(low) AS text_sha256
  FROM read WINDOW same AS (PARTITION BY low)""",
    }
