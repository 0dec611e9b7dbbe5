"""The stages on the smallest tables, each against a plain version on its input."""

import os
import re

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from geodesis.llm import pii
from geodesis.llm.templates import Tree
from test_text_operators import check_packing, left_over, plain_template_drop
from test_whole_job import plain_components

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, kept[-1], FOLDER)
        kept.append(spark.createDataFrame(made.collect(), made.schema))
    assert all(frame.columns == docs.columns for frame in kept[:-1])
    before, good, fewer, single, clean = [{row.doc_id: row for row in frame.collect()} for frame in kept[:-1]]

    for key, row in before.items():
        counts = brute.base_counts(row.text)
        if counts[0] < 50 or 100 * counts[4] > 50 * counts[0]:
            assert key not in good
    lost = [row.text for key, row in before.items() if key not in good and brute.base_counts(row.text)[0] >= 50]
    assert all(re.search(r"[*#$%&|!]{2}| \| |(\b\w+\b)( \1){5}", text) or brute.base_counts(text)[4] for text in lost)
    assert all(good[key] == before[key] for key in good)

    texts = {key: row.text for key, row in good.items()}
    tree = Tree(several=True)
    gone = plain_template_drop(texts, tree, plain_components(texts))
    left = {key: left_over(key, text, gone, tree, least=1) for key, text in texts.items()}
    assert gone and {key: row.text for key, row in fewer.items()} == {key: text for key, text in left.items() if text}

    groups = plain_components({key: row.text for key, row in fewer.items()})
    assert set(single) == set(groups.values()) and len(single) < len(fewer)
    # No near copy of a document gets through as a fragment of itself.
    before = plain_components(texts)
    assert len({before[key] for key in single}) == len(single)
    assert all(single[key] == fewer[key] for key in single)

    assert clean.keys() == single.keys()
    for key, row in single.items():
        assert clean[key].text == pii.redacted(row.text)
        assert not brute.plain_spans(clean[key].text)

    check_packing(kept[-1].collect(), [(key, row.text) for key, row in clean.items()], 2048)


def test_run_gives_the_last_stage(spark):
    found = entry.queries()["pipeline"](spark, FOLDER)
    assert found.columns[0] == "doc_id" and "sequence_id" in found.columns and found.count() > 0


def test_every_operator_is_registered():
    names = [name for name in entry.queries() if re.match(r"op\d+_", name)]
    assert [int(name[2:].split("_")[0]) for name in names] == list(range(1, 14))


def test_queries_read_by_name_and_agree_with_sql(spark):
    import duckdb

    database = duckdb.connect()
    for name in ("pages", "embeddings"):
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name in ("op7_urls", "op9_largest_products"):
        found = entry.queries()[name](spark, FOLDER)
        columns = sorted(found.columns)
        result = database.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, result)) == sorted(str(tuple(row)) for row in found.select(*columns).collect())


def test_stages_on_odd_and_empty_tables(spark):
    docs = brute.odd(spark)
    for stage in dict(corpus_pipeline.STAGES).values():
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns, name
        assert {row.doc_id for row in found.collect()} <= {row[0] for row in brute.odd_rows()}, name
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, FOLDER).collect()
    check_packing(packed, [(row[0], row[1]) for row in brute.odd_rows()], 2048)
