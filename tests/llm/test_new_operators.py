"""Alignment of tokens, prefix trie and exact duplicates against plain versions."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest

from geodesis.llm import alignment, exact, pii, prefixes, queries

FOLDER = "/root/testdata/sf0.001"
LEVEL, PIECES = queries.BYTE_TOKENIZER, queries.PIECE_MODEL
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


# -- alignment ----------------------------------------------------------------


def tokens():
    with open(LEVEL, "rb") as level, open(PIECES, "rb") as pieces:
        return alignment.TokenPair(level.read(), pieces.read())


def plain_alignment(rows):
    found = brute.aligned([text for _, text in rows], tokens())
    counts = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(
        (
            str(key),
            a,
            b,
            len(groups),
            len(links),
            sum(counts[x] == best[x[0]] for x in links),
            sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
        )
        for (key, _), (a, b, groups, links) in zip(rows, found)
    )


TEXTS = [
    "Hello wörld, 東京 🎉🎉 don't  stop\n\n\tnow",
    "Hello wörld again. <|endoftext|> and <s> and <unk>",
    " leading  and trailing ",
    "one\n two\n\n three \nfour \n five\t \tsix\u00a0 \u2003seven 's 'll don 't",
    "\n one",
    "one \n",
    "it's the 1st\x1c of\x1c \x1cmany\x85 \x85lines\u3000of text",
    "▁ taken for a space",
    "a\x00b\x1c\r\nc",
    None,
    "",
    " ",
    "x" * 3_000,
    "word " * 2_000,
    "Hello wörld",
    "Hello wörld",
]


def shown(found):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(row[0]), *row[1:]) for row in found.select(*columns).collect())


@pytest.mark.parametrize("common", [alignment.COMMON, 40, 0])
def test_alignment_of_hard_texts(spark, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, "Hello wörld")]
    docs = spark.createDataFrame([(*row, 1, 2, 3) for row in rows], "doc_id long, text string, pairs int, n long, mark long")
    found = alignment.align_tokens(docs, LEVEL, PIECES, keep_groups=True)
    assert shown(found) == plain_alignment(rows)
    groups = {row.doc_id: (row.groups, row.groups_sha256) for row in found.collect()}
    assert all(groups[k] == ("", "") for k, text in enumerate(TEXTS) if not text or "▁" in text)
    assert all(hashlib.sha256(a.encode()).hexdigest() == b for a, b in groups.values() if b)
    assert shown(alignment.align_tokens(docs.limit(0), LEVEL, PIECES)) == []


@needs_tables
def test_alignment_of_the_smallest_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    short = [row for row in docs.collect() if len(row.text or "") < 3_000]
    assert len(short) > 100
    made = spark.createDataFrame(short, docs.schema)
    assert shown(alignment.align_tokens(made, LEVEL, PIECES)) == plain_alignment([tuple(row) for row in short])


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1_000])
def test_pieces_of_a_merge_do_equal_work_and_lose_nothing(step):
    pick = np.random.default_rng(step)
    for total in (1, 2, 9, 400):
        a, b = (np.union1d(pick.integers(1, total + 1, total // 2), [total]) for _ in range(2))
        left, right = alignment.diagonal_cuts(a, b, step)
        work = np.diff(left) + np.diff(right)
        assert work.sum() == len(a) + len(b) and (work <= step + 1).all() and (work[:-1] >= step - 1).all()
        ends, at_a, at_b, both = alignment.overlaps(a, b, step)
        assert ends.tolist() == np.union1d(a, b).tolist() and ends[both].tolist() == np.intersect1d(a, b).tolist()
        assert at_a.tolist() == np.searchsorted(a, ends).tolist() and at_b.tolist() == np.searchsorted(b, ends).tolist()


def test_merge_of_nothing():
    none = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in alignment.overlaps(none, none))


# -- prefixes -----------------------------------------------------------------

SIZES = [(3, 4), (2, 1), (5, 1000), (64, 4096)]


def trie(spark, rows, **options):
    made = spark.createDataFrame([(*row, "x", 1) for row in rows], "conv_id long, turn long, role string, text string, ids string, prefix int")
    found = prefixes.prefix_trie(made.repartition(3), **options).collect()
    assert len(found) == len(set(found))
    return {tuple(row) for row in found}


def many_conversations(seed):
    pick = random.Random(seed)
    rows = []
    for conv in range(240):
        start = pick.choice([0, 0, 3, 6])
        for turn in range(pick.choice([0, 1, 2, 3, 4, 7, 8, 13])):
            word = "same" if turn < start else pick.choice("abc")
            rows.append((conv * 3 % 601, turn, pick.choice(["user", None]) if turn > 5 else "user", f"{word} turn {turn}"))
    # A hot conversation and a large group of copies.
    rows += [(40, turn, "user", f"same turn {turn}") for turn in range(70)]
    rows += [(conv, turn, "user", f"same turn {turn}") for conv in range(2000, 2150) for turn in range(6)]
    return rows


@pytest.mark.parametrize("width,most", SIZES)
def test_prefixes_of_conversations_as_given_and_rebuilt(spark, width, most):
    rows = many_conversations(width)
    given = {}
    for conv, turn, role, text in rows:
        tie = hashlib.md5(f"{len(role or '')}:{role or ''}{text}".encode()).digest()
        given.setdefault(conv, []).append((turn, tie, role or "", text))
    given = {conv: [x[2:] for x in sorted(turns)] for conv, turns in given.items()}
    assert trie(spark, rows, width=width, most=most) == brute.prefix_nodes(given)
    again = trie(spark, rows, width=width, most=most, arranged=prefixes.with_shared_starts)
    assert again == brute.prefix_nodes(brute.rebuilt(rows))


def test_prefixes_of_odd_rows(spark):
    rows = [
        (20, None, "user", "first"),
        (20, 1, None, None),
        (20, 1, None, None),
        (20, 2, "user", ""),
        (21, 5, "user", "one two  three"),
        (22, 0, "user", "x" * 40_000),
        (23, 1, "us", "er first"),
        (None, 1, "user", "nobody"),
        (-7, 1, "user", "below zero"),
        (41, 0, "user", "its base is absent"),
        (41, 0, "user", "at the same turn"),
        (9_000_000_000, 3, "user", "first"),
    ]
    found = trie(spark, rows, width=2, most=3, arranged=prefixes.with_shared_starts)
    # SQL and Python differ below zero in the base of a conversation; it is absent in both.
    assert found == brute.prefix_nodes(brute.rebuilt(rows))
    assert trie(spark, [row for row in rows if row[0] is None]) == set()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixes.prefix_trie(empty, arranged=prefixes.with_shared_starts).collect() == []


# -- exact duplicates ---------------------------------------------------------


def plain_copies(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub("[A-Z]", lambda x: x.group().lower(), text or "")].append(key)
    found = []
    for low, keys in groups.items():
        keep = max((key for key in keys if key is not None), default=None)
        digest = hashlib.sha256(low.encode()).hexdigest()
        found += [(str(key), str(keep), len(keys), digest) for key in keys]
    return sorted(found), {low: keys for low, keys in groups.items()}


def check_copies(spark, rows):
    docs = spark.createDataFrame([(*row, "a", 2) for row in rows], "doc_id long, text string, digest string, last int")
    found = exact.find_copies(docs).collect()
    expected, groups = plain_copies(rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected
    stays = [r for r in found if r.kept]
    assert len(stays) == len(groups) and all(r.doc_id == r.keep_id for r in stays)
    fewer = exact.drop_copies(docs).collect()
    assert sorted(str(r.doc_id) for r in fewer) == sorted(str(r.doc_id) for r in stays)
    assert all(tuple(r) in {(*row, "a", 2) for row in rows} for r in fewer)


@pytest.mark.parametrize("share", [2, 20, exact.SHARE])
def test_copies_with_frequent_texts(spark, monkeypatch, share):
    monkeypatch.setattr(exact, "SHARE", share)
    pick = random.Random(share)
    rows = [(key, f"Text {min(pick.randrange(60), pick.randrange(60), pick.randrange(60))}") for key in range(400)]
    rows += [(key, "HOT text" if key % 2 else "hot TEXT") for key in range(1_000, 1_300)]
    pick.shuffle(rows)
    check_copies(spark, rows)


def test_copies_of_odd_rows(spark):
    rows = [(row[0], row[1]) for row in brute.odd_rows()]
    rows += [(30, "ÄB"), (31, "äb"), (32, "Äb"), (33, " "), (34, "K"), (35, "k"), (None, "alone"), (None, "ALONE")]
    check_copies(spark, rows)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.find_copies(docs).collect() == [] and exact.drop_copies(docs).collect() == []


@needs_tables
def test_queries_agree_with_sql(spark):
    import duckdb

    database = duckdb.connect()
    for name in ("documents", "conversations"):
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name in ("op12_prefixes", "op13_exact"):
        found = queries.queries()[name](spark, FOLDER)
        columns = sorted(found.columns)
        result = database.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, result)) == sorted(str(tuple(row)) for row in found.select(*columns).collect())


def test_tokens_are_the_bytes_of_the_text():
    found = tokens()
    for (a, b), text in zip(found.encode(TEXTS), TEXTS):
        if text and "▁" not in text:
            assert b"".join(found.bytes_a[k] for k in a) == b"".join(found.bytes_b[k] for k in b) == f" {text}".encode()
        else:
            assert len(a) == len(b) == 0
    assert public_tokenizers.path("byte_bpe_50k.json") == LEVEL


# -- personal data ------------------------------------------------------------


def math_letters(text):
    return "".join(chr(0x1D41A + ord(x) - 97) if x.isascii() and x.islower() else x for x in text)


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to " + math_letters("john@example.com") + " now", "john@example.com"),
        ("write to jo​hn@exam­ple.com now", "john@example.com"),
        ("write to j.doe_at_example_dot_org now", "j.doe@example.org"),
        ("write to j.doe_AT_mail.example_DOT_org.", "j.doe@mail.example.org"),
        ("call plus four nine one five one two three four five six seven eight now", "+4915123456 78"),
    ],
)
def test_disguises_of_personal_data(text, found):
    (kind, start, end, base), *rest = [x for x in pii.spans(text) if not x[3]]
    assert not rest and text[:start].endswith((" ", "")) and text[end:][:1] in (" ", ".", "")
    assert start == text.index(" ") + (4 if text.startswith("write") else 1) and kind in ("email", "phone")
    redacted = pii.redacted(text)
    assert "john" not in redacted and "hn@" not in redacted and "doe" not in redacted and "nine" not in redacted


def test_no_sign_of_a_disguise_is_missed():
    pick = random.Random(12)
    parts = [*pii._DIGIT_WORDS, "at", "dot", "PUNKT", "Zéro", "FÜNF", "oh", "x", "word", "(", "[ ", "{", "<", ")", " ]", "@", ".", " ", "-", "  ", "_", "\n", "«", "’", "é", "ß", "1"]
    seen = 0
    for _ in range(20_000):
        text = pick.choice(["", " ", "-"]).join(pick.choice([x, x.upper(), x.title()]) for x in pick.choices(parts, k=pick.randrange(1, 9)))
        strange, sign = pii.signs(text)
        assert strange == bool(pii._STRANGE.search(text)) and sign == bool(pii._SIGN.search(text)), text
        seen += sign
    assert 1_000 < seen < 19_000
