import base64
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from geodesis.llm import byte_bpe, langid, packing, pii, quality, simhash, templates, token_counts, topk, urls
from geodesis.llm.queries import BYTE_RANKS, PIECE_MODEL, RULES, WORD_TOKENIZER

LABELS = "doc_id long, quality int, toxic int"


def rows_of(frame):
    return Counter(tuple(row) for row in frame.collect())


# -- SimHash ------------------------------------------------------------------


def test_fingerprints_and_components_of_odd_rows(spark):
    found = simhash.near_duplicates(brute.odd(spark)).collect()
    prints = {row[0]: brute.fingerprint(row[1]) for row in brute.odd_rows() if row[0] is not None}
    expected = brute.components(prints)
    assert len(found) == len(brute.odd_rows())
    for row in found:
        if row.doc_id is not None:
            assert row.bits % 2**64 == prints[row.doc_id]
            assert row.component_id == expected[row.doc_id]
    assert {row.component_id for row in found if row.doc_id is None} == {1, None}
    empty = brute.odd(spark).limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(brute.odd(spark))
    assert kept.columns == brute.odd(spark).columns
    stay = {key for key, first in expected.items() if key == first}
    assert {row.doc_id for row in kept.collect()} == stay | {None}


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_links_of_many_fingerprints(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "CELL", 20)
    pick = random.Random(bits)
    prints = [0, 2**64 - 1]
    for _ in range(25):
        prints.append(pick.getrandbits(64))
    while len(prints) < 350:  # chains and dense groups around earlier ones
        near = pick.choice(prints)
        for _ in range(pick.choice([1, 2, 3, 4])):
            near ^= 1 << pick.randrange(64)
        prints.append(near)
    prints = {key: value for key, value in enumerate(dict.fromkeys(prints))}
    rows = [(value - (value >> 63 << 64), key) for key, value in prints.items()]
    tables = simhash.Workspace(spark, "test")
    links = simhash._links(spark.createDataFrame(rows, "bits long, rep long"), tables, bits)
    merged = {row.node: row.component for row in simhash.smallest_reachable(links, tables).collect()}
    assert {key: merged.get(key, key) for key in prints} == brute.components(prints, bits)
    assert links.count() <= (bits + 1) * len(prints) * 20


def test_walk_keeps_no_pairs():
    codes = np.sort(np.unique(np.random.default_rng(1).integers(0, 2**11, 1500).astype(np.uint64)))
    label = simhash.hanging_together(codes, np.array([0]), 16, 3)
    assert set(label) == {0}


# -- personal data ------------------------------------------------------------

DISGUISED = [
    ("write to jane.doe (at) mail (dot) example (dot) com today", "email", "jane.doe (at) mail (dot) example (dot) com"),
    ("jane at mail dot example dot com", "email", "jane at mail dot example dot com"),
    ("an: jane [at] mail.example.de!", "email", "jane [at] mail.example.de"),
    ("x jаne@mail.example.com y", "email", "jаne@mail.example.com"),
    ("ｊａｎｅ＠ｍａｉｌ．ｃｏｍ", "email", "ｊａｎｅ＠ｍａｉｌ．ｃｏｍ"),
    ("call plus one two one two five five five zero one nine nine now", "phone", "plus one two one two five five five zero one nine nine"),
    ("ip 10 dot 20 dot 30 dot 40.", "ip", "10 dot 20 dot 30 dot 40"),
    ("card four one one one one one one one one one one one one one one one!", "card", "four one one one one one one one one one one one one one one one"),
    ("🎉 ４１１１ １１１１ １１１１ １１１１ 🎉", "card", "４１１１ １１１１ １１１１ １１１１"),
]
CLEAN = [
    "We met at noon and looked at the dot on the map.",
    "Look at this: one two three, then four (at most) five.",
    "Un point de vue, de trois à quatre; le point final.",
    "Version 1.2.3 at level 4",
]


@pytest.mark.parametrize("text, kind, value", DISGUISED)
def test_disguises_are_mapped_back(text, kind, value):
    found = [(k, text[a:b]) for k, a, b, base in pii.spans(text) if not base]
    assert (kind, value) in found


@pytest.mark.parametrize("text", CLEAN)
def test_clean_prose_holds_nothing(text):
    assert pii.spans(text) == []


def test_plain_spans_agree_with_patterns():
    pick = random.Random(5)
    marks = "0123456789.+-@ ()aZ_%\n" + "é"
    for _ in range(3000):
        text = "".join(pick.choices(marks, weights=[3] * 10 + [6, 3, 3, 2, 4, 1, 1, 2, 1, 1, 1, 1, 1], k=pick.randrange(60)))
        assert pii.plain(text) == brute.plain_spans(text)
    for text in ("4111 1111 1111 1111 a@b.c 1.2.3.4.5.6.7.8 +1 (234) 567-8901", "a@b@c.d.e", "9.9.9.999", "+1((((((((2"):
        assert pii.plain(text) == brute.plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" + "1(" * 150_000, "one " * 60_000, "(at) " * 60_000, "a at " * 60_000):
        pii.spans(text)


def test_find_and_redact_tables(spark):
    rows = [(1, "a@b.com", 5), (2, None, 6), (3, "", 7), (4, "no data", 8), (None, "+1 (234) 567-8901", 9), (1, "a@b.com", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found = pii.find(docs).select("doc_id", pii.listed(F.col("spans")))
    assert rows_of(found) == Counter({(1, "email:0:7"): 2, (2, ""): 1, (3, ""): 1, (4, ""): 1, (None, "phone:0:17"): 1})
    fresh = pii.redact(docs)
    assert fresh.columns == docs.columns
    assert rows_of(fresh) == Counter({(1, "[EMAIL]", 5): 2, (2, None, 6): 1, (3, "", 7): 1, (4, "no data", 8): 1, (None, "[PHONE]", 9): 1})
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
    assert pii.find(brute.odd(spark)).count() == len(brute.odd_rows())


# -- language -----------------------------------------------------------------

TONGUES = {
    "en": "the of and to in that is was for with he as on at by this had not are but from they which you one were her all there".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas une sur plus par les avec tout".split(),
    "es": "el la de que y a en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este".split(),
}


def spoken(count, seed):
    pick = random.Random(seed)
    return [(k, " ".join(pick.choices(TONGUES[lang], k=pick.randrange(8, 40))), lang) for k in range(count) for lang in [pick.choice(list(TONGUES))]]


def test_languages_held_out(spark):
    docs = spark.createDataFrame(spoken(600, 1), "doc_id long, text string, lang string")
    found = langid.predict_languages(docs, F.col("doc_id") % 4 != 2).join(docs, "doc_id").filter("doc_id % 4 = 2")
    right = found.filter("lang = lang_pred").count()
    assert right >= 0.97 * found.count()
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_languages_of_odd_rows(spark):
    learned = langid.predict_languages(brute.odd(spark), F.lit(True)).collect()
    assert len(learned) == len(brute.odd_rows())
    by_id = {row.doc_id: row.lang_pred for row in learned if row.doc_id is not None}
    assert {by_id[3], by_id[4], by_id[5]} == {"und"} and by_id[6] == "en"
    nothing = langid.predict_languages(brute.odd(spark), F.lit(False))
    assert {(row.lang_pred, row.score) for row in nothing.collect()} == {("und", 0.0)}
    assert langid.predict_languages(brute.odd(spark).limit(0), F.lit(True)).count() == 0


def test_predictions_do_not_see_labels(spark):
    docs = spark.createDataFrame(spoken(300, 2), "doc_id long, text string, lang string")
    blind = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 2, F.col("lang")))
    learn = F.col("doc_id") % 4 != 2
    assert rows_of(langid.predict_languages(docs, learn)) == rows_of(langid.predict_languages(blind, learn))


# -- token counts -------------------------------------------------------------


def test_token_counts(spark):
    with open(PIECE_MODEL, "rb") as file:
        scores = token_counts.piece_scores(file.read())
    byte = min(scores.values()) - 10
    found = {row.doc_id: row for row in token_counts.count_tokens(brute.odd(spark), PIECE_MODEL).collect()}
    for key, text, *_ in brute.odd_rows():
        if key is not None and key != 7:
            listed = brute.words(text)
            assert found[key].n_words == len(listed)
            assert found[key].n_tokens == sum(n * brute.unigram("▁" + word, scores, byte) for word, n in Counter(listed).items())
    assert token_counts.count_tokens(brute.odd(spark).limit(0), PIECE_MODEL).count() == 0


def test_trie_is_begun_anew_and_long_tokens_agree():
    scores = {"▁a": -1.25, "a": -1.0, "ab": -1.5, "abc": -4.0, "b": -2.0, "c": -2.0, "bc": -2.5}
    small, large = token_counts.Trie(scores, nodes=5), token_counts.Trie(scores)
    pick = random.Random(3)
    for size in [1, 2, 3, 5, 9] * 20 + [300, 700]:
        word = "".join(pick.choices("abcé", k=size))
        count = brute.unigram("▁" + word, scores, large.byte)
        assert small.count(word.encode()) == large.count(word.encode()) == count


# -- quality ------------------------------------------------------------------


def test_base_counts_of_odd_rows(spark):
    found = quality.judge(brute.odd(spark), spark.createDataFrame([], LABELS)).collect()
    assert len(found) == len(brute.odd_rows())
    for row in found:
        counts = brute.base_counts(row.row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        assert row.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert row.score == 0 and row.kept == (not row.base_failed)
    assert quality.judge(brute.odd(spark).limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_repeated_windows(spark):
    pick = random.Random(9)
    texts = [" ".join(pick.choices(["a", "b", "c", "dd"], k=pick.randrange(40))) + "\n" * pick.randrange(3) + "a b\na b" for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality.judge(docs, spark.createDataFrame([], LABELS)).collect():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute.base_counts(row.row.text)


def test_scores_agree_with_plain_counts(spark):
    """The same sums by hand, with n-grams as strings: without bucket clashes the scores are equal."""
    rules = quality.Rules(buckets=1 << 16)
    texts = {k: " ".join(f"{'good' if k % 3 else 'bad'}{j % 7} the {'' if k % 3 else '###'}" for j in range(40)) for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(20)] + [(None, 1, 0), (99, None, None)], LABELS)

    def grams(text):
        tokens = re.findall(r"[^\W_]+|[^\w\s]+", text)
        return tokens + list(zip(tokens, tokens[1:]))

    raw = Counter(gram for text in texts.values() for gram in grams(text))
    good = Counter(gram for k in range(20) if k % 3 for gram in grams(texts[k]))
    weight = rules.smoothing * rules.buckets

    def ratio(gram):
        share = (raw[gram] + rules.smoothing) / (raw.total() + weight)
        return np.log((good[gram] + weight * share) / (good.total() + weight) / share)

    found = {row.row.doc_id: row for row in quality.judge(docs, labels, rules).collect()}
    for k, text in texts.items():
        listed = grams(text)
        assert found[k].score == pytest.approx(sum(map(ratio, listed)) / len(listed), abs=1e-9)
    between = (max(found[k].score for k in texts if k % 3 == 0) + min(found[k].score for k in texts if k % 3)) / 2
    strict = quality.Rules(threshold=between, most_repeated=1000)
    kept = {row.doc_id for row in quality.keep_good(docs, labels, strict).collect()}
    assert kept == {k for k in texts if k % 3}


# -- line templates -----------------------------------------------------------


def plain_template_drop(docs, tree, part_of=None):
    """The rule over strings, without hashes: ``(doc, line number)`` that go.
    ``part_of`` tells which documents count as one."""
    lines, owners, hashed = {}, defaultdict(set), {}
    for key, text in docs.items():
        for number, line in enumerate((text or "").split("\n")):
            tokens = brute.words(line)
            if len(tokens) < tree.least_tokens:
                if tokens:
                    owners["short", " ".join(tokens)].add((key, number))
                continue
            tokens = ["<*>" if re.search("[0-9]", token) else token for token in tokens]
            rest = tokens[tree.leading :]
            count = min(tree.fields, len(rest))
            cuts = [len(rest) * k // count for k in range(count + 1)]
            fields = tuple(" ".join(rest[a:b]) for a, b in zip(cuts, cuts[1:]))
            whole = " ".join(tokens)
            lines[whole] = ((len(tokens), *tokens[: tree.leading]), fields)
            hashed[whole] = templates.line_keys(line.encode(), tree)[1]
            owners[whole].add((key, number))
    part = lambda key: (part_of or {}).get(key, key)
    parts = {whole: {part(key) for key, _ in at} for whole, at in owners.items()}
    low = {whole: min(found) for whole, found in parts.items()}
    leaves = defaultdict(list)
    for whole, (leaf, fields) in lines.items():
        leaves[leaf].append((whole, fields))
    first, enough = {}, lambda fields: -(-tree.similarity * len(fields) // 1)
    for members in leaves.values():
        if len(members) < 2:
            continue
        held = [Counter(column).most_common(1)[0] for column in zip(*(fields for _, fields in members))]
        made = [value if 2 * n > len(members) else None for value, n in held]
        same = [whole for whole, fields in members if sum(a == b for a, b in zip(fields, made)) >= enough(fields)]
        if tree.several and same:
            stand = lines[min(same, key=lambda whole: (low[whole], hashed[whole]))][1]
            same = [whole for whole in same if sum(map(str.__eq__, lines[whole][1], stand)) >= enough(stand)]
        taken = {}
        if len(set().union(*(parts[whole] for whole in same))) > 1:
            taken = dict.fromkeys(same, min(low[whole] for whole in same))
        first |= taken
        stay = [(whole, fields) for whole, fields in members if taken.get(whole) == low[whole]]
        for whole, fields in sorted(members, key=lambda x: low[x[0]]) if tree.several else ():
            if whole not in taken:
                likes = [low[x] for x, other in stay if low[x] < low[whole] and sum(map(str.__eq__, fields, other)) >= enough(fields)]
                if likes:
                    first[whole] = min(likes)
                else:
                    stay.append((whole, fields))
    for whole, found in parts.items():
        short = isinstance(whole, tuple) and len(whole[1]) < tree.least_points
        if len(found) >= (tree.short_documents if short else 2):
            first[whole] = min(first.get(whole, low[whole]), low[whole])
    return {at for whole, keep in first.items() for at in owners[whole] if part(at[0]) != keep}


def left_over(key, text, gone, tree, least=None):
    """What a text is without its lines that go; None as it was."""
    if text is None or not any(at[0] == key for at in gone):
        return text
    stay = [line for number, line in enumerate(text.split("\n")) if (key, number) not in gone]
    return "\n".join(stay) if any(len(brute.words(line)) >= (least or tree.least_tokens) for line in stay) else ""


def test_templates_agree_with_the_rule_over_strings(spark):
    pick = random.Random(4)
    made = [
        lambda: f"User {pick.randrange(99)} logged in from host {pick.choice('abc')}{pick.randrange(9)} at port {pick.randrange(9)}",
        lambda: f"Terms of use apply to {pick.choice(['this', 'that', 'every', 'any'])} page and all parts of it without exception whatsoever today",
        lambda: " ".join(pick.choices("the of and to in".split(), k=pick.randrange(3, 9))),
        lambda: "short line",
        lambda: f"short line {pick.randrange(9)}",
        lambda: f"一二三四五六七八九十一二三四五六七八九{pick.randrange(20)}",
        lambda: "",
    ]
    docs = {k: "\n".join(pick.choice(made)() for _ in range(pick.randrange(6))) for k in range(120)}
    gone = plain_template_drop(docs, templates.Tree())
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {row.doc_id: row for row in templates.drop_recurring_lines(frame, count="n").collect()}
    assert len(gone) > 50
    for key, text in docs.items():
        assert found[key].text == left_over(key, text, gone, templates.Tree())
        assert found[key].n == sum(at[0] == key for at in gone)
    emptied = {key for key, row in found.items() if row.n and not row.text}
    assert emptied
    fewer = templates.drop_recurring_lines(frame, drop_emptied=True).collect()
    assert {row.doc_id: row.text for row in fewer} == {key: row.text for key, row in found.items() if key not in emptied}


def test_templates_of_odd_rows(spark):
    docs = brute.odd(spark)
    found = templates.drop_recurring_lines(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    texts = {row.doc_id: row.text for row in found.collect() if row.doc_id is not None}
    given = {row[0]: row[1] for row in brute.odd_rows() if row[0] is not None}
    gone = plain_template_drop(given, templates.Tree())
    for key, text in given.items():
        assert texts[key] == left_over(key, text, gone, templates.Tree())
    assert texts[1] == given[1] and texts[2] == "" and texts[11] == "Entirely different words here"
    assert templates.drop_recurring_lines(docs.limit(0)).count() == 0


# -- urls ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://WWW.Example.com/en/1?x#y", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
        ("https://a.example.com/en/1", ("a.example.com", "/en/1", "example.com/en/", "block")),
        ("http://badexample.com/en/", ("badexample.com", "/en/", "com/", "allow")),
        ("http://x.net/es/1", ("x.net", "/es/1", "net/es/", "block")),
        ("http://x.com", ("x.com", "", None, "allow")),
        ("http://xxx.org/a", ("xxx.org", "/a", None, "block")),
        ("http://xxxl.org/a", ("xxxl.org", "/a", None, "allow")),
        ("http://free-free.org/", ("free-free.org", "/", None, "allow")),
        ("http://FREE-bets.org/", ("free-bets.org", "/", None, "block")),
        ("no scheme/free/bets", ("", "", None, "block")),
        ("://", ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
    ],
)
def test_url_verdicts(spark, url, expected):
    pages = spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, html string, host string")
    row = urls.judge_urls(pages, RULES).first()
    assert (row.host, row.path, row.rule, row.verdict) == expected


def test_urls_of_nobody(spark):
    pages = spark.createDataFrame([(None, "http://a.org/x"), (2, "h" * 100_000), (2, "h" * 100_000)], "page_id long, url string")
    assert urls.judge_urls(pages, RULES).count() == 3
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0
    assert urls.judge_urls(pages, [], urls.Terms((), ())).filter("verdict = 'allow'").count() == 3


# -- byte-level BPE -----------------------------------------------------------


def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_of_odd_rows(spark):
    known = reference_encoding()
    encoded = byte_bpe.encode(brute.odd(spark), BYTE_RANKS, public_tokenizers.PATTERN)
    found = byte_bpe.decode(encoded, BYTE_RANKS, public_tokenizers.PATTERN).collect()
    expected = Counter((row[0], np.array(known.encode_ordinary(row[1] or ""), "<u4").tobytes(), (row[1] or "").encode()) for row in brute.odd_rows() if row[0] != 7)
    assert Counter((row.doc_id, bytes(row.ids), bytes(row.decoded)) for row in found if row.doc_id != 7) == expected
    assert byte_bpe.encode(brute.odd(spark).limit(0), BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_random_texts():
    known = reference_encoding()
    words = byte_bpe.Vocabulary(byte_bpe.read_ranks(BYTE_RANKS), public_tokenizers.PATTERN)
    pick = random.Random(6)
    marks = "aaabbcdeéß東🎉́ \t\n\r\x0b\x1c\x85\xa0 'stvm01.,!|​" + "   eeeth"
    texts = ["".join(pick.choices(marks, k=pick.randrange(80))) for _ in range(3000)]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert words.decode(ids) == text.encode()


def test_replay_follows_ranks_where_a_merge_opens_a_lower_one():
    ranks = {bytes([k]): k + 10 for k in range(256)} | {b"abc": 1, b"bc": 5, b"bcbc": 3, b"aa": 4, b"aaa": 2}
    words = byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)

    def plain(word):
        parts = [word[k : k + 1] for k in range(len(word))]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[part] for part in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    pick = random.Random(8)
    listed = [bytes(pick.choices(b"abc", k=pick.randrange(1, 30))) for _ in range(2000)]
    assert [x.tolist() for x in words.replay(listed)] == [plain(word) for word in listed]


# -- top k --------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [topk.Sizes(), topk.Sizes(sample=5, heads=3, group=2, chunk=16, block=7)])
def test_largest_products(spark, sizes):
    make = np.random.default_rng(3)
    vectors = [(k, (make.normal(size=12) * make.choice([0.05, 0.3, 2])).round(2).tolist()) for k in range(300)]
    vectors += [(300, None), (301, [1.0, None] * 6), (302, [float("nan")] * 12), (350, [float("inf")] * 12), (None, [1.0] * 12)]
    vectors += [(400 + k, vectors[7][1]) for k in range(8)] + [(450, [0.0] * 12), (500, vectors[50][1])]
    frame = spark.createDataFrame([(k, x, "s") for k, x in vectors], "vec_id long, embedding array<double>, score string")
    found = defaultdict(list)
    for row in topk.largest_products(frame, F.col("vec_id") % 50 == 0, sizes=sizes).orderBy("query_id", "rank").collect():
        found[row.query_id].append((row.vec_id, row.score))
        assert row["rank"] == len(found[row.query_id])
    assert found == brute.top_products(vectors, 50)


def test_products_of_few_uneven_and_huge_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    run = lambda rows: [tuple(row) for row in topk.largest_products(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).collect()]
    assert run([]) == [] and run([(0, [1.0])]) == []
    assert run([(0, [1.0, 1.0]), (1, [1.0]), (2, [1.0]), (2, [1.0]), (3, [])]) == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536), (0, 4, 3, 0)]
    assert run([(0, [1.0]), (1, [1e7]), (2, [2e7])]) == [(0, 1, 2, 1_310_720_000_000), (0, 2, 1, 655_360_000_000)]
    large = [(0, [3e6, 1.0, 0.0]), (1, [2e7, -1 / 256, 1e300]), (2, [2e7, 0.0, -1e300]), (3, [2e7 + 1 / 256, 0.0, 0.0])]
    scores = {key: 768 * 10**6 * int(256 * x[0]) + 256 * int(256 * x[1]) for key, x in large[1:]}
    assert max(scores.values()) > 1 << 53 and run(large) == [(0, 1, 3, scores[3]), (0, 2, 2, scores[2]), (0, 3, 1, scores[1])]
    with pytest.raises(Exception, match="too large for a long"):
        run([(0, [1e6] * 3), (1, [1e6] * 3), (2, [1e300])])
    with pytest.raises(Exception, match="too large for a double"):
        run([(0, [1.0]), (1, [1e307])])
    # What does not fit is no matter where it is not returned.
    many = [(0, [1e9, 1.0])] + [(key, [0.0, float(key)]) for key in range(1, 8)] + [(9, [-1e300, 0.0])]
    assert [row[2] for row in run(many)] == [7, 6, 5, 4, 3]


def test_a_full_group_of_queries_is_held_against_a_block_in_slices():
    import tracemalloc

    make = np.random.default_rng(1)
    vectors = make.integers(-300, 300, (65_536, 16)).astype(float)
    best = topk.Best(np.arange(len(vectors)), vectors, topk.Rotation(vectors[:100]), np.full(len(vectors), -np.inf), 5)
    tracemalloc.start()
    best.bars[:] = 4e5
    assert best.offer(np.arange(1 << 20, (1 << 20) + 1024), vectors[:1024])
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


# -- packing ------------------------------------------------------------------


def check_packing(rows, texts, room):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(WORD_TOKENIZER)
    filled, total, expected = defaultdict(list), 0, Counter()
    for row in rows:
        filled[row.sequence_id].append((row.offset, row.length))
    for key, text in texts:
        ids = tokens.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), room)):
            part = ids[start : start + room]
            expected[key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(row)[:5] for row in rows) == expected
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= room
    return len(filled), -(-total // room)


def test_words_of_one_batch_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    with open(WORD_TOKENIZER, "rb") as file:
        tokens = packing.WordTokens(file.read())
    texts = [f"Wort{chr(97 + k % 26) * (k % 7 + 1)}{chr(97 + k // 26)}{'!?' * (k % 3)} {chr(233 + k % 9)}T{k}." for k in range(400)]
    found = list(tokens.encode([text.encode() for text in texts]))
    assert found == [tokens._ids(text) for text in texts]
    assert len(tokens._words) <= 51 and len(tokens._letters) <= 51


def test_packing_of_odd_rows(spark):
    texts = [(row[0], row[1]) for row in brute.odd_rows()]
    check_packing(packing.pack_documents(brute.odd(spark), WORD_TOKENIZER).collect(), texts, 2048)
    check_packing(packing.pack_documents(brute.odd(spark), WORD_TOKENIZER, room=16, places=2).collect(), texts, 16)
    kept = packing.pack_documents(brute.odd(spark), WORD_TOKENIZER, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(row.ids)) == row.ids_crc32 for row in kept)
    assert packing.pack_documents(brute.odd(spark).limit(0), WORD_TOKENIZER).count() == 0


def test_packing_is_tight(spark):
    pick = random.Random(2)
    texts = [(k, "the " * int(min(5000, pick.expovariate(1 / 300)))) for k in range(2000)]
    rows = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), WORD_TOKENIZER).collect()
    used, least = check_packing(rows, texts, 2048)
    assert used <= 1.02 * least + 1


def test_packer_takes_the_best_fit_and_closes_the_fullest():
    packer = packing.Packer(10, 2)
    assert [packer.place(x) for x in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [packer.place(x) for x in (8, 6, 5, 2, 4)] == [(2, 0), (3, 0), (4, 0), (3, 6), (4, 5)]
    with pytest.raises(ValueError):
        packing.Packer(10, 2).place(11)


def test_special_marks_in_a_text(spark):
    texts = [(1, "a <|endoftext|> b"), (2, "x<|startoftext|>y z"), (3, "<|startoftext|>")]
    check_packing(packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), WORD_TOKENIZER).collect(), texts, 2048)


