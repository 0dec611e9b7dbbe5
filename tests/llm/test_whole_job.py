"""Registered queries and stages do the whole job, on small made-up tables."""

import random
from pathlib import Path

import brute
import pytest

import corpus_pipeline
from geodesis import workspace
from geodesis.llm import queries, similar, templates
from geodesis.workspace import session_conf
from test_text_operators import plain_template_drop

FOOTER = "Another closing line with number %d of them."


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        frame.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_a_document_with_short_lines_of_its_own_stays(spark, folder):
    given = {
        1: FOOTER % 17,
        2: "Entirely different words\n" + FOOTER % 93,
        3: "東京都は日本の首都である\n\n" + FOOTER % 5,
        4: " \n" + FOOTER % 6 + "\n",
    }
    made = folder(list(given.items()))
    found = {row.doc_id: row for row in queries.queries()["op6_line_templates"](spark, made).collect()}
    assert {key: row.text for key, row in found.items()} == {
        1: given[1],
        2: "Entirely different words",
        3: "東京都は日本の首都である\n",
        4: "",
    }
    assert {key: row.n_dropped for key, row in found.items()} == {1: 0, 2: 1, 3: 1, 4: 1}
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    fewer = stage(spark, queries.table(spark, made, "documents"), made).collect()
    assert {row.doc_id: row.text for row in fewer} == {key: found[key].text for key in (1, 2, 3)}


def plain_components(texts, width=5, percent=80):
    """Smallest id reachable over pairs of similar texts, by comparing all."""
    made = {}
    for key, text in sorted(texts.items()):
        words = brute.words(text.lower())
        made[key] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    links = [(a, b) for a in made for b in made if a < b and 100 * len(made[a] & made[b]) >= percent * len(made[a] | made[b])]
    found, before = {key: key for key in texts}, None
    while found != before:
        before = dict(found)
        for a, b in links:
            found[a] = found[b] = min(found[a], found[b])
    return found


def test_near_copies_go_and_others_stay(spark, folder):
    pick = random.Random(5)
    texts = {}
    for group in range(12):
        words = [f"w{pick.randrange(10**6)}" for _ in range(pick.choice([30, 120, 400]))]
        for _ in range(6):
            key = len(texts) * 7 % 72
            texts[key] = " ".join(words)
            # Copies of copies: the ends of a chain are not similar to each other.
            for _ in range(pick.choice([0, 1, len(words) // 50, len(words) // 25])):
                words[pick.randrange(len(words))] = f"w{pick.randrange(10**6)}"
    texts |= {100: "one two", 101: "One  TWO", 102: "one two three"}
    expected = plain_components(texts)
    assert 20 < len(set(expected.values())) < 60
    made = folder(list(texts.items()))
    single = dict(corpus_pipeline.STAGES)["near_dedup"](spark, queries.table(spark, made, "documents"), made)
    assert {row.doc_id: row.text for row in single.collect()} == {key: texts[key] for key in set(expected.values())}


def test_components_of_rows_without_words_or_id(spark):
    rows = [(3, None), (2, " \n"), (1, ""), (None, "a b"), (4, "a b"), (4, "a b"), (5, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(row.doc_id, row.component_id) for row in similar.similar_documents(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert similar.drop_similar(docs).count() == 5 and similar.drop_similar(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [400, 3])
def test_several_templates_of_one_leaf(spark, folder, monkeypatch, cell):
    monkeypatch.setattr(templates, "CELL", cell)
    pick = random.Random(7)
    word = lambda: "".join(pick.choices("abcdefgh", k=6))
    made = [
        lambda: f"You can also read the story of {word()} in our old paper",
        lambda: f"You can also write to the mayor of {word()} or call us",
        lambda: "You can also " + " ".join(word() for _ in range(9)),
        lambda: f"All pages of {word()} are kept " + "on this long list of many things we do not " * 2 + f"want to {word()} again",
        lambda: "All pages of " + " ".join(word() for _ in range(pick.choice([5, 14, 25]))),
    ]
    rows = [(key, pick.choice(made)()) for key in range(90)]
    lost = {key for key, _ in plain_template_drop(dict(rows), templates.Tree(several=True))}
    assert 30 < len(lost) < 60
    docs = folder(rows)
    found = queries.queries()["op6_line_templates"](spark, docs).collect()
    assert {row.doc_id for row in found if row.n_dropped} == lost
    fewer = dict(corpus_pipeline.STAGES)["line_dedup"](spark, queries.table(spark, docs, "documents"), docs)
    assert {row.doc_id for row in fewer.collect()} == {key for key, _ in rows} - lost


def fields(*changed):
    """A line of ten fields after the same beginning."""
    return "It has been " + " ".join(f"own{k}" if k in changed else f"word{chr(97 + k)}" for k in range(10))


def test_a_chain_of_similar_lines_keeps_what_nothing_left_is_like(spark, folder):
    swap = str.maketrans("0123456789", "abcdefghij")
    chain = [fields(), fields(0, 1), fields(0, 1, 2, 3), fields(0, 1, 2, 3, 4, 5), fields(0, 1, 2, 3, 4, 5, 6)]
    docs = folder([(key, line.translate(swap)) for key, line in enumerate(chain)])
    found = {row.doc_id: row.text for row in queries.queries()["op6_line_templates"](spark, docs).collect()}
    kept = {key for key, text in found.items() if text}
    assert 2 <= len(kept) < len(chain)
    agree = lambda a, b: sum(map(str.__eq__, chain[a].split()[3:], chain[b].split()[3:])) >= 8
    assert all(any(agree(key, other) for other in kept) for key in found)


def test_rows_that_share_an_id_lose_their_own_lines_only(spark, folder):
    shared, own = "A line that two documents have in common today", "A line that is found nowhere else at all"
    docs = folder([(1, shared), (2, shared), (2, own), (3, "Something about quite different matters here")])
    found = sorted((row.doc_id, row.text) for row in queries.queries()["op6_line_templates"](spark, docs).collect())
    assert found == [(1, shared), (2, ""), (2, own), (3, "Something about quite different matters here")]


def test_short_lines_recur_only_as_exact_repeats(spark, folder):
    point = "東京都は日本の首都であり世界でも最大級の都市です"
    rows = [(key, f"Read more here\nVery own words of text number {key}x\nChapter {key}") for key in range(templates.Tree().short_documents)]
    rows += [(50, point + "\nUnlike all the other texts here"), (51, point), (52, "Read less\nBut it is quite another text again")]
    rows += [(53, "Read less\nAs different as it can be made")]
    found = {row.doc_id: row.text for row in queries.queries()["op6_line_templates"](spark, folder(rows)).collect()}
    assert found[0].startswith("Read more here") and not any("Read more" in found[key] for key in range(1, 10))
    assert all(f"Chapter {key}" in found[key] for key in range(10))
    assert point in found[50] and found[51] == "" and "Read less" in found[52] and "Read less" in found[53]


def test_near_copies_are_no_evidence_of_a_template(spark, folder):
    pick = random.Random(3)
    line = lambda: " ".join("".join(pick.choices("abcdefghij", k=6)) for _ in range(12))
    body = [line() for _ in range(12)]
    near = [*body[:5], body[5] + " really", *body[6:]]
    other = [line() for _ in range(6)]
    rows = {1: [*other[:5], FOOTER % 1], 2: [*body, FOOTER % 2], 3: [*near, FOOTER % 3], 4: [*body, FOOTER % 4], 5: [line(), body[0]]}
    given = {key: "\n".join(lines) for key, lines in rows.items()}
    docs = folder(list(given.items()))
    stages = dict(corpus_pipeline.STAGES)
    fewer = stages["line_dedup"](spark, queries.table(spark, docs, "documents"), docs)
    texts = {row.doc_id: row.text for row in fewer.collect()}
    # The footer goes from all but the first; the copies otherwise stay whole.
    assert texts == {1: given[1], 2: "\n".join(body), 3: "\n".join(near), 4: "\n".join(body), 5: rows[5][0]}
    single = stages["near_dedup"](spark, spark.createDataFrame(list(texts.items()), fewer.schema), docs)
    assert {row.doc_id: row.text for row in single.collect()} == {key: texts[key] for key in (1, 2, 5)}


@pytest.mark.parametrize("cell", [similar.CELL, 60])
def test_a_large_group_of_near_copies_takes_few_checks(spark, monkeypatch, cell):
    from geodesis.workspace import Workspace

    monkeypatch.setattr(similar, "CELL", cell)
    pick = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for key in range(400):
        words = list(base)
        for _ in range(pick.choice([1, 2, 3, 4, 5])):
            words[pick.randrange(len(words))] = f"x{pick.randrange(10**6)}"
        texts[key] = " ".join(words)
    made = {}
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, name, *a, **b: made.setdefault(name, save(self, name, *a, **b)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {row.doc_id: row.component_id for row in similar.similar_documents(docs).collect()}
    assert found == plain_components(texts) and 1 < len(set(found.values())) < 200
    # All pairs would be 79,800; those that may be similar are a third of them.
    assert sum(seen["rows"] for name, seen in made.items() if name.endswith("_pairs")) < 30_000
    assert not any(name.startswith("cells_3") for name in made)


def borderline(count):
    """Texts of which many pairs are nearly, but not quite, similar enough."""
    pick = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for key in range(count):
        words = list(base)
        for place in pick.sample(range(200), 5):
            words[place] = f"x{pick.randrange(10**6)}"
        texts[key] = " ".join(words)
    return texts


def test_pairs_of_a_group_that_is_not_quite_similar_are_not_written(spark, monkeypatch):
    from geodesis.workspace import Workspace

    texts = borderline(300)
    made = {}
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, name, *a, **b: made.setdefault(name, save(self, name, *a, **b)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {row.doc_id: row.component_id for row in similar.similar_documents(docs).collect()}
    assert found == plain_components(texts)
    # A class is held against the smallest of each of its buckets; no pair is written after that.
    assert sum(seen["rows"] for name, seen in made.items() if name.endswith("_pairs")) <= similar.BANDS * len(texts)
    assert "round_0_pairs" not in made and made["cell_links"]["rows"] < similar.BANDS * len(texts)


def test_near_duplicates_go_through_simhash(spark, folder, monkeypatch):
    from geodesis.llm import simhash

    joined = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda classes, *a: joined.append(sorted(row.bits for row in classes.collect())) or links(classes, *a))
    words = [f"w{k}" for k in range(120)]
    texts = {1: " ".join(words), 2: " ".join(words).upper(), 3: " ".join(words[:-1]), 4: " ".join(words[::-1])}
    made = folder(list(texts.items()))
    single = dict(corpus_pipeline.STAGES)["near_dedup"](spark, queries.table(spark, made, "documents"), made)
    assert {row.doc_id for row in single.collect()} == {1, 4}
    signed = {simhash.fingerprint(text, similar.WIDTH) for text in texts.values()}
    assert joined == [sorted(bits - (bits >> 63 << 64) for bits in signed)]


@pytest.mark.parametrize("printed", [False, True])
def test_near_copies_leave_only_the_tables_they_are_read_from(spark, printed):
    before = set(workspace._roots)
    words = [random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=60) for k in range(3)]
    texts = [" ".join(words[k % 3] + ["end"] * (k > 5)) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = similar.similar_documents(docs, printed=printed)
    left = sorted(path.name for root in set(workspace._roots) - before for path in Path(root).iterdir())
    assert left == ["components", "texts"]
    assert {row.doc_id: row.component_id for row in found.collect()} == {k: k % 3 for k in range(12)}


def _exchanges(frame):
    """The shuffles of a plan that nothing is broadcast in on the strength of its size."""
    with session_conf(frame.sparkSession, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = frame.filter("true")._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_texts_are_not_shuffled_for_few_ids(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    near = base[:30] + ["other"] + base[31:]
    texts = {1: " ".join(base), 2: " ".join(near), 3: "quite another text of seven words", 4: " ".join(base)}
    docs = spark.createDataFrame([*texts.items(), (4, "a second text of that number"), (None, "no number")], "doc_id long, text string")
    rows = docs.select("doc_id", docs.text.cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    hashes = {row.doc_id: row.whole for row in similar.sets(rows.filter("doc_id < 4")).collect()}
    wanted = spark.createDataFrame([(1, hashes[1]), (3, hashes[3])], "doc_id long, whole long")
    made = similar._sets_of(wanted, 2, rows, similar.WIDTH)
    # The ids are made distinct.
    assert len([line for line in _exchanges(made) if "(doc_id" in line]) == 1
    found = {row.whole: sorted(row.found) for row in made.collect()}
    assert found.keys() == {hashes[1], hashes[3]}

    kept = similar.drop_similar(docs)
    assert not _exchanges(kept)
    rows_kept = sorted(map(str, kept.collect()))
    # With more ids than go to every executor, the rest is the same.
    monkeypatch.setattr(similar, "FEW", 1)
    again = similar._sets_of(wanted, 2, rows, similar.WIDTH)
    assert len([line for line in _exchanges(again) if "(doc_id" in line]) == 2
    assert {row.whole: sorted(row.found) for row in again.collect()} == found
    assert sorted(map(str, similar.drop_similar(docs).collect())) == rows_kept


def test_all_that_simhash_links_goes(spark, folder):
    from geodesis.llm import simhash

    one, other = (" ".join(f"{x}{k}" for k in range(7)) + " " for x in "pq")
    tails = [" ".join(f"{x}{k}" for k in range(30)) for x in "abc"]
    # The second and the fourth have equal sets, but repeat other parts of them.
    texts = {1: one * 60 + tails[0], 2: one * 60 + other * 2, 3: other * 60 + tails[1], 4: one * 2 + other * 60, 5: tails[2]}
    bits = {key: simhash.fingerprint(text, similar.WIDTH) for key, text in texts.items()}
    assert (bits[1] ^ bits[2]).bit_count() <= 3 and (bits[3] ^ bits[4]).bit_count() <= 3 and (bits[2] ^ bits[4]).bit_count() > 6
    assert plain_components(texts) == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5}
    made = folder(list(texts.items()))
    single = dict(corpus_pipeline.STAGES)["near_dedup"](spark, queries.table(spark, made, "documents"), made)
    assert {row.doc_id: row.text for row in single.collect()} == {key: texts[key] for key in (1, 5)}
