import random

import pytest
from pyspark.sql import functions as F

from pitchframe.llm import decontamination as D


def index_of(rng, prose, items):
    made = [(i, prose(i, rng.randint(3, 50)), prose(i + 1000, rng.randint(1, 8))) for i in range(items)]
    counts = {}
    for _, q, a in made:
        for t in set(D.words_of(q) + D.words_of(a)):
            counts[t] = counts.get(t, 0) + 1
    idf = {t: D.log(1 + (items - n + 0.5) / (n + 0.5)) for t, n in counts.items()}
    return made, D.ItemIndex(made, idf, 30.0, 128)


def test_wand_retrieves_what_full_scoring_does(prose):
    rng = random.Random(6)
    made, index = index_of(rng, prose, 300)
    for trial in range(150):
        words = D.words_of(prose(rng.randrange(300), 60) if trial % 2 else prose(5000 + trial, 80))
        terms = sorted({index.number[w] for w in words if w in index.number})
        scores = {}
        for t in terms:
            for place, score in zip(*index.postings[t]):
                scores[place] = scores.get(place, 0.0) + score
        for threshold in (0.2, 0.5, 0.8):
            expected = {p for p, s in scores.items() if s >= threshold}
            found = dict(index.retrieve(terms, threshold))
            assert {p for p in expected if abs(scores[p] - threshold) > 1e-9} <= set(found) <= expected | set(found)
            assert all(found[p] == pytest.approx(scores[p]) for p in found)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, question string, answer string")


def test_finds_whole_items_and_leaves_partial_ones(spark, make_docs, prose):
    question, answer, long_item = prose(1, 30), "the answer is vorkalo", prose(2, 400)
    items = items_frame(spark, [(1, question, answer), (2, long_item, long_item), (3, "", ""), (4, None, None)])
    loud = f"{question.upper()}!\n{answer.title()}."
    rows = [
        (10, prose(50, 900) + " " + loud + " " + prose(51, 300)),
        (11, prose(52, 300) + " " + question + " " + prose(53, 300)),
        (12, prose(54, 300) + " " + answer),
        (13, prose(55, 70) + " " + long_item),
        (14, " ".join(long_item.split(" ")[:200])),
        (15, None),
        (16, ""),
        (None, loud),
        (17, loud),
        (17, loud),
    ]
    found = D.contaminated(make_docs(rows), items)
    got = sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str)
    assert got == sorted([(10, 1), (13, 2), (17, 1), (None, 1)], key=str)
    row = found.where("doc_id = 10").first()
    assert (row["question_overlap"], row["answer_overlap"]) == (1.0, 1.0) and row["score"] > 0.99


def test_windows_cross_the_stretches_of_a_long_text(spark, make_docs, prose, monkeypatch):
    item = prose(7, 60)
    _, index = index_of(random.Random(1), prose, 5)
    monkeypatch.setattr(D, "STRETCH", 700)
    made = [(1, item, item)]
    counts = {w: 1 for w in D.words_of(item)}
    index = D.ItemIndex(made, {t: 1.0 for t in counts}, 60.0, 128)
    for before in range(0, 300, 23):
        text = prose(90, before) + " " + item + " " + prose(91, 250)
        assert any(q >= 0.8 for _, _, q, _, _ in D.passages_of(index, text))


def test_empty_tables(spark, make_docs):
    some = items_frame(spark, [(1, "a b c d e f", "g")])
    assert D.contaminated(make_docs([]), some).count() == 0
    assert D.contaminated(make_docs([(1, "a b c d e f g")]), items_frame(spark, [])).count() == 0


def test_question_and_answer(spark):
    texts = ["One two. Three four?\nFive.", "Only one", "A. B"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    q, a = D.question_and_answer(F.col("text"))
    got = {tuple(r) for r in rows.select(q, a).collect()}
    assert got == {("One two. Three four", "Five."), ("Only one", "Only one"), ("A", "B")}


def fewest_edits(part, words):
    """Plain table of edit distances; a stretch may start and end anywhere."""
    row = [0] * (len(words) + 1)
    for n, word in enumerate(part, 1):
        above, row = row, [n]
        for k, other in enumerate(words, 1):
            row.append(min(above[k - 1] + (word != other), above[k] + 1, row[-1] + 1))
    return min(row)


def test_edits_against_the_plain_table(prose):
    rng = random.Random(4)
    for _ in range(300):
        part, words = (rng.choices("abcd", k=rng.randint(0, most)) for most in (12, 40))
        assert D.edits_of(part, words) == fewest_edits(part, words)


def test_copies_with_changed_words_against_brute_force(spark, make_docs, prose):
    rng = random.Random(11)
    parts = [(prose(i, rng.randint(14, 45)), prose(i + 500, rng.randint(1, 9))) for i in range(1, 25)]
    items = items_frame(spark, [(i, q, a) for i, (q, a) in enumerate(parts)])
    rows, planted = [], {}
    for i, (q, a) in enumerate(parts):
        for edits in (1, 2, 3):
            words = f"{q} {a}".split()
            for at in rng.sample(range(len(words)), edits):
                kind = rng.randrange(3)
                words[at] = (f"zz{at}", f"{words[at]} zz{at}", "")[kind]
            doc = 100 * edits + i
            planted[doc] = i
            rows.append((doc, f"{prose(doc + 3000, rng.randint(0, 260))} {' '.join(words)} {prose(doc + 6000, 90)}"))
    for i, (q, a) in enumerate(parts):  # other answers, and other questions
        rows += [(1000 + i, f"{q} {prose(i + 9000, 40)}"), (2000 + i, f"{prose(i + 9500, 40)} {a}")]
    expected = set()
    for doc, text in rows:
        words = D.words_of(text)
        for i, (q, a) in enumerate((D.words_of(q), D.words_of(a)) for q, a in parts):
            here, there = fewest_edits(q, words), fewest_edits(a, words)
            may = [len(p) if len(p) < 4 else max(len(p) // 5, min(3, len(p) // 2)) for p in (q, a)]
            if here <= may[0] and there <= may[1] and here + there <= (len(q) + len(a)) // 5:
                expected.add((doc, i))
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(make_docs(rows), items).collect()}
    assert got == expected
    assert sum((doc, i) in got for doc, i in planted.items()) >= 0.95 * len(planted)
    assert not any(doc >= 2000 for doc, _ in got)
    whole = {i for i, (_, a) in enumerate(parts) if len(a.split()) >= 4}
    assert whole and not any(doc - 1000 in whole for doc, _ in got if doc >= 1000)
