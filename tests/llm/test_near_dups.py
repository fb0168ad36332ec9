import random
import re
from collections import Counter, defaultdict

from pitchframe.llm import near_dups
from pitchframe.llm.components import components
from pitchframe.llm.near_dups import near_duplicates


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, percent):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for shingle in s for j in holders[shingle] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        known = [e for e in groups[find(i)] if e is not None]
        first = d if not sets[i] else min(known, default=None)
        out.append((d, len(sets[i]), first, d == first))
    return sorted(out, key=str)


def edited(text, rng, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_are_those_of_all_pairs(make_docs, prose):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = prose(g, 250)
        rows.append((g, base))
        rows += [(100 + g * 30 + k, edited(base, rng, rng.randrange(9))) for k in range(12)]
    rng.shuffle(rows)
    got = near_duplicates(make_docs(rows), percent=85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 85)


def test_awkward_rows(make_docs, awkward):
    got = near_duplicates(make_docs(awkward)).collect()
    assert sorted(map(tuple, got), key=str) == brute(awkward, 85)
    assert near_duplicates(make_docs([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_words_that_a_polynomial_confuses(make_docs):
    """The Thue-Morse word and its complement agree in every polynomial modulo 2^64 from 2^10 letters on."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    found = near_duplicates(make_docs([(1, word), (2, word.translate(str.maketrans("ab", "ba")))])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found} == {(1, 1, True), (2, 2, True)}


def test_rows_without_ids_meet_their_own_text_only(make_docs, prose, monkeypatch):
    seen = []
    inner = near_dups.common_counts
    monkeypatch.setattr(near_dups, "common_counts", lambda sets: seen.append(sets) or inner(sets))
    texts = [f"{prose(i % 200, 30)} {'x' if i >= 200 else 'y'}" for i in range(400)]
    found = near_duplicates(make_docs([(None, t) for t in texts])).collect()
    assert len(found) == 400 and all(r["component_id"] is None for r in found)
    assert seen[0].count() == len(set(texts))


def test_two_groups_in_one_bucket_take_few_rounds(make_docs, prose, monkeypatch):
    """Groups of many nodes that meet in buckets and have no link between them."""
    rng, kinds = random.Random(9), []
    base = prose(77, 200).split(" ")
    for g in range(2):
        kinds.append(" ".join(base[:40] + [f"group{g}x{i}" for i in range(40)] + base[80:]))
    rows = [(g * 100 + k, edited(kinds[g], rng, 1)) for g in range(2) for k in range(30)]
    rounds = []
    inner = near_dups.settle

    def counted(df, name, path=None):
        rounds.append(name)
        assert rounds.count("pairs") <= 5
        return inner(df, name, path)

    monkeypatch.setattr(near_dups, "settle", counted)
    got = near_duplicates(make_docs(rows), percent=85, rows=4).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 85)
    assert rounds.count("pairs") > 1
