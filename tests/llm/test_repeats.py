import hashlib
import random

import numpy as np

from pitchframe.llm import repeats
from pitchframe.llm.repeats import remove_repeats, smallest_holders


def brute(rows, length):
    raw = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in raw:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for (d, t), (doc_id, _) in zip(raw, rows):
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < d:
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_index_gives_the_smallest_holder_of_every_string():
    rng = random.Random(3)
    for trial in range(60):
        letters, length = "ab" if trial % 2 else "abcdefgh", rng.choice([3, 5, 8])
        base = "".join(rng.choices(letters, k=60))
        made = set()
        for _ in range(rng.randint(1, 30)):
            at, n = rng.randint(0, 30), rng.randint(length, 20)
            made.add((base[at : at + n] if rng.random() < 0.5 else "".join(rng.choices(letters, k=n))).encode())
        segments = sorted(made)
        holders = np.array([rng.randint(0, 9) for _ in segments])
        least = {}
        for s, h in zip(segments, holders):
            for i in range(len(s) - length + 1):
                least[s[i : i + length]] = min(least.get(s[i : i + length], 99), h)
        for s, found in zip(segments, smallest_holders(segments, holders, length)):
            assert found.tolist() == [least[s[i : i + length]] for i in range(len(s) - length + 1)]


def test_like_brute_force(make_docs, prose, monkeypatch):
    rng = random.Random(8)
    shared = [prose(900 + i, 14) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(i, rng.randint(0, 40)), rng.choice(shared), prose(i + 500, rng.randint(0, 9)), rng.choice(shared)]
        rows.append((i, "é ".join(parts)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[3][1]), (None, rows[5][1]), (1000, "z" * 400), (1001, "z" * 90)]
    rng.shuffle(rows)
    got = remove_repeats(make_docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 50)


def test_awkward_rows(make_docs, awkward):
    got = remove_repeats(make_docs(awkward)).collect()
    expected = brute([(d, t) for d, t in awkward if not t or len(t) < 100], 50)
    assert [r for r in sorted(map(tuple, got), key=str) if r[1] < 100] == expected
    long_rows = {(r["doc_id"], r["n_bytes"] - r["n_removed"], r["n_spans"]) for r in got if r["n_bytes"] > 100}
    size = len(awkward[3][1])
    assert long_rows == {(4, size, 0), (5, 0, 1), (10, 70_000, 0)}
    assert remove_repeats(make_docs([])).count() == 0


def test_packs_and_parts_change_nothing(make_docs, prose, monkeypatch):
    rows = [(i, prose(i % 7, 30) + prose(i, 20)) for i in range(40)]
    segments = repeats._segments
    text = prose(1, 300).encode()
    data, doc_of = np.frombuffer(text, np.uint8), np.zeros(len(text), np.int64)
    whole = segments(data, doc_of, 0, 50, 24)
    assert whole[1].sum() == len(text) - 49
    assert sorted(map(tuple, remove_repeats(make_docs(rows)).collect()), key=str) == brute(rows, 50)


def test_a_phrase_in_different_text_fills_no_shard(make_docs, prose, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 1 << 12)
    rng = random.Random(5)
    phrase = "this very phrase stands in every document, always"
    rows = [(i, f"{prose(i, 20)} {phrase} {prose(i + 4000, 12)}") for i in range(150)]
    # Strings with the phrase that do repeat, whatever side they reach out to.
    for i in range(150, 190):
        given, at = rows[rng.randrange(150)][1], rng.randint(1, 60)
        rows.append((i, f"{prose(i, 9)} {given[at : at + rng.randint(50, 190)]}"))
    rows += [(500, phrase * 5), (501, phrase * 4), (None, rows[7][1])]
    docs = make_docs(rows)
    assert sorted(map(tuple, remove_repeats(docs, hot=20).collect()), key=str) == brute(rows, 50)
    packs = repeats.make_packs(docs.select("doc_id", "text")).localCheckpoint()
    flags = repeats.repeated_minimizers(packs, 3, 50, 24, 20)
    held, strings = {}, 0
    for row in packs.join(flags, "pack", "left").collect():
        data, _, _, segments = repeats._opened(row, 50, 24)
        repeats._only_repeated(segments, 3, row["all"])
        strings += len(segments.take_hot(data, 50, 3).at)
        for minimizer in segments.hash.tolist():
            held[minimizer] = held.get(minimizer, 0) + 1
    assert strings > 1000 and max(held.values()) <= 20
