"""Tokenizer alignment against all overlapping pairs of tokens of whole encoded texts."""

import hashlib
import random
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest

from pitchframe.llm import alignment
from pitchframe.llm.alignment import Run, align_tokens, byte_alphabet, merge, pack, steps, unpack

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """[(id, start, end)] of both sides, or None."""
    a, b = libraries()
    alphabet = byte_alphabet()
    found = [[(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]]
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    found.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
    if any(b"".join(raw for _, raw in side) != (" " + text).encode() for side in found):
        return None
    sides = []
    for side in found:
        ends = np.cumsum([len(raw) for _, raw in side]).tolist()
        sides.append([(i, end - len(raw), end) for (i, raw), end in zip(side, ends)])
    return sides


def expected(rows):
    linked, holders = [], Counter()
    for doc_id, text in rows:
        sides = tokens(text) if text else None
        pairs, groups = [], []
        if sides:
            a, b = sides
            j0 = 0
            for i, s, e in a:
                while b[j0][2] <= s:
                    j0 += 1
                j = j0
                while j < len(b) and b[j][1] < e:
                    pairs.append((i, b[j][0]))
                    j += 1
            cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
            for start, end in zip([0, *cuts], cuts):
                groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in sides))
        linked.append((doc_id, sides, pairs, groups))
        holders.update(set(pairs))
    best = Counter()
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    for doc_id, sides, pairs, groups in linked:
        lengths = [len(s) for s in sides] if sides else [0, 0]
        yield (
            doc_id,
            *lengths,
            len(groups),
            len(pairs),
            sum(holders[p] == best[p[0]] for p in pairs),
            sum(holders[p] for p in pairs),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if sides else "",
        )


AWKWARD = [
    "", None, " ", "  ", " a", "a ", "a  b", "a\n b", "a\tb c", "\n", "été ñ 漢字 \U0001f600 end", "x y z", "▁ a▁b c",
    "<|endoftext|> <s> x </s>", "it's we'll don't  stop", "a​ b", "1234567 89.5, (x) -- y", "tab\t \t end", "\x1c a \x1f b", "\x00 \x01",
    "y" * 3_000, "Ａｂ ﬁ ½", "é ä", "a\r\nb c",
]


def found(make_docs, rows):
    return sorted((tuple(r) for r in align_tokens(make_docs(rows), A, B).select(*NAMES).collect()), key=str)


@pytest.fixture()
def small_runs(monkeypatch):
    for name, value in {"PORTION": (2_000, 7), "FAN_IN": 3, "RUN_BLOCK": 16, "PORTIONS_A_SALT": 2, "CACHE_WORDS": 200}.items():
        monkeypatch.setattr(alignment, name, value)


def test_same_as_all_pairs(make_docs, prose, small_runs):
    rng = random.Random(4)
    rows = [(n, text) for n, text in enumerate(AWKWARD)]
    rows += [(100 + n, prose(n, rng.randint(1, 60)) + rng.choice([".", "", "\n", " ", " — x"])) for n in range(80)]
    rows += [(None, "a b c"), (None, "a b c"), (7, "a b c"), (999, "long text " * 30_000)]
    alphabet = "ab é.\n\t'’ 1漢▁  \x85-"
    rows += [(300 + n, "".join(rng.choices(alphabet, k=rng.randint(1, 30)))) for n in range(150)]
    got, want = found(make_docs, rows), sorted(expected(rows), key=str)
    assert got == want


def test_no_rows(make_docs):
    assert found(make_docs, []) == []
    assert found(make_docs, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_merge_counts_every_pair():
    rng = random.Random(6)
    plain, runs = Counter(), []
    for _ in range(9):
        own = Counter({rng.randrange(500): rng.randint(1, 1 << 40) for _ in range(rng.randint(1, 200))})
        plain.update(own)
        pairs, counts = (np.array(side) for side in zip(*sorted(own.items())))
        runs.append(Run([pack(steps(pairs[at : at + 16]), counts[at : at + 16]) for at in range(0, len(pairs), 16)]))
    pairs, counts = (np.concatenate(side).tolist() for side in zip(*merge(runs)))
    assert list(zip(pairs, counts)) == sorted(plain.items())


def test_arrays_survive_packing():
    arrays = [np.array([], dtype=np.int64), np.array([0, 255]), np.array([256]), np.array([1 << 40, 3])]
    assert [a.tolist() for a in unpack(pack(*arrays))] == [a.tolist() for a in arrays]
