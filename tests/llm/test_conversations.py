"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pitchframe.llm import conversations
from pitchframe.llm.conversations import AT_END, TAIL, audits, repair_conversations

GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NO_BLACK = re.compile(r"[\x20\x09-\x0D]*\Z")


def damage(rows):
    for conv, turn, role, text in rows:
        blank = [" " if v is None else v for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{blank[0]}:{blank[1]}".encode()) % 20
        role, text = blank[2:]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def best_repair(rows):
    """(cost, audit, repaired) of the least (cost, audit), row by row; ``rows`` are (role, text, fault)."""
    now = {"": (0, "", ())}

    def with_inserts(found):
        for _ in range(2):
            for state, (cost, audit, kept) in list(found.items()):
                for role in ("user", "assistant"):
                    offer(found, GRAMMAR.get((state, role[0])), (cost + 5, audit + "I", (*kept, f"{role}:")))
        return found

    def offer(found, state, value):
        if state is not None and (state not in found or value[:2] < found[state][:2]):
            found[state] = value

    for role, text, fault in rows:
        later = {}
        for state, (cost, audit, kept) in with_inserts(now).items():
            offer(later, state, (cost + 2, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (5 if fault == "truncated" else 0)
            offer(later, GRAMMAR.get((state, role[:1])), (more, audit + "K", (*kept, f"{role}:{text}")))
            for new in ("user", "assistant"):
                offer(later, GRAMMAR.get((state, new[0])), (more + 1, audit + "R", (*kept, f"{new}:{text}")))
        now = later
    return min(v for state, v in with_inserts(now).items() if state in ("", "a"))


def expected(rows):
    by_conv = defaultdict(list)
    for row in damage(rows):
        by_conv[row[0]].append(row[1:])
    for conv in {r[0] for r in rows}:
        def key(r):
            return (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())

        found = sorted(by_conv[conv], key=key)
        seen, marked = set(), []
        for _, role, text in found:
            black = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not black else "duplicate" if (role, text) in seen else "" if black[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in found if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        cost, audit, kept = best_repair(marked)
        yield (
            conv,
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[sum(f == kind for _, _, f in marked) for kind in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, code string, place int")
    return [tuple(r) for r in repair_conversations(frame.repartition(parts)).select(*NAMES).collect()]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t", "a. b", "é?", "end. \n", "Yes."]
    made = []
    for conv in [None, *range(400)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            made.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice([*texts, None])))
    return made + made[50:60]


def test_same_as_search(spark, rows):
    assert ordered(repaired(spark, rows)) == ordered(expected(rows))


def test_blocks_change_nothing(spark, rows, monkeypatch):
    long = [(7_000, t, ["user", "assistant", "user", "system"][t * t % 4], f"{t % 50}{'.' if t % 3 else ''}") for t in range(700)]
    monkeypatch.setattr(conversations, "BLOCK_BITS", 2)
    monkeypatch.setattr(conversations, "PORTION", 64)
    assert ordered(repaired(spark, [*rows, *long], 5)) == ordered(expected([*rows, *long]))


def test_equal_rows_and_long_texts(spark):
    same = [(1, None, "user", "again.")] * 300 + [(2, 5, "assistant", "w " * 300_000 + "!")] * 2 + [(3, None, None, None)]
    assert ordered(repaired(spark, same)) == ordered(expected(same))


def test_conversation_that_is_dropped_whole(spark):
    gone = next(t for t in range(10_000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = repaired(spark, [(5, gone, "user", "Hello.")])
    assert row == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_rows(spark):
    assert repaired(spark, []) == []


def test_least_audit_of_level_costs():
    rng = random.Random(5)
    sequences = [[rng.randrange(12) for _ in range(rng.randint(1, 40))] for _ in range(300)]
    kinds = [(role, fault) for role in ("system", "user", "assistant", "tool") for fault in ("", "blank", "truncated")]
    lengths = np.array([len(s) for s in sequences])
    found = audits(np.array([c for s in sequences for c in s]), lengths, np.tile(AT_END, (len(sequences), 1)))
    for sequence, (left, by_entry) in zip(sequences, found):
        plain = best_repair([(kinds[c][0], str(i), kinds[c][1]) for i, c in enumerate(sequence)])
        assert by_entry[0] + TAIL[left[0]] == plain[1]
