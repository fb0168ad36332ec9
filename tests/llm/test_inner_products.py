"""Top inner products against all pairs."""

import math
import random

import pytest

from pitchframe.llm import inner_products
from pitchframe.llm.inner_products import top_inner_products


def brute(rows, every, k, scale):
    usable = []
    for no, (vec_id, vector) in enumerate(rows):
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((no, vec_id, [math.floor(scale * x) for x in vector]))
    for no, query_id, q in usable:
        if query_id is None or query_id % every:
            continue
        scores = []
        for other, vec_id, c in usable:
            if other != no:
                score = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c))))
                scores.append((-score, vec_id is None, vec_id or 0, vec_id))
        for rank, (score, _, _, vec_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            yield query_id, rank, vec_id, -score


def found(spark, rows, every=5, k=4, scale=16.0, parts=3):
    schema = "vec_id long, embedding array<double>, vector string, place int"
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], schema).repartition(parts)
    got = top_inner_products(frame, every, k, scale).select("query_id", "rank", "vec_id", "score")
    return sorted(map(tuple, got.collect()), key=str)


def expected(rows, every=5, k=4, scale=16.0):
    return sorted(brute(rows, every, k, scale), key=str)


@pytest.fixture()
def small_blocks(monkeypatch):
    for name, value in {"BLOCK": 8, "SLICE": (16, 32), "GROUP": 6, "CHUNK": 4, "FIRST": 2, "PAIRS": 16}.items():
        monkeypatch.setattr(inner_products, name, value)


def test_same_as_all_pairs(spark, small_blocks):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + i % 7) for _ in range(12)]) for i in range(300)]
    assert found(spark, rows) == expected(rows)


def test_one_direction_dominates(spark, small_blocks):
    rng = random.Random(2)
    rows = [(i, [100 * rng.random() ** 3, *[rng.gauss(0, 0.5) for _ in range(7)]]) for i in range(200)]
    assert found(spark, rows, every=7, k=3) == expected(rows, every=7, k=3)


def test_copies_ties_and_awkward_rows(spark, small_blocks):
    rng = random.Random(3)
    common = [1.0, -2.0, 0.5]
    rows = [(i, common) for i in range(0, 120)]
    rows += [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(120, 200)]
    rows += [(None, common), (None, [3.0, 0.0, 0.0]), (200, None), (205, [1.0, None, 1.0]), (210, [1.0, math.nan, 0.0])]
    rows += [(215, [math.inf, 0.0, 0.0]), (220, []), (225, [0.0, 0.0]), (230, [0.0, 0.0, 0.0]), (235, [1.0, 2.0, 3.0, 4.0, 5.0])]
    rows += [(5, common), (5, common), (10, [2.0, 2.0, 2.0]), (10, [2.0, 2.0, 2.0])]
    # A row of a repeated id and vector leaves one of them out, whichever it is.
    assert found(spark, rows, k=6) == expected(rows, k=6)


def test_huge_components(spark):
    rows = [(0, [1e12, 1.0]), (5, [3e11, -1e12]), (6, [1e30, 1.0]), (7, [-1e30, 5.0]), (8, [2.0, 3.0]), (10, [-1e-30, 0.0])]
    assert found(spark, rows, scale=1024.0) == expected(rows, scale=1024.0)


def test_few_or_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0])]) == []
    assert found(spark, [(0, [1.0, 2.0]), (3, [1.0, 1.0])]) == expected([(0, [1.0, 2.0]), (3, [1.0, 1.0])])
    assert found(spark, [(1, [1.0, 2.0]), (3, [1.0, 1.0])]) == []
    assert found(spark, [(0, None), (5, [None])]) == []
