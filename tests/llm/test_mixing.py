from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitchframe.llm.common import settle
from pitchframe.llm.mixing import mix


def totals(rows):
    by = {}
    for r in rows:
        by.setdefault(r["target"], [0, 0])
        by[r["target"]][0] += r["taken"]
    return by


def test_targets_and_taken_words(make_docs, prose):
    sizes = {"a": 3000, "b": 200, "c": 2000, None: 500}
    rows = [(i, prose(i, 1 + i % 17), None, s) for n, (s, docs) in enumerate(sizes.items()) for i in range(n * 10_000, n * 10_000 + docs // 10)]
    docs = make_docs(rows)
    got = mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    whole = sum(r["size"] for r in got)
    targets = {r["source_size"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * whole)
    assert all(t <= 2 * s for s, t in targets.items())
    for size, target in targets.items():
        taken = sum(r["taken"] for r in got if r["source_size"] == size)
        assert abs(taken - target) <= 9
    again = mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_awkward_rows(make_docs, awkward):
    got = mix(make_docs(awkward)).collect()
    assert len(got) == len(awkward)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert mix(make_docs([])).count() == 0


def test_every_source_needs_a_weight(spark, make_docs):
    docs = make_docs([(1, "a b", None, "s"), (2, "c", None, "t")])
    weights = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    with pytest.raises(Exception, match="needs a weight"):
        mix(docs, weights).collect()


def test_partitions_change_nothing_with_null_and_repeated_ids(make_docs, prose):
    rows = [(None, prose(i, 3 + i % 9), None, "a" if i % 3 else "b") for i in range(300)]
    rows += [(i % 4, prose(1_000 + i, 2 + i % 7), None, "a") for i in range(200)]
    rows += [(None, "the same words", None, "b")] * 150 + [(9, "once more", None, "a")] * 60
    docs = make_docs(rows)

    def taken(parts):
        keys = parts.select("row", "doc_id", "text", "source")
        found = mix(parts, row_no="row").select(F.col("row_no").alias("row"), "copies")
        return Counter(tuple(r)[1:] for r in keys.join(found, "row").collect())

    numbered = settle(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    other = settle(docs.repartition(7).withColumn("row", F.monotonically_increasing_id()), "rows")
    assert taken(numbered) == taken(other)
    # Rows of one id, or of none, are not taken all together.
    assert len({key[-1] for key in taken(numbered) if key[0] == 9}) == 2
