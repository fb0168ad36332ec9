import hashlib
import re

from pyspark.sql import functions as F

from pitchframe.llm.exact_dedup import build_directory, exact_dedup


def expected(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    out = []
    for d, t in norm:
        same = [e for e, u in norm if u == t]
        keep = min((e for e in same if e is not None), default=None)
        out.append((d, keep, len(same), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_awkward_rows(make_docs, awkward):
    assert got(exact_dedup(make_docs(awkward))) == expected(awkward)


def test_a_small_capacity_changes_nothing(make_docs, prose):
    rows = [(i, prose(i % 40, 12)) for i in range(300)]
    assert got(exact_dedup(make_docs(rows), capacity=3)) == expected(rows)


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    directory = build_directory(keys, capacity=100)
    loads = keys.join(directory, F.shiftrightunsigned("key", 48).cast("int") == F.col("slot"))
    sizes = [r["count"] for r in loads.groupBy("bucket").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 100
    assert len({r["depth"] for r in directory.select("depth").distinct().collect()}) > 1


def test_empty_table(make_docs):
    assert exact_dedup(make_docs([])).count() == 0
