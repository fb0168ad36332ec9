"""Doubles of registered queries: six digits, whichever way they are rounded."""

import math
import random

from pyspark.sql import functions as F

import registry


def test_short_numbers_are_rounded_like_all_others(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 0.1, -2.5, 1 / 3, -1 / 3, 1 / 128, -1 / 128, 0.0015625, 0.1234565, 1e-7, 5e-7, 1e9 + 0.1, 1e15 + 0.3]
    values += [1e300, -1e300, math.inf, -math.inf, math.nan, None]
    values += [rng.randint(-500, 500) / rng.randint(1, 64) for _ in range(3_000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 16) for _ in range(3_000)]
    values += [round(rng.uniform(-1e10, 1e10), rng.randint(0, 8)) for _ in range(3_000)]
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, x double")
    both = registry.portable(frame.withColumn("plain", F.round("x", 6).cast("string"))).withColumn("x", F.col("x").cast("string"))
    other = both.withColumn("plain", (F.col("plain").cast("double") + F.lit(0.0)).cast("string"))
    assert other.where("not (x <=> plain)").collect() == []
