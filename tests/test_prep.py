"""Scaling and encoding of all folds, and a preprocessor that is saved and loaded."""

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer

from pitchframe.operators.boosting import SoftmaxBoosting
from pitchframe.operators.prep import MatchPreprocessor, merged_moments, moments_of, walk_forward_one_hot, walk_forward_scaled

SCHEMA = "div_name string, season string, match_seq long, Date date, HomeTeam string, AwayTeam string, x double, y double"


def framed(spark, rows):
    made = [("L", s, n, day, h, a, x, y) for n, (s, day, h, a, x, y) in enumerate(rows)]
    schema = SCHEMA.replace("Date date", "day string")
    return spark.createDataFrame(made, schema).selectExpr("* except (day)", "to_date(day) as Date").repartition(3)


def test_large_means_keep_their_spread(spark):
    """Seven values from 1e9 on in the first season; the second is scaled by them."""
    rows = [("20-21", f"2020-08-0{i + 1}", "A", "B", 1e9 + i, 5.0) for i in range(7)]
    rows += [("21-22", f"2021-08-0{i + 1}", "A", "B", 1e9 + i, 5.0) for i in range(7)]
    got = walk_forward_scaled(framed(spark, rows), ["x", "y"]).orderBy("match_seq").collect()
    assert [r["x"] for r in got] == pytest.approx([(i - 3) / 2 for i in range(7)], abs=1e-9)
    assert [r["y"] for r in got] == [0.0] * 7


def test_moments_of_earlier_seasons(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(5):
        for i in range(40):
            x = None if i % 9 == s else float(rng.normal(10**s, 1))
            rows.append((f"2{s}-2{s + 1}", f"202{s}-09-{i % 28 + 1:02d}", "A", "B", x, float(i)))
    got = walk_forward_scaled(framed(spark, rows), ["x", "y"]).collect()
    assert len(got) == 160 and {r["fold"] for r in got} == {1, 2, 3, 4}
    for r in got:
        earlier = [x for s, _, _, _, x, _ in rows if s < r["season"] and x is not None]
        x = rows[r["match_seq"]][4]
        assert (r["x"] is None) == (x is None)
        if x is not None:
            assert r["x"] == pytest.approx((x - np.mean(earlier)) / np.std(earlier), rel=1e-9, abs=1e-9)


def test_merging_is_adding_up():
    rng = np.random.default_rng(5)
    values = rng.normal(1e6, 1, (300, 4))
    values[rng.random(values.shape) < 0.1] = math.nan
    values[:50, 3] = math.nan
    whole = moments_of(values)
    parts = [moments_of(values[a:b]) for a, b in ((0, 50), (50, 51), (51, 200), (200, 300))]
    found = parts[0]
    for part in parts[1:]:
        found = merged_moments(found, part)
    for a, b in zip(whole, found):
        assert a == pytest.approx(b, rel=1e-9)


def test_codes_of_every_fold(spark):
    rows = [
        ("20-21", "2020-08-01", "C", "A", 1.0, 1.0), ("20-21", "2020-08-02", "B", "C", 1.0, 1.0),
        ("21-22", "2021-08-01", "A", "B", 1.0, 1.0), ("21-22", "2021-08-02", "B", "A", 1.0, 1.0),
        ("22-23", "2022-08-01", "D", "B", 1.0, 1.0), ("22-23", "2022-08-02", "C", "A", 1.0, 1.0), ("22-23", "2022-08-03", None, "A", 1.0, 1.0),
    ]
    got = {(r["fold"], r["match_seq"], r["position"], r["feature"]) for r in walk_forward_one_hot(framed(spark, rows)).collect()}
    # Fold 1 knows home B, C and away A, C; fold 2 home A, B, C and away A, B, C.
    assert got == {
        (1, 3, 0, "cat__HomeTeam_B"), (1, 3, 2, "cat__AwayTeam_A"),
        (2, 4, 4, "cat__AwayTeam_B"), (2, 5, 2, "cat__HomeTeam_C"), (2, 5, 3, "cat__AwayTeam_A"), (2, 6, 3, "cat__AwayTeam_A"),
    }


def test_one_season_has_no_fold(spark):
    rows = [("20-21", "2020-08-01", "C", "A", 1.0, 1.0)]
    assert walk_forward_one_hot(framed(spark, rows)).collect() == []
    assert walk_forward_scaled(framed(spark, rows), ["x"]).collect() == []


LOADED = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.ml import PipelineModel
from pitchframe.session import local_session
spark = local_session(2, 2)
rows = spark.read.parquet(sys.argv[2] + "/rows")
PipelineModel.load(sys.argv[2] + "/model").transform(rows).select("match_seq", "prediction").write.parquet(sys.argv[2] + "/there")
"""


def test_saved_and_loaded_in_another_session(spark, tmp_path):
    rng = np.random.default_rng(9)
    teams = [f"T{i}" for i in range(5)]
    rows = [("20-21", "2020-08-01", *rng.choice(teams, 2).tolist(), *rng.normal(size=2).tolist()) for _ in range(120)]
    frame = framed(spark, rows).selectExpr("*", "case when x > 0.3 then 'H' when y > 0 then 'D' else 'A' end as FTR")
    frame.write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    target = StringIndexer(inputCol="FTR", outputCol="label", stringOrderType="alphabetAsc")
    fitted = Pipeline(stages=[MatchPreprocessor(), target, SoftmaxBoosting(rounds=5, depth=2)]).fit(frame)
    fitted.save(str(tmp_path / "model"))
    here = {tuple(r) for r in fitted.transform(frame).select("match_seq", "prediction").collect()}
    assert len({p for _, p in here}) == 3
    subprocess.run([sys.executable, "-c", LOADED, str(Path(__file__).parent.parent), str(tmp_path)], check=True, timeout=300, capture_output=True)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "there")).collect()} == here
