"""Rows of the dataset by matches: the same means as by team rows, with less dealt again."""

import re

import pytest
from pyspark.sql import functions as F

import registry
from pitchframe.columns import LEAGUE
from pitchframe.operators.match_rows import to_match_rows
from pitchframe.operators.rolling import add_rolling_features, last_rows
from pitchframe.operators.standings import add_table_positions
from pitchframe.operators.team_rows import to_team_rows
from pitchframe.plans.dataset import exploratory_dataset, match_dataset
from test_standings import league


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def matches(make_matches):
    """Two leagues; in one, a team has most matches and is rarely away."""
    often = [
        (r[0], *r[1:3], "t00", r[4] if r[4] != "t00" else "t01", *r[5:]) if i % 3 and i % 29 else r
        for i, r in enumerate(league(6, 260, 9, 80))
    ]
    shots = {"HS": {r[0]: None if i % 5 == 0 else i % 7 for i, r in enumerate(often)}}
    return make_matches(often, **shots).unionByName(make_matches(league(7, 60, 5, 40), div="M"))


@pytest.mark.parametrize("chunk,batch", [(1, 10_000), (13, 10_000), (1 << 14, 3), (7, 2)])
def test_dataset_by_matches_is_that_of_team_rows(spark, matches, chunk, batch):
    expected = to_match_rows(add_rolling_features(to_team_rows(add_table_positions(matches))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = match_dataset(matches, chunk=chunk)
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.columns == expected.columns and got.dtypes == expected.dtypes
    assert sorted(rows, key=str) == sorted(expected.collect(), key=str)


def test_finished_means_are_not_shuffled(matches):
    """what comes out of the rolling step is neither dealt nor grouped again."""
    for frame in (match_dataset(matches), exploratory_dataset(matches)):
        above = plan_of(frame).split("MapInArrow")[0]
        assert not [step for step in ("Repartition", "Aggregate", "Join", "Sort") if step in above]


def test_feature_pairs_work_out_two_measures_only(matches):
    """F16: four means, of which two are asked for, where 136 were worked out before."""
    pairs = registry.feature_pairs(matches)
    means = {w for w in plan_of(pairs).replace("#", " ").replace(",", " ").split() if "_Rolling" in w}
    assert len({m.lstrip("[") for m in means}) <= 4
    columns = ["Home_TablePosDiff_Rolling5", "Home_Corners_Rolling5"]
    assert sorted(pairs.collect(), key=str) == sorted(match_dataset(matches).select(columns).collect(), key=str)


def test_only_last_rows_of_chunks_are_sorted_for_later_blocks(matches):
    """of a league above a block all rows were sorted before."""
    rows = to_team_rows(add_table_positions(matches, chunk=20, later=True)).withColumn("_block", F.expr("match_no div 40"))
    few = last_rows(rows, 2, 40)
    assert re.search(r"later#\d+ < 2", plan_of(few))
    columns = [*LEAGUE, "match_seq", "Team", "Venue", "_block"]
    every = last_rows(rows.drop("later"), 2, 40)
    assert sorted(few.select(columns).collect()) == sorted(every.select(columns).collect()) != []
    whole = add_rolling_features(rows.drop("_block", "later"), ["Points"])
    cut = add_rolling_features(rows.drop("_block"), ["Points"], block=40)
    assert whole.exceptAll(cut.select(whole.columns)).count() == 0


@pytest.mark.parametrize("name", ["dataset_by_kick_off", "rolling_all_10"])
def test_positions_are_worked_out_once(spark, matches, tmp_path, name):
    """the positions are settled, and not worked out for every place that reads them."""
    path = str(tmp_path / "matches")
    matches.write.parquet(path)
    kept = registry.derived_matches
    try:
        registry.derived_matches = lambda spark, sf_dir: spark.read.parquet(sf_dir)
        assert path not in str(registry.PLAIN[name](spark, path).inputFiles())
    finally:
        registry.derived_matches = kept


def test_columns_of_any_type_pass_the_replay(matches):
    more = matches.selectExpr("*", "cast(match_seq as decimal(12, 2)) as d", "array(Time) as a", "timestamp(Date) as t")
    placed = add_table_positions(more)
    assert placed.columns == [*more.columns, "match_no", "league_matches", "HomeTablePos", "AwayTablePos", "TablePosDiff"]
    assert placed.select(more.columns).exceptAll(more).count() == 0 == more.exceptAll(placed.select(more.columns)).count()
