import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchframe.columns import FORM_MEASURES, OUTCOME_MEASURES
from pitchframe.operators import standings
from pitchframe.operators.match_rows import complete_rows, to_match_rows
from pitchframe.operators.rolling import add_rolling_features, rolling_means, with_form_measures
from pitchframe.operators.standings import add_table_positions
from pitchframe.operators.team_rows import to_team_rows
from pitchframe.plans.dataset import exploratory_dataset, match_dataset
from test_standings import league


def test_team_rows_need_positions(make_matches):
    with pytest.raises(ValueError, match="TablePosDiff"):
        to_team_rows(make_matches(league(1, 5, 3, 5)))


def test_team_rows_mirror_each_other(make_matches):
    one = make_matches([(1, "2021-08-01", "15:00", "A", "B", 2, 0)], HF={1: 10}, AF={1: 14}, HS={1: 9})
    placed = one.selectExpr("*", "4 HomeTablePos", "9 AwayTablePos", "5 TablePosDiff")
    rows = {r["Venue"]: r for r in to_team_rows(placed, with_positions=True).collect()}
    home, away = rows["H"], rows["A"]
    assert (home["Team"], home["Opponent"], home["Result"], home["Points"]) == ("A", "B", "W", 3)
    assert (away["Team"], away["Opponent"], away["Result"], away["Points"]) == ("B", "A", "L", 0)
    assert (home["TablePosDiff"], away["TablePosDiff"]) == (5, -5)
    assert (home["FoulDifference"], away["FoulDifference"]) == (4, -4)
    assert (home["TeamTablePos"], away["TeamTablePos"], away["OpponentTablePos"]) == (4, 9, 4)
    assert (home["Shots"], away["ShotsAgainst"], home["GoalDifference"]) == (9, 9, 2)


def test_shot_accuracy_and_unknown_result(spark):
    rows = spark.createDataFrame(
        [(3, 6, "W"), (0, 0, "D"), (None, None, "?")], "ShotsOnTarget int, Shots int, Result string"
    )
    got = [(r["ShotAccuracy"], r["Win"]) for r in with_form_measures(rows).collect()]
    assert got == [(0.5, 1.0), (0.0, 0.5), (None, None)]


def team_history(spark, values, **more):
    rows = [("L", "s", i, i, len(values), more.get("team", "A"), "H", v) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows,
        "div_name string, season string, match_seq long, match_no long, league_matches long,"
        " Team string, Venue string, x double",
    )


@pytest.mark.parametrize("block", [1, 2, 100])
def test_lagged_mean_skips_missing_values(spark, block):
    rows = team_history(spark, [1.0, None, 5.0, 7.0])
    got = rolling_means(rows, ["x"], [5], [""], block).orderBy("match_no").collect()
    assert [r["x_Rolling5"] for r in got] == [None, 1.0, 1.0, 3.0]


@pytest.mark.parametrize("block", [1, 13, 64])
def test_blocks_change_nothing(make_matches, block):
    """A team with most matches, rarely away, in a league cut into blocks."""
    rows = [
        (r[0], *r[1:3], "t00", r[4] if r[4] != "t00" else "t01", *r[5:]) if i % 3 and i % 29 else r
        for i, r in enumerate(league(6, 260, 9, 80))
    ]
    team_rows = to_team_rows(add_table_positions(make_matches(rows)))
    whole = add_rolling_features(team_rows)
    cut = add_rolling_features(team_rows, block=block)
    assert len(whole.columns) == len(team_rows.columns) + 70
    assert cut.count() == whole.count() == 520
    assert whole.exceptAll(cut.select(whole.columns)).count() == 0


def test_form_without_league_numbers(make_matches):
    team_rows = to_team_rows(add_table_positions(make_matches(league(7, 50, 5, 30))))
    keys = ["match_seq", "Team"]
    expected = add_rolling_features(team_rows, ["Points"]).drop("match_no", "league_matches")
    got = add_rolling_features(team_rows.drop("match_no", "league_matches"), ["Points"])
    assert expected.orderBy(*keys).collect() == got.select(expected.columns).orderBy(*keys).collect()


def test_dataset_knows_nothing_of_its_own_match_or_later(make_matches):
    rows = league(8, 70, 6, 60)
    cut = sorted(r[1] for r in rows)[40]
    changed = [(*r[:5], 9, 0) if r[1] >= cut else r for r in rows]
    features = [f"{s}_{m}" for s in ("Home", "Away") for m in ("TablePosDiff", "GoalsFor_Rolling5_all")]
    before, after = (
        match_dataset(make_matches(r)).where(F.col("Date") < cut).select("match_seq", *features).orderBy("match_seq").collect()
        for r in (rows, changed)
    )
    assert before == after


def test_dataset_shape_and_sides(make_matches):
    matches = make_matches(league(9, 60, 4, 60))
    wide = match_dataset(matches)
    assert len(wide.columns) == 3 + 145
    assert wide.count() == 60
    placed = add_table_positions(matches)
    formed = add_rolling_features(to_team_rows(placed))
    away = formed.where("Venue = 'A'").select("match_seq", F.col("Points_Rolling10").alias("expected"))
    joined = wide.join(away, "match_seq").where("not (Away_Points_Rolling10 <=> expected)")
    assert joined.count() == 0
    assert complete_rows(wide).count() == wide.dropna().count() < 60
    measures = [*FORM_MEASURES, *OUTCOME_MEASURES]
    assert all(f"Home_{m}_Rolling{w}{s}" in wide.columns for m in measures for w in (5, 10) for s in ("", "_all"))


def test_sides_found_by_kick_off(make_matches):
    rows = [(i, f"2021-08-{i + 1:02d}", None, *(("A", "B") if i % 2 else ("B", "A")), i % 3, 1) for i in range(20)]
    placed = add_table_positions(make_matches(rows))
    formed = add_rolling_features(to_team_rows(placed))
    plain = to_match_rows(formed, placed).orderBy("match_seq").collect()
    for key in (["Date", "Time"], ["Date"]):
        got = to_match_rows(formed, placed, kick_off_key=key).orderBy("match_seq")
        assert got.collect() == plain


def test_exploratory_dataset_keeps_every_column(make_matches):
    wide = exploratory_dataset(make_matches(league(10, 30, 4, 30)))
    assert {"HS", "Home_Shots", "Away_Opponent", "Home_TeamTablePos", "Away_Fouls_Rolling10_all"} <= set(wide.columns)
    with pytest.raises(ValueError):
        to_match_rows(wide, wide, keep="some")


def test_dataset_reads_its_source_twice_at_most(make_matches, tmp_path, spark):
    """Numbering reads the matches for its counts and for its rows; all else starts from settled steps."""
    path = str(tmp_path / "matches")
    make_matches(league(7, 50, 5, 30)).write.parquet(path)
    seen = []
    inner = standings.number_matches

    def numbered(*given, **named):
        frame = inner(*given, **named)
        seen.append(frame)
        return frame

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(standings, "number_matches", numbered)
        wide = match_dataset(spark.read.parquet(path))
    assert wide.count() == 50
    assert path not in str(wide.inputFiles())
    assert seen[0]._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2 and len(seen) == 1


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_means_are_those_of_windows_and_add_no_frame_twice(spark, make_matches, batch):
    """Groups that go on over batches, two venues, missing values; no window has a frame that slides."""
    rows = make_matches(league(11, 80, 4, 60), HS={n: None if n % 5 == 0 else n % 7 for n in range(90)})
    formed = with_form_measures(to_team_rows(add_table_positions(rows)))
    measures = ["Shots", "ShotAccuracy", "Points"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        means = rolling_means(formed, measures, keep=["match_seq", "Venue"])
        assert "specifiedwindowframe(RowFrame, -5, -1)" not in means._jdf.queryExecution().analyzed().toString()
        got = {(r["match_seq"], r["Venue"]): r for r in means.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = [c for c in means.columns if "Rolling" in c]
    for r in formed.select("match_seq", "Venue", *[windowed(c) for c in names]).collect():
        assert [got[r["match_seq"], r["Venue"]][c] for c in names] == [r[c] for c in names]


def windowed(name):
    measure, window = name.removesuffix("_all").split("_Rolling")
    by = Window.partitionBy("div_name", "season", "Team", *([] if name.endswith("_all") else ["Venue"]))
    return F.avg(measure).over(by.orderBy("match_no").rowsBetween(-int(window), -1)).alias(name)
