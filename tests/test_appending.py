"""Match days added one after another give the rows of a run over all."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pitchframe.operators import rolling, standings
from pitchframe.plans.appending import append_matches
from pitchframe.plans.dataset import match_dataset
from pitchframe.sources.versions import current_version
from test_standings import league


@pytest.fixture(scope="module")
def season(make_matches):
    """Two leagues whose teams all play in the first days."""
    both = []
    for seed, div in ((31, "L"), (32, "M")):
        teams = 6
        names = [f"t{i:02d}" for i in range(teams)]
        first = [(90_000 + i, "2021-07-01", "12:00", names[i], names[-1 - i], i % 3, 1) for i in range(teams // 2)]
        both.append(make_matches([*first, *league(seed, 120, teams, 60)], div=div))
    return both[0].unionByName(both[1])


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(sorted(frame.columns)).collect()), key=str)


@pytest.mark.parametrize("small", [False, True], ids=["whole", "small blocks"])
def test_same_as_one_run(spark, season, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(standings, "CHUNK", 7)
        monkeypatch.setattr(rolling, "BLOCK", 11)
    path, day = str(tmp_path / "state"), date(2021, 8, 1)
    cuts = [day + timedelta(days=n) for n in (10, 25, 26)]
    parts = [season.where(F.col("Date") < F.lit(cuts[0]))]
    parts += [season.where((F.col("Date") >= F.lit(a)) & (F.col("Date") < F.lit(b))) for a, b in zip(cuts, cuts[1:])]
    # One league has no match in the last part but one.
    parts[2] = parts[2].where("div_name = 'L'")
    rest = season.where((F.col("Date") >= F.lit(cuts[2])) | ((F.col("Date") >= F.lit(cuts[1])) & (F.col("div_name") == "M")))
    found = [append_matches(spark, path, part) for part in [*parts, rest]]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    assert current_version(spark, path) == 4
    assert rows_of(whole) == rows_of(match_dataset(season))


def test_what_does_not_follow_is_refused(spark, season, tmp_path):
    path = str(tmp_path / "state")
    early, late = season.where("Date < '2021-09-01'"), season.where("Date >= '2021-09-01'")
    append_matches(spark, path, early)
    with pytest.raises(ValueError, match="not later"):
        append_matches(spark, path, early.limit(1))
    with pytest.raises(ValueError, match="not in their tables"):
        append_matches(spark, path, late.withColumn("HomeTeam", F.lit("stranger")))
    assert current_version(spark, path) == 1
    assert append_matches(spark, path, late).count() == late.count()
