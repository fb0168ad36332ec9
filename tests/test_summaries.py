import pytest

from pitchframe.plans import summaries as S

A_B = [(1, "2021-08-01", "15:00", "X", "Y", 0, 3), (2, "2021-08-02", "15:00", "X", "Y", 0, 0)]


def test_histogram_is_dense(make_matches):
    got = [tuple(r) for r in S.goal_histogram(make_matches(A_B)).collect()]
    assert got == [(0, 2, 1), (1, 0, 0), (2, 0, 0), (3, 0, 1)]


def test_points_gap_fills_absent_sides_with_zero(make_matches):
    got = [tuple(r) for r in S.points_gap(make_matches(A_B)).collect()]
    assert got == [("Y", 0, 4, 4), ("X", 1, 0, 1)]


def test_ppg_difference_keeps_absent_away_side_missing(make_matches):
    got = S.home_away_ppg(make_matches(A_B)).collect()
    assert [r["Team"] for r in got] == ["X"]
    assert (got[0]["HomePPG"], got[0]["AwayPPG"], got[0]["HomeAwayDifference"]) == (0.5, None, None)


def test_shares_and_ranking(make_matches):
    rows = [*A_B, (3, "2021-08-03", "15:00", "Y", "X", None, None)]
    shares = {r["FTR"]: r["share"] for r in S.outcome_shares(make_matches(rows)).collect()}
    assert shares == {"A": 0.5, "D": 0.5}
    ranking = [tuple(r) for r in S.ppg_ranking(make_matches(rows)).collect()]
    assert ranking == [("Y", 4, 2, pytest.approx(2.0)), ("X", 1, 2, pytest.approx(0.5))]
