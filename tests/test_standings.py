import random
from datetime import date, timedelta

import pytest

from pitchframe.columns import LEAGUE
from pitchframe.operators import ordering, standings
from pitchframe.operators.ordering import number_matches
from pitchframe.operators.standings import add_table_positions


def league(seed, matches, teams, days):
    rng = random.Random(seed)
    names = [f"t{i:02d}" for i in range(teams)]
    rows = []
    for seq in rng.sample(range(matches * 7), matches):
        home, away = rng.sample(names, 2)
        day = date(2021, 8, 1) + timedelta(days=rng.randrange(days))
        time = rng.choice(["12:30", "15:00", "20:00", None])
        rows.append((seq, str(day), time, home, away, rng.randrange(4), rng.randrange(3)))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[2] or "~", r[0]))


def played_out(rows, min_played=3, default=10):
    """Positions by booking one match after another."""
    record = {team: [0, 0, 0, 0] for r in rows for team in r[3:5]}
    found = {}
    for seq, _, _, home, away, hg, ag in in_order(rows):
        ranking = sorted(record, key=lambda t: (*[-x for x in record[t][:3]], t))
        found[seq] = tuple(
            default if record[t][3] < min_played else ranking.index(t) + 1 for t in (home, away)
        )
        for team, own, other in ((home, hg, ag), (away, ag, hg)):
            points = 3 if own > other else 1 if own == other else 0
            record[team] = [a + b for a, b in zip(record[team], (points, own - other, own, 1))]
    return found


def positions(df):
    return {r["match_seq"]: (r["HomeTablePos"], r["AwayTablePos"]) for r in df.collect()}


@pytest.mark.parametrize("chunk,tile", [(1 << 14, 1 << 20), (7, 1 << 20), (50, 40)])
def test_equals_one_match_after_another(make_matches, monkeypatch, chunk, tile):
    monkeypatch.setattr(standings, "TILE", tile)
    small, large = league(1, 60, 6, 40), league(2, 300, 18, 60)
    both = make_matches(small, season="21-22").unionByName(make_matches(large, season="22-23"))
    got = add_table_positions(both, chunk=chunk)
    assert positions(got.where("season = '21-22'")) == played_out(small)
    assert positions(got.where("season = '22-23'")) == played_out(large)


def test_one_kick_off_with_most_matches_is_cut_into_cells(make_matches, monkeypatch):
    monkeypatch.setattr(ordering, "CELL_BITS", 2)
    rows = [r if i % 3 else (r[0], "2021-09-01", "15:00", *r[3:]) for i, r in enumerate(league(3, 120, 5, 30))]
    got = number_matches(make_matches(rows), LEAGUE)
    numbers = {r["match_seq"]: (r["match_no"], r["league_matches"]) for r in got.collect()}
    assert numbers == {r[0]: (i, 120) for i, r in enumerate(in_order(rows))}
    assert positions(add_table_positions(make_matches(rows), chunk=11)) == played_out(rows)


def test_idle_teams_and_level_teams(make_matches):
    # Three draws each among B, A and C: level on everything, so by name.
    pairs = [("B", "A"), ("A", "C"), ("C", "B")] * 2
    rows = [(i, f"2021-08-{i + 1:02d}", "15:00", h, a, 1, 1) for i, (h, a) in enumerate(pairs)]
    rows += [(6, "2021-08-20", "15:00", "A", "B", 0, 0), (7, "2021-08-21", "15:00", "C", "Z", 0, 0)]
    for chunk in (2, 100):
        got = positions(add_table_positions(make_matches(rows), chunk=chunk))
        assert got == played_out(rows)
        assert got[6] == (1, 2)
        assert got[7] == (3, 10)


def test_rule_is_adjustable_and_difference_is_away_less_home(make_matches):
    rows = league(4, 80, 4, 50)
    got = add_table_positions(make_matches(rows), min_played=0, default_position=99)
    assert positions(got) == played_out(rows, 0, 99)
    assert got.where("TablePosDiff != AwayTablePos - HomeTablePos").count() == 0


def test_missing_score_counts_as_a_goalless_draw(make_matches):
    rows = league(5, 40, 4, 30)
    rows[3] = (*rows[3][:5], None, None)
    assert positions(add_table_positions(make_matches(rows))) == played_out(
        [(*r[:5], r[5] or 0, r[6] or 0) for r in rows]
    )
