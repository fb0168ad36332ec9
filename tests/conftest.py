import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pitchframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_matches(spark):
    """Matches from (seq, day, time, home, away, home goals, away goals) and optional statistics."""
    stats = ["HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR"]
    schema = (
        "div_name string, season string, match_seq long, Date string, Time string, HomeTeam string,"
        " AwayTeam string, FTHG int, FTAG int, " + ", ".join(f"`{s}` int" for s in stats)
    )

    def make(rows, season="21-22", div="L", **given):
        filled = [(div, season, *r, *[given.get(s, {}).get(r[0], 1) for s in stats]) for r in rows]
        return (
            spark.createDataFrame(filled, schema)
            .selectExpr(
                "* except (Date)",
                "to_date(Date) as Date",
                "case when FTHG > FTAG then 'H' when FTHG < FTAG then 'A' when FTHG = FTAG then 'D' end as FTR",
                "0 as HTHG",
                "0 as HTAG",
                "'D' as HTR",
            )
        )

    return make
