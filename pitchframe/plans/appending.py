"""The feature dataset for match days that are added one after another.

What later matches need of earlier ones is little: every team's totals, its last rows at home
and away, and where its league stands.  That state is kept as a versioned table; new matches
are replayed from it alone, and give the rows that a run over all matches would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.columns import LEAGUE, WINDOWS
from pitchframe.operators.match_rows import to_match_rows
from pitchframe.operators.ordering import clock_key, day_key
from pitchframe.operators.rolling import add_rolling_features
from pitchframe.operators.standings import TOTALS, add_table_positions, booked_totals
from pitchframe.operators.team_rows import to_team_rows
from pitchframe.session import settle
from pitchframe.sources.versions import current_version, read_version, write_version

REACH = max(WINDOWS)  # rows of a team and venue that later means look back on
LAST = "struct<day:date,clock:string,match_seq:bigint>"


def _order() -> F.Column:
    return F.struct(day_key().alias("day"), clock_key().alias("clock"), F.col("match_seq").cast("long").alias("match_seq"))


def _checked(new: DataFrame, leagues: DataFrame, totals: DataFrame) -> None:
    """New matches must follow the stored ones, with the teams that these ranked."""
    firsts = new.groupBy(*LEAGUE).agg(F.min(_order()).alias("first"))
    late = firsts.join(leagues, LEAGUE).where(F.col("first") <= F.col("last")).limit(3).collect()
    if late:
        raise ValueError(f"matches are not later than those stored: {[(r['div_name'], r['season']) for r in late]}")
    teams = new.select(*LEAGUE, F.explode(F.array("HomeTeam", "AwayTeam")).alias("team")).distinct()
    known = teams.join(leagues.select(*LEAGUE), LEAGUE, "left_semi")
    strangers = known.join(totals.select(*LEAGUE, "team"), [*LEAGUE, "team"], "left_anti").limit(3).collect()
    if strangers:
        names = [r["team"] for r in strangers]
        raise ValueError(f"{names} were not in their tables so far; run these league seasons anew")


def append_matches(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The dataset rows of ``new`` matches; the state at ``path`` moves on by them.

    The first call begins the state.  Later matches of a league season must come after all
    stored ones and bring no new team, since positions count every team of the season, played
    or not; otherwise the call fails and the state stays.
    """
    # Read for the checks, the replay and the state.
    new = settle(new, None)
    begun = current_version(spark, path) is not None
    earlier = leagues = recent = None
    if begun:
        state = read_version(spark, path)
        earlier = state.where("kind = 'total'").select(*LEAGUE, "team", *TOTALS)
        leagues = state.where("kind = 'league'").select(*LEAGUE, "matches", "last")
        recent = state.where("kind = 'row'").select(*LEAGUE, "row.*")
        _checked(new, leagues, earlier)
    placed = add_table_positions(new, settled=True, earlier=earlier)
    if begun:
        behind = F.coalesce("matches", F.lit(0))
        placed = placed.join(leagues.drop("last"), LEAGUE, "left")
        placed = placed.withColumns({"match_no": F.col("match_no") + behind, "league_matches": F.col("league_matches") + behind})
        placed = placed.drop("matches")
    rows = settle(to_team_rows(placed), None).withColumn("_new", F.lit(True))
    if begun:
        sizes = rows.groupBy(*LEAGUE).agg(F.max("league_matches").alias("league_matches"))
        history = recent.drop("league_matches").join(sizes, LEAGUE).withColumn("_new", F.lit(False))
        rows = rows.unionByName(history.select(*rows.columns))
    formed = add_rolling_features(rows)
    dataset = settle(to_match_rows(formed.where("_new").drop("_new")), None)
    _write_state(path, new, rows, earlier, leagues, recent)
    return dataset


def _write_state(path: str, new: DataFrame, rows: DataFrame, earlier, leagues, recent) -> None:
    totals = booked_totals(new.withColumns({g: F.coalesce(F.col(g).cast("long"), F.lit(0)) for g in ("FTHG", "FTAG")}), [])
    ends = new.groupBy(*LEAGUE).agg(F.count("*").alias("matches"), F.max(_order()).cast(LAST).alias("last"))
    if earlier is not None:
        totals, ends = totals.unionByName(earlier), ends.unionByName(leagues)
    totals = totals.groupBy(*LEAGUE, "team").agg(*[F.sum(t).alias(t) for t in TOTALS])
    ends = ends.groupBy(*LEAGUE).agg(F.sum("matches").alias("matches"), F.max("last").alias("last"))
    newest = Window.partitionBy(*LEAGUE, "Team", "Venue").orderBy(F.desc("match_no"))
    # Leagues without new matches keep their rows as they are.
    idle = None if recent is None else recent.join(rows.select(*LEAGUE).distinct(), LEAGUE, "left_anti")
    kept = rows.drop("_new").withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= REACH).drop("_age")
    kept = kept if idle is None else kept.unionByName(idle.select(*kept.columns))
    packed = kept.select(*LEAGUE, F.struct(*[c for c in kept.columns if c not in LEAGUE]).alias("row"))
    parts = [totals.withColumn("kind", F.lit("total")), ends.withColumn("kind", F.lit("league")), packed.withColumn("kind", F.lit("row"))]
    state = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    write_version(state, path, ["kind"])
