"""Summary queries over match rows.

Each reads its input once, combines on the map side and sorts only the small result.
``by`` adds grouping columns such as the league and season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.functions.scoring import per_game, side_points


def team_points(matches: DataFrame, by: list[str] = []) -> DataFrame:
    """(team, venue, points): one row per team and match."""

    def side(team: str, venue: str) -> Column:
        return F.struct(
            F.col(team).alias("Team"),
            F.lit(venue).alias("Venue"),
            side_points(F.col("FTR"), venue).alias("Points"),
        )

    return matches.select(*by, F.inline(F.array(side("HomeTeam", "H"), side("AwayTeam", "A"))))


def goal_histogram(matches: DataFrame) -> DataFrame:
    """Matches per number of goals, home and away, for every number up to the highest."""
    counts = (
        matches.select(
            F.inline(
                F.array(
                    F.struct(F.col("FTHG").alias("goals"), F.lit(1).alias("home"), F.lit(0).alias("away")),
                    F.struct(F.col("FTAG").alias("goals"), F.lit(0).alias("home"), F.lit(1).alias("away")),
                )
            )
        )
        .where(F.col("goals").isNotNull())
        .groupBy("goals")
        .agg(F.sum("home").alias("home_matches"), F.sum("away").alias("away_matches"))
    )
    # One row per number of goals by now.
    highest = counts.agg(F.max("goals").alias("highest"))
    every = highest.where("highest is not null").select(
        F.explode(F.sequence(F.lit(0), F.col("highest").cast("int"))).alias("goals")
    )
    return every.join(counts, "goals", "left").fillna(0, ["home_matches", "away_matches"]).orderBy("goals")


def points_gap(matches: DataFrame, by: list[str] = []) -> DataFrame:
    """Home and away points per team and how far apart they are, widest gap first."""
    points, at_home = F.col("Points"), F.col("Venue") == "H"
    return (
        team_points(matches, by)
        .groupBy(*by, "Team")
        .agg(
            F.coalesce(F.sum(F.when(at_home, points)), F.lit(0)).alias("Home"),
            F.coalesce(F.sum(F.when(~at_home, points)), F.lit(0)).alias("Away"),
        )
        .withColumn("Difference", F.abs(F.col("Home") - F.col("Away")))
        .orderBy(*by, F.desc("Difference"), "Team")
    )


def home_away_ppg(matches: DataFrame) -> DataFrame:
    """Points per home game less points per away game, for teams with a home game."""
    at_home = F.col("Venue") == "H"
    games = F.count(F.when(at_home, 1))
    away_games = F.count(F.when(~at_home, 1))

    def total(here: Column, games: Column) -> Column:
        return F.when(games > 0, F.coalesce(F.sum(F.when(here, F.col("Points"))), F.lit(0)))

    return (
        team_points(matches)
        .groupBy("Team")
        .agg(
            total(at_home, games).alias("HomePoints"),
            games.alias("HomeGames"),
            total(~at_home, away_games).alias("AwayPoints"),
            F.when(away_games > 0, away_games).alias("AwayGames"),
        )
        .where(F.col("HomeGames") > 0)
        .withColumn("HomePPG", per_game(F.col("HomePoints"), F.col("HomeGames")))
        .withColumn("AwayPPG", per_game(F.col("AwayPoints"), F.col("AwayGames")))
        .withColumn("HomeAwayDifference", F.col("HomePPG") - F.col("AwayPPG"))
        .orderBy(F.desc_nulls_last("HomeAwayDifference"), "Team")
    )


def outcome_shares(matches: DataFrame) -> DataFrame:
    """Matches per full-time result and their share, most frequent first."""
    counts = matches.where(F.col("FTR").isNotNull()).groupBy("FTR").agg(F.count("*").alias("matches"))
    # One row per result by now.
    total = F.sum("matches").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("matches") / total).orderBy(F.desc("matches"), "FTR")


def ppg_ranking(matches: DataFrame) -> DataFrame:
    """Points per game of each team over all its matches, best first."""
    return (
        team_points(matches)
        .groupBy("Team")
        .agg(F.coalesce(F.sum("Points"), F.lit(0)).alias("TotalPoints"), F.count("Points").alias("Games"))
        .withColumn("PPG", per_game(F.col("TotalPoints"), F.col("Games")))
        .orderBy(F.desc_nulls_last("PPG"), "Team")
    )


def feature_pairs(
    dataset: DataFrame, x: str = "Home_TablePosDiff_Rolling5", y: str = "Home_Corners_Rolling5"
) -> DataFrame:
    """Two feature columns side by side, for a scatter plot."""
    return dataset.select(x, y)
