"""Ratings of both sides on the day of the match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_ratings(elo: DataFrame) -> DataFrame:
    """(team, day, elo), one row per team and day; a second rating of a team on one day fails the run.

    It would repeat that team's matches.  See ``repeated_ratings`` for such pairs.
    """
    day = F.to_date("QueryDate")
    counted = elo.groupBy("team", day.alias("day")).agg(F.count("*").alias("n"), F.first("elo").alias("elo"))
    several = F.concat(F.lit("several ratings of "), F.col("team"), F.lit(" on "), F.col("day").cast("string"))
    # In a filter, which no optimisation takes away.
    return counted.where(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(several))).drop("n")


def join_elo(matches: DataFrame, elo: DataFrame) -> DataFrame:
    """Add ``Home_Elo`` and ``Away_Elo`` for the exact day; without a rating they are NULL.

    Ratings from an earlier run are replaced.  Two ratings of a team on one day fail the run.
    Spark broadcasts the ratings when they measure small enough and otherwise shuffles by team
    and day, splitting skewed partitions.
    """
    rated = matches.drop("Home_Elo", "Away_Elo")
    ratings = daily_ratings(elo.where("team IS NOT NULL AND QueryDate IS NOT NULL"))
    for side in ("Home", "Away"):
        own = ratings.select(F.col("team").alias("_team"), F.col("day").alias("_day"), F.col("elo").alias(f"{side}_Elo"))
        same = (F.col(f"{side}Team") == F.col("_team")) & (F.to_date("Date") == F.col("_day"))
        rated = rated.join(own, same, "left").drop("_team", "_day")
    return rated


def repeated_ratings(elo: DataFrame) -> DataFrame:
    """Team and day pairs with more than one rating; such pairs fail ``join_elo``."""
    return elo.groupBy("team", "QueryDate").agg(F.count("*").alias("ratings")).where("ratings > 1")
