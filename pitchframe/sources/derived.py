"""Matches and ratings derived from the order tables.

One match per order: the customer's market segment is the league, the order year
the season, the customer's nation the home team.  Scores and statistics are read
off the digits of the order total.  Spark derives all of it, so the work grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def derived_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, nation = F.col("o_orderkey"), F.col("c_nationkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")

    def digit(divisor: int, modulus: int) -> Column:
        return F.expr(f"cast((cents div {divisor}) % {modulus} as int)")

    def outcome(home: Column, away: Column) -> Column:
        return F.when(home > away, "H").when(home < away, "A").otherwise("D")

    goals = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .withColumn("cents", cents)
        .select(
            key.alias("match_seq"),
            F.col("c_mktsegment").alias("div_name"),
            F.year("o_orderdate").alias("season"),
            F.to_date("o_orderdate").alias("Date"),
            F.concat((12 + key % 8).cast("string"), F.lit(":00")).alias("Time"),
            F.concat(F.lit("NATION_"), nation.cast("string")).alias("HomeTeam"),
            F.concat(F.lit("NATION_"), ((nation + 1 + key % 24) % 25).cast("string")).alias("AwayTeam"),
            "cents",
            digit(1, 5).alias("FTHG"),
            digit(5, 4).alias("FTAG"),
        )
    )
    home, away = F.col("FTHG"), F.col("FTAG")
    half_home, half_away = F.expr("cast(FTHG div 2 as int)"), F.expr("cast(FTAG div 2 as int)")
    has_shots = F.col("cents") % 97 != 0
    return goals.select(
        "match_seq", "div_name", "season", "Date", "Time", "HomeTeam", "AwayTeam", "FTHG", "FTAG",
        outcome(home, away).alias("FTR"),
        half_home.alias("HTHG"),
        half_away.alias("HTAG"),
        outcome(half_home, half_away).alias("HTR"),
        F.when(has_shots, home + digit(20, 4) + digit(320, 9)).alias("HS"),
        (away + digit(80, 4) + digit(2880, 9)).alias("AS"),
        F.when(has_shots, home + digit(20, 4)).alias("HST"),
        (away + digit(80, 4)).alias("AST"),
        *[digit(1, modulus).alias(name) for name, modulus in
          [("HF", 17), ("AF", 19), ("HC", 11), ("AC", 13), ("HY", 4), ("AY", 6), ("HR", 2), ("AR", 3)]],
    )


def derived_elo(matches: DataFrame) -> DataFrame:
    """One rating per team and even day on which it played."""
    number = F.expr("cast(substr(team, 8) as int)")
    return (
        matches.select("Date", F.explode(F.array("HomeTeam", "AwayTeam")).alias("team"))
        .where(F.dayofmonth("Date") % 2 == 0)
        .distinct()
        .select(
            "team",
            F.col("Date").alias("QueryDate"),
            (1000 + (number * 37 + F.dayofmonth("Date") * 11) % 900).cast("double").alias("elo"),
        )
    )
