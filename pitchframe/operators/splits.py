"""Chronological and walk-forward splits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.operators.ordering import clock_key, day_key, number_matches


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``row_no``, the place among all rows by season, kick-off and source order, and ``rows_total``.

    Places within a season come from ``number_matches``; the seasons before it add
    their sizes, which is a running sum over one row per season.
    """
    numbered = number_matches(df, ["season"], ties=("div_name",), number="row_no", size="_rows")
    sizes = df.groupBy("season").agg(F.count("*").alias("_size"))
    # One row per season, so a window without partitions is safe.
    before = Window.partitionBy(F.lit(0)).orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "season",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("rows_total"),
    )
    return (
        numbered.join(starts, "season")
        .withColumn("row_no", F.col("row_no") + F.col("_before"))
        .drop("_before", "_rows")
    )


def chronological_split(df: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Add ``split``: the first ``train_share`` of the rows train, the later ones test."""
    boundary = F.floor(F.col("rows_total") * F.lit(train_share))
    return (
        number_rows(df)
        .withColumn("split", F.when(F.col("row_no") < boundary, "train").otherwise("test"))
        .drop("row_no", "rows_total")
    )


def chronological_parts(df: DataFrame, train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The rows that ``chronological_split`` marks ``train``, and the others.

    Only the columns of the order are numbered, to find the first test row; every row is then
    compared with that one, so wide rows stay where they are.  ``df`` is read several times.
    """
    order = {"season": F.col("season"), "day": day_key(), "clock": clock_key(), "seq": F.col("match_seq"), "div": F.col("div_name")}
    numbered = number_rows(df.select("season", "Date", "Time", "match_seq", "div_name"))
    first_test = numbered.where(F.col("row_no") == F.floor(F.col("rows_total") * F.lit(train_share)))
    places = first_test.select(*[c.alias(name) for name, c in order.items()])
    found = places.first()
    if found is None:
        return df, df.where(F.lit(False))
    mark = {name: F.lit(found[name]).cast(kind) for name, kind in places.dtypes}
    earlier = F.struct(*[c.alias(n) for n, c in order.items()]) < F.struct(*[c.alias(n) for n, c in mark.items()])
    # The seasons are compared once more by themselves, for folders to be left out.
    season = F.col("season")
    return df.where((season <= mark["season"]) & earlier), df.where((season >= mark["season"]) & ~earlier)


def season_order(df: DataFrame) -> DataFrame:
    """One row per season with its place in time, from 0: by first match day, then label."""
    firsts = df.groupBy("season").agg(F.min("Date").alias("first_day"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_day", "season"))
    return firsts.select("season", (place - 1).alias("place"))


def walk_forward_folds(df: DataFrame) -> DataFrame:
    """(fold, role, season): fold k trains on the first k seasons and tests on the next."""
    seasons = season_order(df)
    last = F.max("place").over(Window.partitionBy(F.lit(0)))
    fold = F.explode(F.when(F.col("last") > 0, F.sequence(F.greatest("place", F.lit(1)), F.col("last"))))
    return (
        seasons.withColumn("last", last)
        .select("season", "place", fold.alias("fold"))
        .select("fold", F.when(F.col("place") == F.col("fold"), "test").otherwise("train").alias("role"), "season")
    )


def ordered_seasons(df: DataFrame) -> Iterator:
    """The season labels in time order, fetched as the loop over folds goes on."""
    return (r["season"] for r in season_order(df).orderBy("place").toLocalIterator())


def fold_seasons(df: DataFrame) -> Iterator[tuple[int, list, object]]:
    """(fold, seasons to train on, season to test on) for every fold."""
    earlier: list = []
    for season in ordered_seasons(df):
        if earlier:
            yield len(earlier), list(earlier), season
        earlier.append(season)


def fold_rows(df: DataFrame) -> DataFrame:
    """Every row once per fold it belongs to, with ``fold`` and ``role``.

    The folds are a small table by season; where Spark measures it small it is broadcast,
    and elsewhere a large season is split by adaptive execution.  Rows without a season
    belong to the folds of the season NULL.
    """
    folds = walk_forward_folds(df).withColumnRenamed("season", "_season")
    return df.join(folds, F.col("season").eqNullSafe(F.col("_season"))).select(*df.columns, "fold", "role")
