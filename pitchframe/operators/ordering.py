"""Exact row positions within a group, without sorting a group in one task.

``row_number() over (partition by league order by date, time)`` sorts a whole
league in one task.  Here the order is cut into cells - one kick-off, and within
it one range of ``CELL`` consecutive sequence numbers - so a cell holds at most
``CELL`` rows however large the league or the kick-off is.  The position of a row is

    rows in earlier cells + rank in its cell

and the first term is a running sum over counts, which are pre-aggregated on the map
side.  A season has at most 525,600 distinct minutes, and a cell more for every ``CELL``
rows of one, which bounds the only window that spans a league.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 20


def day_key(date: str = "Date") -> Column:
    """Date for ordering and joining; a missing one comes last."""
    return F.coalesce(F.col(date), F.lit("9999-12-31").cast("date"))


def clock_key(time: str = "Time") -> Column:
    """``HH:MM`` for ordering and joining; a missing one comes last."""
    return F.coalesce(F.col(time), F.lit("~"))


def present(key: str) -> Column:
    """A key column; a NULL in it raises."""
    return F.coalesce(F.col(key), F.raise_error(F.lit(f"{key} is NULL; set such rows apart with split_unscored")))


def match_order() -> list[Column]:
    """Chronological order with the source order as tie-break."""
    return [day_key(), clock_key(), F.col("match_seq")]


def number_matches(
    matches: DataFrame,
    groups: list[str],
    ties: tuple[str, ...] = (),
    number: str = "match_no",
    size: str = "league_matches",
) -> DataFrame:
    """Add the 0-based chronological position of each row in its group, and the group's size.

    ``match_seq`` (then ``ties``) must tell apart rows with the same kick-off.  A NULL
    among the groups or in ``match_seq`` fails the run: ``split_unscored`` sets such rows
    apart at ingest, and they must not vanish here.
    """
    cell = [*groups, "_day", "_clock", "_cell"]
    keyed = matches.withColumns(
        {
            **{k: present(k) for k in groups},
            "_day": day_key(),
            "_clock": clock_key(),
            "_cell": F.shiftright(present("match_seq"), CELL_BITS),
        }
    )

    cells = keyed.groupBy(*cell).agg(F.count("*").alias("_n"))
    in_group = Window.partitionBy(*groups)
    earlier = in_group.orderBy("_day", "_clock", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        *cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(in_group).alias(size)
    )
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("match_seq", *ties))
    return (
        keyed.join(starts, cell)
        .withColumn(number, F.col("_start") + rank - 1)
        .select(*matches.columns, number, size)
    )
