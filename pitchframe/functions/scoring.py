"""Column expressions: results, points, ratios and table rules.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen.  A category that is none of the known ones maps to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points for a win, draw and loss; win values likewise.
POINTS = {"W": 3, "D": 1, "L": 0}
WIN_VALUE = {"W": 1.0, "D": 0.5, "L": 0.0}
# Full-time result as each side sees it.
HOME_VIEW = {"H": "W", "D": "D", "A": "L"}
AWAY_VIEW = {"A": "W", "D": "D", "H": "L"}


def lookup(value: Column, table: dict) -> Column:
    """CASE over the entries of a small dictionary; no match gives NULL."""
    case = None
    for key, out in table.items():
        case = F.when(value == key, F.lit(out)) if case is None else case.when(value == key, F.lit(out))
    return case


def side_result(ftr: Column, venue: str) -> Column:
    """H/D/A as W/D/L for the side playing at ``venue``."""
    return lookup(ftr, HOME_VIEW if venue == "H" else AWAY_VIEW)


def result_points(result: Column) -> Column:
    return lookup(result, POINTS)


def side_points(ftr: Column, venue: str) -> Column:
    """3/1/0 for the side playing at ``venue``."""
    return result_points(side_result(ftr, venue))


def win_value(result: Column) -> Column:
    return lookup(result, WIN_VALUE)


def score_points(own: Column, other: Column) -> Column:
    """Points from the score itself; a missing score counts as a draw."""
    return F.when(own > other, 3).when(own < other, 0).otherwise(1)


def shot_accuracy(on_target: Column, shots: Column) -> Column:
    """Shots on target per shot; without shots the divisor is 1."""
    return on_target / F.when(shots == 0, 1).otherwise(shots)


def early_season(played: Column, position: Column, min_played: int, default_position: int) -> Column:
    """The stand-in position until a team has played ``min_played`` matches."""
    return F.when(played < min_played, F.lit(default_position)).otherwise(position)


def per_game(points: Column, games: Column) -> Column:
    return F.try_divide(points.cast("double"), games)
