"""Team rows back to one wide row per match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.columns import MATCH_COLUMNS, MATCH_KEY, LEAGUE, columns_like

SIDES = {"H": ("Home_", "HomeTeam"), "A": ("Away_", "AwayTeam")}

# Match columns and where the home side's row has them.
HOME_SIDE = {
    "Date": "Date", "Time": "Time", "HomeTeam": "Team", "AwayTeam": "Opponent",
    "FTR": "Result", "FTHG": "GoalsFor", "FTAG": "GoalsAgainst",
}
# What ``to_match_rows`` takes from team rows when it is given nothing else, besides rolling means.
CARRIED = [*MATCH_KEY, "Venue", "TablePosDiff", *HOME_SIDE.values()]


def feature_columns(team_rows: DataFrame) -> list[str]:
    """The columns known before kick-off: the table gap and every rolling mean."""
    return ["TablePosDiff", *columns_like(team_rows, "Rolling")]


def _prefixed(struct: str, columns: list[str], prefix: str) -> list[Column]:
    return [F.col(f"{struct}.{c}").alias(f"{prefix}{c}") for c in columns]


def to_match_rows(
    team_rows: DataFrame,
    matches: DataFrame | None = None,
    keep: str = "features",
    kick_off_key: list[str] | None = None,
) -> DataFrame:
    """One row per match with the home side's columns as ``Home_*`` and the away side's as ``Away_*``.

    ``keep="features"`` takes only what is known before kick-off; ``keep="all"`` takes
    every team column and every match column.  The sides are found by the match key.
    Without ``matches`` the seven columns that ``keep="features"`` takes from them come from
    the home side's rows, so nothing is joined.
    With ``kick_off_key`` (``["Date", "Time"]`` or ``["Date"]``) they are found by those
    columns and the team's name instead, which is right only where a team plays once
    per such key: further matches multiply the rows, as in any join.
    """
    known = {*MATCH_KEY, "Date", "Time", "Team", "Venue", "match_no", "league_matches", "later"}
    columns = feature_columns(team_rows)
    if matches is None:
        if keep != "features" or kick_off_key is not None:
            raise ValueError("only the feature rows by match key can do without the matches")
        return _from_home_side(team_rows, columns)
    base = [c for c in (*MATCH_KEY, *MATCH_COLUMNS) if c in matches.columns]
    if keep == "all":
        columns = [c for c in team_rows.columns if c not in known]
        base = [c for c in matches.columns if c not in ("match_no", "league_matches", "home_later", "away_later")]
    elif keep != "features":
        raise ValueError(f"keep must be 'features' or 'all', not {keep!r}")
    if kick_off_key is not None:
        return _by_kick_off(team_rows, matches.select(*base), columns, kick_off_key)

    sides = _sides(team_rows, {venue: columns for venue in SIDES})
    return matches.select(*base).join(sides, MATCH_KEY, "left").select(*base, *_wide(columns))


def _sides(team_rows: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """One row per match with a struct of the given columns for either side."""

    def side(venue: str) -> Column:
        packed = F.struct(*[F.col(c) for c in columns[venue]])
        return F.first(F.when(F.col("Venue") == venue, packed), ignorenulls=True).alias(venue)

    # A match has two rows, so combining before the shuffle would only sort them once more.  The
    # season leads, so that rows come in the order in which folders by season are written.
    key = sorted(MATCH_KEY, key=lambda c: c != "season")
    return team_rows.repartition(*key).groupBy(*key).agg(*[side(venue) for venue in SIDES])


def _wide(columns: list[str]) -> list[Column]:
    return [c for venue, (prefix, _) in SIDES.items() for c in _prefixed(venue, columns, prefix)]


def _from_home_side(team_rows: DataFrame, columns: list[str]) -> DataFrame:
    sides = _sides(team_rows, {"H": list(dict.fromkeys([*HOME_SIDE.values(), *columns])), "A": columns})
    base = {name: F.col(f"H.{own}") for name, own in HOME_SIDE.items()}
    base["FTR"] = F.when(base["FTR"] == "W", "H").when(base["FTR"] == "L", "A").otherwise(base["FTR"])
    return sides.select(*MATCH_KEY, *[base[c].alias(c) for c in MATCH_COLUMNS], *_wide(columns))


def _by_kick_off(
    team_rows: DataFrame, matches: DataFrame, columns: list[str], kick_off_key: list[str]
) -> DataFrame:
    wide = matches
    for venue, (prefix, team) in SIDES.items():
        keys = {**{k: k for k in (*LEAGUE, *kick_off_key)}, team: "Team"}
        side = team_rows.where(F.col("Venue") == venue).select(
            *[F.col(right).alias(f"_{left}") for left, right in keys.items()],
            *[F.col(c).alias(f"{prefix}{c}") for c in columns],
        )
        same = [F.col(left).eqNullSafe(F.col(f"_{left}")) for left in keys]
        wide = wide.join(side, same, "left").drop(*[f"_{left}" for left in keys])
    return wide


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a missing value."""
    return df.dropna("any")
