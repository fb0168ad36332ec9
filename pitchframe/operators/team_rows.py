"""One row per match to one row per team and match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.columns import DIFFERENCES, MATCH_KEY, MIRRORED, require_columns
from pitchframe.functions.scoring import result_points, side_result


def side_fields(venue: str, with_positions: bool = False) -> dict[str, Column]:
    """One team's side of a match, from the columns of the match."""
    at_home = venue == "H"
    gap = F.col("TablePosDiff")
    fields = {
        "Team": F.col("HomeTeam" if at_home else "AwayTeam"),
        "Opponent": F.col("AwayTeam" if at_home else "HomeTeam"),
        "Venue": F.lit(venue),
        "TablePosDiff": gap if at_home else -gap,
    }
    if with_positions:
        fields["TeamTablePos"] = F.col("HomeTablePos" if at_home else "AwayTablePos")
        fields["OpponentTablePos"] = F.col("AwayTablePos" if at_home else "HomeTablePos")
    for own, other, home_column, away_column in MIRRORED:
        fields[own] = F.col(home_column if at_home else away_column)
        fields[other] = F.col(away_column if at_home else home_column)
    fields["Result"] = side_result(F.col("FTR"), venue)
    return fields


def worked_out(given: dict[str, Column]) -> dict[str, Column]:
    """Points and differences from the fields of a side."""
    differences = {name: given[a] - given[b] for name, a, b in DIFFERENCES}
    return {"Points": result_points(given["Result"]), **differences}


def to_team_rows(matches: DataFrame, with_positions: bool = False) -> DataFrame:
    """Two rows per match, each from one team's side, from a single pass over ``matches``.

    ``with_positions`` adds both teams' table positions.  ``later`` (from ``home_later`` and
    ``away_later``, if they are there) is the number of rows of a team and venue that follow in its chunk.
    """
    require_columns(matches, ["TablePosDiff"], "Run add_table_positions first.")
    carried = [c for c in ("match_no", "league_matches") if c in matches.columns]

    def side(venue: str) -> Column:
        fields = side_fields(venue, with_positions)
        if "home_later" in matches.columns:
            fields["later"] = F.col("home_later" if venue == "H" else "away_later")
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    rows = matches.select(*MATCH_KEY, *carried, "Date", "Time", F.inline(F.array(side("H"), side("A"))))
    return rows.withColumns(worked_out({c: F.col(c) for c in rows.columns}))
