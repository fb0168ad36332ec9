"""The league table as it stood before each match.

A league is cut into chunks of consecutive matches.  The table at the start of
each chunk comes from running sums over per-chunk totals, which Spark pre-aggregates
on the map side.  The chunks are then independent: each one books its own matches
onto its opening table, so one league - however many matches it holds - spreads over
the whole cluster.

Ranking needs every team's totals at every match.  As rows that would multiply the
matches by the number of teams before a shuffle; inside a chunk it is a small matrix
of running totals, so this step alone is a grouped map on Arrow batches with numpy.
The matches pass through it with all their columns, so nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pitchframe.columns import LEAGUE, MATCH_KEY, require_columns
from pitchframe.functions.scoring import score_points
from pitchframe.operators.ordering import number_matches
from pitchframe.session import settle_if_shared

CHUNK = 16_384  # matches replayed together
TILE = 1 << 20  # entries of the matches x teams matrix held at once
POSITION_COLUMNS = ["HomeTablePos", "AwayTablePos", "TablePosDiff"]
LATER_COLUMNS = ["home_later", "away_later"]
TOTALS = ["pts", "gd", "gf", "played"]
GOALS = ["_home_goals", "_away_goals"]


def _in_chunks(numbered: DataFrame, chunk: int) -> DataFrame:
    """Numbered matches with their chunk; a missing score adds no goals."""
    return (
        numbered
        .withColumn("chunk", F.expr(f"match_no div {chunk}"))
        .withColumn("last_chunk", F.expr(f"(league_matches - 1) div {chunk}"))
        .withColumns({g: F.coalesce(F.col(g).cast("long"), F.lit(0)) for g in ("FTHG", "FTAG")})
    )


def booked_totals(numbered: DataFrame, by: list[str]) -> DataFrame:
    """(league, team, ``by``, totals) of the given matches."""
    home, away = F.col("FTHG"), F.col("FTAG")

    def booked(team: str, own: Column, other: Column) -> Column:
        return F.struct(
            F.col(team).alias("team"),
            score_points(own, other).alias("pts"),
            (own - other).alias("gd"),
            own.alias("gf"),
        )

    sides = F.inline(F.array(booked("HomeTeam", home, away), booked("AwayTeam", away, home)))
    return (
        numbered.select(*LEAGUE, *by, sides)
        .groupBy(*LEAGUE, "team", *by)
        .agg(*[F.sum(t).alias(t) for t in TOTALS[:3]], F.count("*").alias("played"))
    )


def opening_tables(numbered: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Every team's totals at the start of each chunk of its league.

    ``numbered`` has one row per match with ``chunk`` and ``last_chunk``; ``earlier`` holds what
    the teams brought from matches before these (league, team, totals).
    """
    opened = _opened(numbered)
    if earlier is None:
        return opened
    chunks = numbered.groupBy(*LEAGUE).agg(F.max("last_chunk").alias("_last"))
    brought = earlier.join(chunks, LEAGUE).select(
        *LEAGUE, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias("chunk"), "team", *TOTALS
    )
    both = opened.withColumn("chunk", F.col("chunk").cast("long")).unionByName(brought)
    return both.groupBy(*LEAGUE, "chunk", "team").agg(*[F.sum(t).alias(t) for t in TOTALS])


def _opened(numbered: DataFrame) -> DataFrame:
    per_chunk = booked_totals(numbered, ["chunk", "last_chunk"])
    by_chunk = Window.partitionBy(*LEAGUE, "team").orderBy("chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    running = per_chunk.select(
        "*",
        F.lag("chunk", 1, -1).over(by_chunk).alias("previous"),
        F.lead("chunk").over(by_chunk).isNull().alias("is_last"),
        *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"{t}_before") for t in TOTALS],
    )

    # A team that sits out some chunks opens all of them with the same totals.
    def span(first: Column, last: Column, totals: list[Column]) -> Column:
        named = [value.alias(t) for t, value in zip(TOTALS, totals)]
        return F.struct(F.sequence(first, last).alias("chunks"), *named)

    before = [F.col(f"{t}_before") for t in TOTALS]
    until_now = span(F.col("previous") + 1, F.col("chunk"), before)
    to_the_end = span(
        F.col("chunk") + 1, F.col("last_chunk"), [b + F.col(t) for t, b in zip(TOTALS, before)]
    )
    idle_end = F.col("is_last") & (F.col("chunk") < F.col("last_chunk"))
    return running.select(
        *LEAGUE,
        "team",
        F.inline(F.when(idle_end, F.array(until_now, to_the_end)).otherwise(F.array(until_now))),
    ).select(*LEAGUE, F.explode("chunks").alias("chunk"), "team", *TOTALS)


def _totals_before(
    opening: np.ndarray, home: np.ndarray, away: np.ndarray, home_adds: np.ndarray, away_adds: np.ndarray
) -> np.ndarray:
    """Running totals (match x team) before each match, with one row more for the end."""
    steps = np.zeros((len(home) + 1, len(opening)), dtype=np.int64)
    steps[0] = opening
    after = np.arange(1, len(home) + 1)
    np.add.at(steps, (after, home), home_adds)
    np.add.at(steps, (after, away), away_adds)
    return steps.cumsum(axis=0)


def _ranks(pts: np.ndarray, gd: np.ndarray, gf: np.ndarray, team: np.ndarray) -> np.ndarray:
    """1 + the number of teams ahead of ``team``; level teams go by name, which is column order."""
    row = np.arange(len(team))

    def against(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = totals[row, team][:, None]
        return totals > own, totals == own

    ahead = np.arange(pts.shape[1])[None, :] < team[:, None]
    for totals in (gf, gd, pts):
        above, level = against(totals)
        ahead = above | (level & ahead)
    return ahead.sum(axis=1) + 1


def later_of_same(codes: np.ndarray) -> np.ndarray:
    """For every place, how many later places hold the same code."""
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], codes[order], side="right")
    later = np.empty(len(codes), dtype=np.int32)
    later[order] = ends - 1 - np.arange(len(codes))
    return later


def _replay(
    min_played: int, default_position: int, kept: list[str], later: bool
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def replay_chunk(matches: pa.Table, opening: pa.Table) -> pa.Table:
        order = np.argsort(matches["match_no"].to_numpy(), kind="stable")
        opening = opening.sort_by("team")
        teams = opening["team"].combine_chunks()
        home = pc.index_in(matches["HomeTeam"], value_set=teams).to_numpy()[order]
        away = pc.index_in(matches["AwayTeam"], value_set=teams).to_numpy()[order]
        home_goals, away_goals = (matches[c].to_numpy()[order] for c in GOALS)
        margin = home_goals - away_goals
        home_points = np.select([margin > 0, margin < 0], [3, 0], 1)
        away_points = np.select([margin < 0, margin > 0], [3, 0], 1)
        once = np.ones_like(home_points)
        adds = {
            "pts": (home_points, away_points),
            "gd": (margin, -margin),
            "gf": (home_goals, away_goals),
            "played": (once, once),
        }
        state = {t: opening[t].to_numpy() for t in TOTALS}

        def positions() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            tile = max(1, TILE // max(1, len(teams)))
            for start in range(0, len(home), tile):
                part = slice(start, start + tile)
                sides = home[part], away[part]
                table = {}
                for t in TOTALS:
                    running = _totals_before(state[t], *sides, adds[t][0][part], adds[t][1][part])
                    table[t], state[t] = running[:-1], running[-1]
                row = np.arange(len(sides[0]))
                yield tuple(
                    np.where(
                        table["played"][row, side] < min_played,
                        default_position,
                        _ranks(table["pts"], table["gd"], table["gf"], side),
                    )
                    for side in sides
                )

        found = dict(zip(POSITION_COLUMNS, (np.concatenate(side) for side in zip(*positions()))))
        if later:
            found |= zip(LATER_COLUMNS, (later_of_same(home), later_of_same(away)))
        out = matches.select(kept)
        for name, values in found.items():
            placed = np.empty(len(order), dtype=np.int32)
            placed[order] = values
            out = out.append_column(name, pa.array(placed))
        return out

    return replay_chunk


def add_table_positions(
    matches: DataFrame,
    min_played: int = 3,
    default_position: int = 10,
    chunk: int = CHUNK,
    settled: bool = False,
    earlier: DataFrame | None = None,
    later: bool = False,
) -> DataFrame:
    """Add both sides' table positions before kick-off and their difference.

    Teams rank by points, goal difference, goals scored and name, over all teams
    of the league-season, played or not.  Matches count one after another in
    (Date, Time, match_seq) order.  Until a team has played ``min_played`` matches
    its position is ``default_position``.

    Also adds ``match_no``, the match's place in that order, and ``league_matches``,
    the number of matches in its league-season.  ``settled`` writes the numbered matches to
    the shared folder, if there is one, and goes on from there.  ``earlier`` (league, team,
    totals) is the table before these matches.  ``later`` adds ``home_later`` and ``away_later``:
    how many home matches of the home team follow in the chunk, and away matches of the away team.
    """
    needed = [*MATCH_KEY, "Date", "Time", "HomeTeam", "AwayTeam", "FTHG", "FTAG"]
    require_columns(matches, needed)
    stale = [c for c in (*POSITION_COLUMNS, *LATER_COLUMNS, "match_no", "league_matches") if c in matches.columns]
    # Openings, replay and result all start from here: where possible it is worked out once.
    placed = number_matches(matches.drop(*stale), LEAGUE)
    placed = settle_if_shared(placed) if settled else placed
    numbered = _in_chunks(placed.select(*MATCH_KEY, "HomeTeam", "AwayTeam", "FTHG", "FTAG", "match_no", "league_matches"), chunk)
    chunk_key = [*LEAGUE, "_chunk"]
    kept = [*MATCH_KEY, *[c for c in placed.columns if c not in MATCH_KEY]]
    added = [*POSITION_COLUMNS[:2], *(LATER_COLUMNS if later else [])]
    schema = StructType([*[placed.schema[c] for c in kept], *[StructField(c, IntegerType()) for c in added]])
    opening = opening_tables(numbered, earlier).withColumnRenamed("chunk", "_chunk")
    goals = {name: F.coalesce(F.col(g).cast("long"), F.lit(0)) for name, g in zip(GOALS, ("FTHG", "FTAG"))}
    replayed = (
        placed.withColumns({"_chunk": F.expr(f"match_no div {chunk}"), **goals})
        .groupBy(*chunk_key)
        .cogroup(opening.withColumnsRenamed({k: f"at_{k}" for k in chunk_key}).groupBy(*[f"at_{k}" for k in chunk_key]))
        .applyInArrow(_replay(min_played, default_position, kept, later), schema)
    )
    gap = (F.col("AwayTablePos") - F.col("HomeTablePos")).alias("TablePosDiff")
    return replayed.select(*kept, *POSITION_COLUMNS[:2], gap, *added[2:])
