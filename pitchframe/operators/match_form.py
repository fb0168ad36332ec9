"""Rolling means of both sides, a row per match.

``to_team_rows``, ``rolling_means`` and ``to_match_rows`` shuffle the finished means once more to bring a
match's two rows together.  Here the matches stay whole: a league's blocks are dealt and sorted as they
are, a task lays both sides of its matches side by side and hands the means on with them.  Each block
gets the few earlier matches that its first frames look back on, so blocks change no mean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pitchframe.columns import LEAGUE, MATCH_KEY, WINDOWS
from pitchframe.functions.scoring import shot_accuracy, win_value
from pitchframe.operators.match_rows import SIDES
from pitchframe.operators.rolling import SCOPES, last_rows, numbers, rolling_name, window_means
from pitchframe.operators.standings import CHUNK, later_of_same
from pitchframe.operators.team_rows import side_fields, worked_out

BLOCK = 2 * CHUNK  # matches of a league handled together
TEAMS = {venue: team for venue, (_, team) in SIDES.items()}


def side_measures(venue: str) -> dict[str, Column]:
    """Every measure of one side, from the columns of the match."""
    fields = side_fields(venue)
    fields |= worked_out(fields)
    shots = shot_accuracy(fields["ShotsOnTarget"], fields["Shots"])
    return fields | {"ShotAccuracy": shots, "Win": win_value(fields["Result"])}


def _with_earlier(placed: DataFrame, reach: int, block: int) -> DataFrame:
    """Give each block the earlier matches its first frames reach, marked ``_past``."""
    rows = placed.withColumn("_block", F.expr(f"match_no div {block}"))
    either = [
        F.struct(F.col(team).alias("Team"), F.lit(venue).alias("Venue"), F.col(later).alias("later"))
        for (venue, team), later in zip(TEAMS.items(), ("home_later", "away_later"))
    ]
    late = rows.where((F.col("league_matches") > block) & (F.least("home_later", "away_later") < reach))
    # A match may be among the last ones of both its teams.
    tails = last_rows(late.select("*", F.inline(F.array(*either))), reach, block)
    tails = tails.select(*rows.columns).dropDuplicates([*MATCH_KEY, "match_no", "_block"])
    return rows.withColumn("_past", F.lit(False)).unionByName(tails.withColumn("_past", F.lit(True)))


def add_match_form(
    placed: DataFrame,
    measures: list[str],
    windows: list[int] = WINDOWS,
    scopes: list[str] | None = None,
    keep: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The rolling means of each measure as ``Home_*`` and ``Away_*`` columns, as ``rolling_means`` has them.

    ``placed`` comes from ``add_table_positions`` with ``later``; its chunk must divide ``block``.  ``keep`` are
    the columns of ``placed`` to stay, by default all.
    """
    scopes = list(SCOPES) if scopes is None else scopes
    kept = placed.columns if keep is None else keep
    by = [*LEAGUE, "_block"]
    rows = _with_earlier(placed, max(windows), block)
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "match_no")
    # Measures are worked out behind the shuffle, which carries the columns they come from.
    own = {f"_{venue}_{m}": side_measures(venue)[m] for venue in SIDES for m in measures}
    inner = {f"_{c}": F.col(c) for c in (*LEAGUE, *TEAMS.values())}
    given = dealt.select(*kept, "_block", "_past", *[c.alias(name) for name, c in (own | inner).items()])
    names = [f"{p}{rolling_name(m, w, s)}" for p, _ in SIDES.values() for s in scopes for w in windows for m in measures]
    schema = StructType([*[placed.schema[c] for c in kept], *[StructField(n, DoubleType()) for n in names]])
    return given.mapInArrow(_both_sides(measures, windows, scopes, kept, names), schema)


def _both_sides(measures: list[str], windows: list[int], scopes: list[str], kept: list[str], names: list[str]):
    """Batches in order to their matches but the ``_past`` ones, with the means of both sides.

    Of the last block in a batch the matches that later frames may reach are carried on.
    """
    reach = max(windows)

    def turns(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Home and away values in turn."""
        return np.stack([first, second], axis=1).ravel()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            now, first = pa.table(batch), 0
            if carried is not None:
                first, now = len(carried), pa.concat_tables([carried, now])
            n = len(now)
            block = numbers(now, [*(f"_{c}" for c in LEAGUE), "_block"])
            teams = pa.concat_arrays([now[f"_{team}"].combine_chunks() for team in TEAMS.values()])
            code = numbers(pa.table({"team": teams}), ["team"], changes=False).astype(np.int64)
            code += np.tile(block, 2) * (code.max() + 1)
            in_turn = turns(np.arange(n), np.arange(n, 2 * n))
            values = {
                m: pa.concat_arrays([now[f"_{venue}_{m}"].cast(pa.float64()).combine_chunks() for venue in SIDES]) for m in measures
            }
            given = {m: pa.chunked_array([v.take(pa.array(in_turn))]) for m, v in values.items()}
            wanted = ~now["_past"].to_numpy()
            wanted[:first] = False
            columns = dict(zip(kept, now.select(kept).filter(pa.array(wanted)).columns))
            for name, means, missing in window_means(given, windows, scopes, code[in_turn], np.tile([0, 1], n)):
                for place, (prefix, _) in enumerate(SIDES.values()):
                    own = slice(place, None, 2)
                    columns[f"{prefix}{name}"] = pa.array(means[own][wanted], mask=missing[own][wanted])
            yield from pa.table([columns[c] for c in (*kept, *names)], [*kept, *names]).combine_chunks().to_batches()
            last = np.flatnonzero(block == block[-1])
            home, away = (later_of_same(code[last + shift]) < reach for shift in (0, n))
            carried = now.take(pa.array(last[home | away]))

    return run
