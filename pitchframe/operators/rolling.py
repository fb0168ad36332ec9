"""Lagged rolling means: a team's form before each match.

Every frame ends at the row before the current one, so no feature sees its own
match.  All means come from one shuffle, by league, block and team, and one sort: a window
would add up every frame of every measure row by row, numpy adds whole columns, in the same order.

A block is a run of consecutive matches of a league.  Ordinary leagues are one
block.  In a league larger than that, each block also receives the few earlier
rows its first frames reach back to, so a huge league, or one team with most of its
matches, spreads over many tasks and every mean stays exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pitchframe.columns import FORM_MEASURES, LEAGUE, OUTCOME_MEASURES, WINDOWS, require_columns
from pitchframe.functions.scoring import shot_accuracy, win_value
from pitchframe.operators.ordering import number_matches

BLOCK = 1 << 18  # matches of a league handled together
# Column suffix and grouping of the two scopes.
SCOPES = {"": ["Team", "Venue"], "_all": ["Team"]}


def rolling_name(measure: str, window: int, scope: str) -> str:
    return f"{measure}_Rolling{window}{scope}"


def _with_history(rows: DataFrame, reach: int, block: int) -> DataFrame:
    """Give each block the last ``reach`` earlier rows of every team and venue, marked ``_past``."""
    rows = rows.withColumn("_block", F.expr(f"match_no div {block}"))
    tails = last_rows(rows, reach, block).select(*rows.columns)
    return rows.withColumn("_past", F.lit(False)).unionByName(tails.withColumn("_past", F.lit(True)))


def last_rows(rows: DataFrame, reach: int, block: int) -> DataFrame:
    """The rows of a ``_block`` that later ones look back on, once for each of these.

    Where ``later`` tells how many rows of a team and venue follow in a chunk, and blocks are whole
    chunks, only the last rows of chunks are sorted; else all rows of leagues larger than a block.
    """
    history = [*LEAGUE, "Team", "Venue"]
    newest_first = Window.partitionBy(*history, "_block").orderBy(F.desc("match_no"))
    in_order = Window.partitionBy(*history).orderBy("match_no")
    late = rows.where(F.col("league_matches") > block)
    if "later" in rows.columns:
        late = late.where(F.col("later") < reach)
    # A block's last rows stay in reach until ``reach`` newer ones follow.
    return (
        late.withColumn("_age", F.row_number().over(newest_first))
        .where(F.col("_age") <= reach)
        .withColumn("_last", F.expr(f"(league_matches - 1) div {block}"))
        .withColumn("_until", F.coalesce(F.lead("_block", reach).over(in_order), F.col("_last")))
        .where(F.col("_until") > F.col("_block"))
        .withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, F.col("_until"))))
    )


def rolling_means(
    rows: DataFrame,
    measures: list[str],
    windows: list[int] = WINDOWS,
    scopes: list[str] | None = None,
    block: int = BLOCK,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the mean of each measure over a team's previous matches.

    ``windows`` are the numbers of matches looked back on; scope ``""`` counts only
    matches at the same venue, ``"_all"`` all of them.  Missing values are skipped;
    without any earlier value the mean is NULL.  ``keep`` are the columns of ``rows`` to stay,
    by default all; others need not go through the Python workers and back.
    """
    require_columns(rows, measures)
    scopes = list(SCOPES) if scopes is None else scopes
    kept = rows.columns if keep is None else keep
    if "match_no" not in rows.columns or "league_matches" not in rows.columns:
        rows = number_matches(rows.drop("match_no", "league_matches"), LEAGUE, ties=("Venue",))

    reach = max(windows)
    needed = list(dict.fromkeys([*kept, *LEAGUE, "Team", "Venue", "match_no", "_block", "_past", *measures]))
    history = _with_history(rows, reach, block).select(*needed)
    by = [*LEAGUE, "_block", "Team"]
    # One shuffle and one sort; the values of a frame are added up in order, as a window would.
    dealt = history.repartition(*by).sortWithinPartitions(*by, "match_no")
    names = [rolling_name(m, window, scope) for scope in scopes for window in windows for m in measures]
    kept_fields = [history.schema[c] for c in kept]
    schema = StructType([*kept_fields, *[StructField(n, DoubleType()) for n in names]])
    return dealt.mapInArrow(_means_of(measures, windows, scopes, by, kept), schema).select(*kept, *names)


def _means_of(measures: list[str], windows: list[int], scopes: list[str], by: list[str], kept: list[str]):
    """Batches in order to their rows but the ``_past`` ones, with the means.

    Of the last group in a batch the rows that later frames may reach are carried on.
    """
    reach = max(windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            now = pa.table(batch)
            first = 0
            if carried is not None:
                first, now = len(carried), pa.concat_tables([carried, now])
            group, venue = numbers(now, by), numbers(now, ["Venue"], changes=False)
            means = window_means({m: now[m] for m in measures}, windows, scopes, group, venue)
            wanted = ~now["_past"].to_numpy()
            wanted[:first] = False
            out = now.select(kept).filter(pa.array(wanted))
            for name, values, missing in means:
                out = out.append_column(name, pa.array(values[wanted], mask=missing[wanted]))
            yield from out.to_batches()
            last = np.flatnonzero(group == group[-1])
            tails = [own[-reach:] for own in (last[venue[last] == v] for v in np.unique(venue[last]))]
            carried = now.take(pa.array(np.sort(np.concatenate(tails))))

    return run


def numbers(table: pa.Table, columns: list[str], changes: bool = True) -> np.ndarray:
    """A number a row: that of its run of equal values in ``columns``, or of its value in a single one."""
    codes = []
    for c in columns:
        coded = table[c].combine_chunks().dictionary_encode(null_encoding="encode")
        codes.append(coded.indices.to_numpy(zero_copy_only=False))
    if not changes:
        return codes[0]
    moved = np.zeros(len(table), dtype=bool)
    for own in codes:
        moved[1:] |= own[1:] != own[:-1]
    return moved.cumsum()


def window_means(
    given: dict[str, pa.ChunkedArray], windows: list[int], scopes: list[str], group: np.ndarray, venue: np.ndarray
) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(column, means, missing) for every given measure, window and scope."""
    values = {m: v.cast(pa.float64()).combine_chunks() for m, v in given.items()}
    known = {m: v.is_valid().to_numpy(zero_copy_only=False) for m, v in values.items()}
    filled = {m: v.fill_null(0.0).to_numpy(zero_copy_only=False) for m, v in values.items()}
    for scope in scopes:
        parts = venue if "Venue" in SCOPES[scope] else np.zeros_like(venue)
        order = np.lexsort((parts, group))
        key = np.stack([group[order], parts[order]])
        heads = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
        place = np.arange(len(order)) - np.flatnonzero(heads)[heads.cumsum() - 1]
        for window in windows:
            for m in given:
                own, own_known = filled[m][order], known[m][order]
                total, count = np.zeros(len(order)), np.zeros(len(order), dtype=np.int64)
                for back in range(min(window, len(order) - 1), 0, -1):
                    inside = place[back:] >= back
                    total[back:] += np.where(inside, own[:-back], 0.0)
                    count[back:] += inside & own_known[:-back]
                mean, missing = np.empty(len(order)), np.empty(len(order), dtype=bool)
                mean[order], missing[order] = total / np.maximum(count, 1), count == 0
                yield rolling_name(m, window, scope), mean, missing


def with_form_measures(rows: DataFrame) -> DataFrame:
    """Add ShotAccuracy and Win to team rows."""
    return rows.withColumns(
        {
            "ShotAccuracy": shot_accuracy(F.col("ShotsOnTarget"), F.col("Shots")),
            "Win": win_value(F.col("Result")),
        }
    )


def add_rolling_features(
    team_rows: DataFrame,
    measures: list[str] | None = None,
    windows: list[int] = WINDOWS,
    scopes: list[str] | None = None,
    block: int = BLOCK,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ShotAccuracy, Win and the rolling means: 68 columns with the default lists."""
    measures = [*FORM_MEASURES, *OUTCOME_MEASURES] if measures is None else measures
    return rolling_means(with_form_measures(team_rows), measures, windows, scopes, block, keep)
