"""Exact top-k inner products: descending lengths, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Different vectors are sorted by descending length and cut into slices (range partitions) of
blocks.  Every vector is also kept rotated by the right singular vectors of a bounded sample:
its first coordinates then carry most of its length, so that a partial sum over them plus the
product of the two residual lengths bounds an inner product closely.

For a group of queries the longest vectors are scored first, which gives every query a score
that its k-th best will not fall below.  Slices whose longest vector cannot reach any of a
group's scores are not read for it (score <= length * length).  In the others blocks pass
in descending length: partial sums over more and more coordinates rule out queries, vectors
and at last pairs, and what is left is scored exactly in integers.

Copies of a vector have one score, so only the k + 1 smallest ids of each are kept; queries
with equal vectors are searched once.  Both are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import settle

SAMPLE = 4_096  # vectors, about, that the rotation is fitted on
BLOCK = 1_024  # vectors of a block
SLICE = (4_096, 1 << 20)  # least and most vectors of a slice, about
SLICES = 4_096  # at most; their longest lengths are known to the driver
GROUP = 1 << 15  # queries that a block is sent to at once
CHUNK = 1_024  # queries of a group that are multiplied together
FIRST = 8  # blocks of the longest vectors that are scored first
STAGES = (8, 4, 2)  # partial sums over the first 1/8, 1/4, 1/2 of the coordinates
SLACK = 1e-9  # of the product of the lengths: more than rounding can amount to
PAIRS = 1 << 16  # pairs that are scored together
EXACT = float(1 << 62)  # longer products of lengths are summed in Python's integers
LONG = np.iinfo(np.int64)

VECTOR = np.dtype("<f8")


# Vectors as bytes: the integers as doubles, without zeros at the end.


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def _parsed(scale: float):
    """(vec_id, values) to (vec_id, vector, length) of the vectors that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("values")
            flat = column.flatten()
            has_null = np.zeros(len(batch), dtype=bool)
            parent = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
            numbers = integers(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), scale)
            has_null[parent[~np.isfinite(numbers)]] = True
            usable = column.is_valid().to_numpy(zero_copy_only=False) & ~has_null
            sizes = np.bincount(parent, minlength=len(batch))
            ends = np.cumsum(sizes)
            vectors, lengths, kept = [], [], np.flatnonzero(usable)
            numbers = numbers + 0.0  # no negative zero
            for i in kept.tolist():
                own = numbers[ends[i] - sizes[i] : ends[i]]
                own = own[: int(np.flatnonzero(own).max(initial=-1)) + 1]
                vectors.append(own.astype(VECTOR).tobytes())
                # hypot of the scaled parts: squares of large components would overflow.
                top = np.abs(own).max(initial=0.0)
                lengths.append(float(top * np.sqrt(np.square(own / top).sum())) if top else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(kept)), pa.array(vectors, pa.binary()), pa.array(lengths, pa.float64())],
                ["vec_id", "vector", "length"],
            )

    return run


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """A row each, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for row, raw in zip(out, vectors):
        own = np.frombuffer(raw, dtype=VECTOR)
        row[: len(own)] = own
    return out


def fit_rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of about SAMPLE vectors, drawn by a hash of their values."""
    share = min(1.0, SAMPLE / max(1, vectors.count()))
    drawn = vectors.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) < int(share * (1 << 40))).select("vector")
    sample = matrix([bytes(r["vector"]) for r in drawn.orderBy("vector").collect()], width)
    top = np.abs(sample).max(axis=1, initial=0.0, keepdims=True)
    # Directions matter here and not lengths; rows of zeros give every coordinate its vector.
    directions = np.concatenate([sample / np.where(top > 0, top, 1.0), np.zeros((width, width))])
    return np.linalg.svd(directions, full_matrices=False)[2].T


def stage_ends(width: int) -> list[int]:
    return sorted({-(-width // part) for part in STAGES if -(-width // part) < width})


class Rotated:
    """A block of vectors: exact, rotated, and with the length left behind each stage."""

    def __init__(self, exact: np.ndarray, lengths: np.ndarray, rotation: np.ndarray):
        self.exact, self.lengths = exact, lengths
        scale = np.where(lengths > 0, lengths, 1.0)[:, None]
        # Unit vectors: bounds are on cosines, and no square overflows.
        self.turned = (exact / scale) @ rotation
        squares = np.square(self.turned)
        self.residual = [np.sqrt(squares[:, end:].sum(axis=1)) for end in stage_ends(exact.shape[1])]


def exact_scores(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, clamped to a long; ``lengths`` are the products of their lengths."""
    safe = lengths < EXACT
    out = np.empty(len(left), dtype=np.int64)
    for start in range(0, len(left), PAIRS):
        part = slice(start, start + PAIRS)
        with np.errstate(invalid="ignore", over="ignore"):
            out[part] = np.einsum("ij,ij->i", left[part].astype(np.int64), right[part].astype(np.int64))
    for i in np.flatnonzero(~safe).tolist():
        exact = sum(int(a) * int(b) for a, b in zip(left[i].tolist(), right[i].tolist()))
        out[i] = max(LONG.min, min(LONG.max, exact))
    return out


class Search:
    """The k best vectors of every query of a chunk, as blocks in descending length pass.

    Level scores go to the vector with the smaller least id.  A vector beyond the k best has k
    ids before its own, so none of its ids is among the k best ids.
    """

    def __init__(self, queries: Rotated, floors: np.ndarray, k: int):
        self.queries, self.k = queries, k
        # Scores that a result has to reach; below them nothing is kept.
        self.floors = floors.astype(np.float64)
        none = np.zeros(0, dtype=np.int64)
        self.scores, self.places, self.least_ids = ([none] * len(floors) for _ in range(3))

    def hopeful(self, block: Rotated) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) that the bounds do not rule out."""
        queries, least = self.queries, self.floors
        longest = block.lengths.max(initial=0.0)
        rows = np.flatnonzero(queries.lengths * longest * (1 + SLACK) >= least)
        columns = np.arange(len(block.lengths))
        done, partial = 0, np.zeros((len(rows), len(columns)))
        for stage, end in enumerate(stage_ends(queries.exact.shape[1])):
            partial = partial + queries.turned[rows, done:end] @ block.turned[columns, done:end].T
            done = end
            rest = np.outer(queries.residual[stage][rows], block.residual[stage][columns])
            alive = self._alive(partial + rest, rows, columns, block)
            stay, stand = alive.any(axis=1), alive.any(axis=0)
            rows, columns, partial = rows[stay], columns[stand], partial[np.ix_(stay, stand)]
        partial = partial + queries.turned[rows, done:] @ block.turned[columns, done:].T
        at = np.nonzero(self._alive(partial, rows, columns, block))
        return rows[at[0]], columns[at[1]]

    def _alive(self, cosines: np.ndarray, rows: np.ndarray, columns: np.ndarray, block: Rotated) -> np.ndarray:
        products = np.outer(self.queries.lengths[rows], block.lengths[columns])
        return (cosines + SLACK) * products >= self.floors[rows][:, None]

    def feed(self, block: Rotated, least_ids: np.ndarray, first_place: int) -> None:
        """Score a block; its vectors have places from ``first_place`` on."""
        rows, columns = self.hopeful(block)
        lengths = self.queries.lengths[rows] * block.lengths[columns]
        for start in range(0, len(rows), PAIRS):
            part = slice(start, start + PAIRS)
            own = exact_scores(self.queries.exact[rows[part]], block.exact[columns[part]], lengths[part])
            for row, found in zip(*_runs(rows[part])):
                at = columns[part][found]
                self._keep(row, own[found], at + first_place, least_ids[at])

    def _keep(self, row: int, scores: np.ndarray, places: np.ndarray, least_ids: np.ndarray) -> None:
        score = np.concatenate([self.scores[row], scores])
        place = np.concatenate([self.places[row], places])
        least = np.concatenate([self.least_ids[row], least_ids])
        # ~score orders like -score and cannot overflow.
        best = np.lexsort((least, ~score))[: self.k]
        self.scores[row], self.places[row], self.least_ids[row] = score[best], place[best], least[best]
        if len(best) == self.k:
            self.floors[row] = max(self.floors[row], float(score[best[-1]]))


def _runs(rows: np.ndarray) -> tuple[list[int], list[slice]]:
    head = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, dtype=int)
    ends = [*head[1:].tolist(), len(rows)]
    return rows[head].tolist(), [slice(a, b) for a, b in zip(head.tolist(), ends)]


# Spark


def _block_maker(size: int):
    """Sorted (vector, length, ids) rows to rows of ``size`` vectors each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slice_no, held, block_no = TaskContext.get().partitionId(), None, 0

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal block_no
            lengths = table.column("length").combine_chunks()
            row = [slice_no, block_no, max(lengths.to_pylist()), *[table.column(c).to_pylist() for c in ("vector", "length", "ids")]]
            block_no += 1
            schema = [("slice", pa.int32()), ("block", pa.int32()), ("longest", pa.float64()), ("vectors", pa.list_(pa.binary()))]
            schema += [("lengths", pa.list_(pa.float64())), ("ids", pa.list_(pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, schema)], [n for n, _ in schema])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while len(held) >= size:
                yield block(held.slice(0, size))
                held = held.slice(size)
        if held is not None and len(held):
            yield block(held)

    return run


RESULT = "query_id long, rank int, vec_id long, score long"
BLOCKS = "slice int, block int, longest double, vectors array<binary>, lengths array<double>, ids array<array<long>>"


def in_blocks(vectors: DataFrame, parts: int, size: int, name: str) -> DataFrame:
    """Blocks of vectors by descending length: partition 0 holds the longest."""
    order = [F.desc("length"), F.col("vector")]
    dealt = vectors.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order)
    return settle(dealt.select("vector", "length", "ids").mapInArrow(_block_maker(size), BLOCKS), name)


def _searcher(rotation: np.ndarray, k: int, seeds: bool):
    """A stream of groups of queries, each followed by blocks in descending length, to results.

    ``seeds``: one row a group, with the scores its queries reach and the least length of a
    vector that can matter to any of them.  Otherwise a row per query, vector and id.
    """
    width = len(rotation)

    def rotated(vectors: list[bytes], lengths: list[float]) -> Rotated:
        return Rotated(matrix(vectors, width), np.array(lengths, dtype=np.float64), rotation)

    def chunks(vectors: list[bytes], lengths: list[float], floors: list[float] | None) -> list[Search]:
        floors = floors or [-np.inf] * len(vectors)
        cuts = [slice(start, start + CHUNK) for start in range(0, len(vectors), CHUNK)]
        return [Search(rotated(vectors[c], lengths[c]), np.array(floors[c]), k) for c in cuts]

    def seeds_of(group: int, searches: list[Search]) -> pa.RecordBatch:
        floors = [float(s[-1]) if len(s) == k else -np.inf for search in searches for s in search.scores]
        lengths = [n for search in searches for n in search.queries.lengths.tolist()]
        need = min(f / n if n > 0 and f > 0 else 0.0 for f, n in zip(floors, lengths))
        columns = [pa.array([group], pa.int32()), pa.array([floors], pa.list_(pa.float64())), pa.array([need])]
        return pa.RecordBatch.from_arrays(columns, ["group", "floors", "least"])

    def results(own: list[bytes], searches: list[Search], kept: dict[int, tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found = ((s, p) for search in searches for s, p in zip(search.scores, search.places))
        for query, (scores, places) in zip(own, found):
            for score, place in zip(scores.tolist(), places.tolist()):
                vector, ids = kept[place]
                rows += [(query, score, i, vector == query) for i in ids]
        for start in range(0, len(rows), 8192):
            types = [pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows[start : start + 8192]), types)]
            yield pa.RecordBatch.from_arrays(columns, ["vector", "score", "vec_id", "same"])

    def finish(group: int, own: list[bytes], searches: list[Search], kept: dict) -> Iterator[pa.RecordBatch]:
        if seeds:
            yield seeds_of(group, searches)
        else:
            yield from results(own, searches, kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, searches, kept, place = None, [], [], {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["is_group"]:
                    if searches:
                        yield from finish(group, own, searches, kept)
                    group, own, kept, place = row["group"], row["vectors"], {}, 0
                    searches = chunks(own, row["lengths"], row["floors"])
                    continue
                block = rotated(row["vectors"], row["lengths"])
                # The ids of a vector are in order, null last.
                least = np.array([LONG.max if i[0] is None else i[0] for i in row["ids"]], dtype=np.int64)
                for search in searches:
                    search.feed(block, least, place)
                if not seeds:
                    needed = np.unique(np.concatenate([p for search in searches for p in search.places]))
                    here = {p: (row["vectors"][p - place], row["ids"][p - place]) for p in needed[needed >= place].tolist()}
                    kept = {p: kept[p] for p in needed[needed < place].tolist()} | here
                place += len(row["vectors"])
        if searches:
            yield from finish(group, own, searches, kept)

    return run


def _searched(groups: DataFrame, blocks: DataFrame, rotation: np.ndarray, k: int, seeds: bool) -> DataFrame:
    """Run the searcher over cells (group, slice): ``groups`` and ``blocks`` have both columns."""
    columns = ["group", "slice", "block", "is_group", "vectors", "lengths", "ids", "floors"]
    stream = groups.select(*columns).unionByName(blocks.select(*columns))
    dealt = stream.repartition("group", "slice").sortWithinPartitions("group", "slice", F.desc("is_group"), "block")
    schema = "group int, floors array<double>, least double" if seeds else "vector binary, score long, vec_id long, same boolean"
    return dealt.mapInArrow(_searcher(rotation, k, seeds), schema)


def _cells(groups: DataFrame, slices: list[tuple[int, float]]) -> DataFrame:
    """Every group once per slice that can matter to it (``least``: the shortest vector that can)."""
    known = F.array(*[F.struct(F.lit(s).alias("slice"), F.lit(n).alias("longest")) for s, n in slices])
    needed = F.filter(known, lambda s: s["longest"] * (1 + SLACK) >= F.col("least"))
    return groups.withColumn("slice", F.explode(F.transform(needed, lambda s: s["slice"])))


def top_inner_products(
    vectors: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0, column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best inner products of every query.

    Components become floor(``scale`` * x).  Queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows but the query's own; equal scores go to the smaller vec_id,
    null ids last.  Rows whose vector is null or holds a null or a number that is not finite
    take no part; shorter vectors are filled up with zeros, so empty ones score 0 with all.
    Repeated rows and ids count each: a query leaves out one row of its id and vector.  Scores
    beyond a long are clamped.  Other columns are ignored; an empty table gives no rows.
    """
    values = F.col(column).cast("array<double>").alias("values")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values)
    rows = settle(rows.mapInArrow(_parsed(scale), "vec_id long, vector binary, length double"), "vectors")
    # Of equal vectors the k + 1 smallest ids: Spark keeps no more than those of each before its shuffle.
    by_id = Window.partitionBy("vector").orderBy(F.asc_nulls_last("vec_id"))
    least_ids = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    in_place = F.sort_array(F.collect_list(F.struct("place", "vec_id")))
    ids = F.transform(in_place, lambda s: s["vec_id"])
    distinct = settle(least_ids.groupBy("vector", "length").agg(ids.alias("ids")), "distinct")
    size = distinct.agg(F.count("*").alias("n"), F.max(F.octet_length("vector")).alias("bytes")).first()
    count, width = size["n"], (size["bytes"] or 0) // VECTOR.itemsize
    if not count:
        return rows.sparkSession.createDataFrame([], RESULT)
    rotation = fit_rotation(distinct, width)

    per_slice = min(SLICE[1], max(SLICE[0], count // 64))
    blocks = in_blocks(distinct, min(SLICES, -(-count // per_slice)), BLOCK, "blocks")
    asked = rows.where(F.col("vec_id") % every == 0)
    own = asked.select("vector", "length").distinct().withColumn("ids", F.lit(None).cast("array<long>"))
    groups = in_blocks(own, -(-count // (GROUP * every)), GROUP, "queries")
    # A group's number: its partition and place in it.
    groups = groups.select((F.col("slice") * 65_536 + F.col("block")).alias("group"), "vectors", "lengths")
    groups = groups.withColumns({"block": F.lit(-1), "is_group": F.lit(True), "ids": F.lit(None).cast("array<array<long>>")})

    longest = blocks.groupBy("slice").agg(F.max("longest").alias("longest")).orderBy("slice").collect()
    slices = [(r["slice"], r["longest"]) for r in longest]
    candidates = blocks.withColumns({"is_group": F.lit(False), "floors": F.lit(None).cast("array<double>")})
    top = groups.withColumns({"slice": F.lit(slices[0][0]), "floors": F.lit(None).cast("array<double>")})
    first = candidates.where((F.col("slice") == slices[0][0]) & (F.col("block") < FIRST))
    by_block = top.select("group", F.explode(F.sequence(F.lit(0), F.lit(FIRST - 1))).alias("block"))
    seeds = _searched(top, first.join(by_block, "block"), rotation, k + 1, True)
    seeded = settle(seeds, "seeds")
    cells = _cells(groups.join(seeded, "group"), slices)
    pairs = candidates.join(_cells(seeded.select("group", "least"), slices).select("group", "slice"), "slice")
    found = _searched(cells, pairs, rotation, k + 1, False)
    best = Window.partitionBy("vector").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = ranked.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("found"))
    answers = asked.select(F.col("vec_id").alias("query_id"), "vector").join(lists, "vector")
    mine = F.filter("found", lambda r: r["same"] & (r["vec_id"] == F.col("query_id")))
    own_place = F.coalesce(F.get(F.transform(mine, lambda r: r["place"]), F.lit(0)), F.lit(k + 1))
    others = F.filter("found", lambda r: r["place"] != F.col("own"))
    out = answers.withColumn("own", own_place).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "row"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "row.vec_id", "row.score")
