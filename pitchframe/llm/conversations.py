"""Conversation structure repair: cheapest edits by dynamic programming, least audit by path ranking.

A conversation is in order when its role initials read ``(s?(ua)+)?``.  Edits keep, re-role or
delete rows and insert empty turns; every edit has a letter (D, I, K, R) and the letters of a
repair are its audit.  Of the cheapest repairs the one with the ASCII-least audit is taken:

1. *Cost.*  What a row costs from each of four states to each of four states is a matrix in
   (min, +).  Products over all rows to come, by doubling, give every node (row, state) its
   cost to the end.
2. *Ranks.*  Nodes are joined by those edits that keep the cost optimal.  Their least audits
   of one letter are ranked, then of 2, 4, 8 ... letters: a node's rank and the least rank
   among the nodes at the end of its doubled pointers rank twice the length.  Pointers to
   anything but the least rank fall away, so what is left at the end is the least path.

Rows are dealt in ordered blocks, so a conversation of any length is never whole in one task
here: blocks yield their matrix, the matrices of a conversation give each block its costs at
the end, and blocks then rank their own nodes for each state they can be entered in.  The
repaired text of a conversation is hashed as a stream, row by row; SHA-256 leaves no other
way, but it needs no more memory than one batch and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import WORD, settle

BLOCK_BITS = 14  # a block holds the rows of a conversation among 2^14 consecutive places
PORTION = 1 << 15  # rows that are ranked together

# States: nothing yet, system turn, user turn, assistant turn.  Where a turn of each role leads.
START, SYSTEM, USER, ASSISTANT = range(4)
DEAD = -1
STEP = {
    "s": [SYSTEM, DEAD, DEAD, DEAD],
    "u": [USER, USER, DEAD, USER],
    "a": [DEAD, DEAD, ASSISTANT, DEAD],
    "": [DEAD] * 4,
}
INITIALS = ["s", "u", "a", ""]
OK, MUST_GO, TRUNCATED = range(3)
DELETE_COST, INSERT_COST, REROLE_COST, CUT_COST = 2, 5, 1, 5
LETTERS = "DIKR"  # in ASCII order; a letter's rank is its place from 1, and 0 is the end
FAR = np.int64(1) << 40

ROLE_OF_STATE = {START: ("u", "user"), SYSTEM: ("u", "user"), USER: ("a", "assistant"), ASSISTANT: ("u", "user")}


def _insert_costs() -> np.ndarray:
    """Least cost of inserted turns alone from state to state."""
    costs = np.full((4, 4), FAR)
    for state in range(4):
        costs[state, state], at = 0, state
        for turns in (1, 2):
            at = STEP[ROLE_OF_STATE[at][0]][at]
            costs[state, at] = min(costs[state, at], turns * INSERT_COST)
    return costs


def min_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of stacks of matrices in (min, +)."""
    return reduce(np.minimum, [left[..., :, k, None] + right[..., None, k, :] for k in range(left.shape[-1])])


INSERTS = _insert_costs()
# Cost to the end once no row is left: user and assistant turns may still be inserted.
AT_END = np.minimum(INSERTS[:, START], INSERTS[:, ASSISTANT])
TAIL = ["" if AT_END[state] == 0 else "I" * int(AT_END[state] // INSERT_COST) for state in range(4)]


def row_arcs(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(letter, from, to, cost) of the edits that use up a row."""
    arcs = [(0, state, state, DELETE_COST) for state in range(4)]
    if fault != MUST_GO:
        extra = CUT_COST if fault == TRUNCATED else 0
        arcs += [(2, q, STEP[initial][q], extra) for q in range(4)]
        arcs += [(3, q, STEP[role][q], extra + REROLE_COST) for role in ("u", "a") for q in range(4)]
    return [arc for arc in arcs if arc[2] != DEAD]


# By code, 3 * place of the initial + fault.
ARCS = [row_arcs(initial, fault) for initial in INITIALS for fault in (OK, MUST_GO, TRUNCATED)]


def _row_matrix(arcs: list[tuple[int, int, int, int]]) -> np.ndarray:
    matrix = np.full((4, 4), FAR)
    for _, start, end, cost in arcs:
        matrix[start, end] = min(matrix[start, end], cost)
    return min_plus(INSERTS, matrix)


ROW_MATRICES = np.array([_row_matrix(arcs) for arcs in ARCS])


def products_to_end(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For every row of the ragged array (codes, lengths >= 1), the product of its and all later matrices."""
    products = ROW_MATRICES[codes]
    left = np.concatenate([np.arange(n, 0, -1) for n in lengths]) if len(lengths) else np.zeros(0, dtype=int)
    step, longest = 1, int(lengths.max(initial=0))
    while step < longest:
        at = np.flatnonzero(left > step)
        # The right side is read whole before anything is replaced.
        products[at] = min_plus(products[at], products[at + step])
        step *= 2
    return products


def dense_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    both = first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second
    return np.unique(both, return_inverse=True)[1]


def spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places ``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, for each i in turn."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def least_paths(arcs: tuple[np.ndarray, np.ndarray, np.ndarray], nodes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Doubled pointers along every node's least path, and every node's first letter (0: the end).

    ``arcs`` are the optimal (source, letter, target).  ``pointers[k][v]`` is the node that
    2^k letters of the least audit from ``v`` lead to; the end leads to itself.
    """
    source, letter, target = arcs
    ends = np.setdiff1d(np.arange(nodes), source)
    source, letter, target = (
        np.concatenate(parts) for parts in ((source, ends), (letter, np.zeros_like(ends)), (target, ends))
    )
    order = np.lexsort((target, letter, source))
    source, letter, target = source[order], letter[order], target[order]
    firsts = np.searchsorted(source, np.arange(nodes))
    rank = np.minimum.reduceat(letter, firsts) if nodes else np.zeros(0, dtype=np.int64)
    kept = letter == rank[source]
    first_letter, rank = rank, np.unique(rank, return_inverse=True)[1]
    source, target = source[kept], target[kept]
    done = np.zeros(nodes, dtype=bool)
    done[ends] = True
    pointers: list[np.ndarray] = []
    while True:
        # Among the ends of the audits that are least so far, those that go on least stay.
        firsts = np.searchsorted(source, np.arange(nodes))
        best = np.minimum.reduceat(rank[target], firsts) if nodes else rank
        kept = rank[target] == best[source]
        source, target = source[kept], target[kept]
        firsts = np.searchsorted(source, np.arange(nodes))
        pointers.append(target[firsts])
        if done[pointers[-1]].all():
            return pointers, first_letter
        rank = dense_ranks(rank, best)
        counts = np.diff(np.append(firsts, len(source)))
        through = spread(counts[target], firsts[target])
        pairs = np.unique(np.repeat(source, counts[target]) * nodes + target[through])
        source, target = pairs // nodes, pairs % nodes


def walk(pointers: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """The nodes on the paths from ``starts``: a row each, 2^len(pointers) nodes a row."""
    paths = starts[:, None]
    for pointer in reversed(pointers):
        paths = np.stack([paths, pointer[paths]], axis=2).reshape(len(starts), -1)
    return paths


def audits(codes: np.ndarray, lengths: np.ndarray, at_end: np.ndarray) -> list[tuple[list[int], list[str]]]:
    """For every sequence and state it is entered in: the state it is left in and the least audit.

    ``at_end`` holds the costs to the end, by state, behind each sequence.  Inserts behind
    the last row belong to what follows.
    """
    sequences = len(lengths)
    products = products_to_end(codes, lengths)
    costs = (products + np.repeat(at_end, lengths, axis=0)[:, None, :]).min(axis=2)
    starts = np.cumsum(lengths) - lengths
    # Nodes: (row, state) of every sequence, and (end, state) behind its rows.
    level = np.arange(len(codes)) + np.repeat(np.arange(sequences), lengths)
    end_level = starts + lengths + np.arange(sequences)
    to_go = np.empty((len(codes) + sequences, 4), dtype=np.int64)
    to_go[level], to_go[end_level] = costs, at_end
    found = []

    def offer(rows: np.ndarray, letter: int, q: int, to_level: np.ndarray, to: int, cost: int) -> None:
        good = to_go[level[rows], q] == cost + to_go[to_level, to]
        at = level[rows][good]
        found.append((at * 4 + q, np.full(len(at), letter + 1), to_level[good] * 4 + to))

    for code in np.unique(codes):
        rows = np.flatnonzero(codes == code)
        for letter, q, to, cost in ARCS[code]:
            offer(rows, letter, q, level[rows] + 1, to, cost)
    rows = np.arange(len(codes))
    for q in range(4):
        for role in ("u", "a"):
            if STEP[role][q] != DEAD:
                offer(rows, 1, q, level, STEP[role][q], INSERT_COST)
    arcs = tuple(np.concatenate(parts) for parts in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3
    pointers, letters = least_paths(arcs, 4 * len(to_go))
    tops = ((starts + np.arange(sequences))[:, None] * 4 + np.arange(4)).ravel()
    left_in = pointers[-1][tops] % 4 if pointers else tops % 4
    chars = np.frombuffer(("\0" + LETTERS).encode(), dtype=np.uint8)
    texts: list[str] = []
    # Short sequences by the thousand, long ones by themselves: paths are as wide as 2^len(pointers).
    width = 1 << len(pointers)
    for first in range(0, len(tops), max(1, (1 << 22) // width)):
        paths = walk(pointers, tops[first : first + max(1, (1 << 22) // width)])
        texts += [row.tobytes().rstrip(b"\0").decode() for row in chars[letters[paths]]]
    return [(left_in[4 * i : 4 * i + 4].tolist(), texts[4 * i : 4 * i + 4]) for i in range(sequences)]


# Rows


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, gone) of all rows after the damage of the exercise.

    By crc32(``conv_id:turn``) modulo 20: 0 drops the row (``gone``), 1 empties the text, 2
    removes its ``[.!?]``, 3 repeats the row, 4 sets the role to user.  A null counts as one
    space.  ``digest`` tells (role, text) pairs apart.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    out = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return out.withColumn("digest", text_digest(F.col("role"), F.col("text"))).drop("copy")


def text_digest(role: Column, text: Column) -> Column:
    """256 bits of a (role, text) pair; the role's length keeps ("a", "bc") and ("ab", "c") apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, code, gone): rows in order without their texts, settled by place.

    Order within a conversation: turn, nulls first, then role, then SHA-256 of role and text;
    rows that are equal in all of it are equal.  The salt lets a range partition cut even
    between equal rows.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    blank = ~F.rlike("text", F.lit(WORD))
    slim = rows.select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "gone",
        blank.alias("blank"),
        (~F.rlike(last, F.lit(r"[.!?]"))).alias("cut"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("salt")]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(placed.drop("salt").withColumn("place", F.monotonically_increasing_id()), "placed")
    firsts = placed.where("not gone").groupBy("conv_id", "digest").agg(F.min("place").alias("place"))
    marked = placed.join(firsts.select("place", F.lit(True).alias("first")), "place", "left")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), 3).when(F.col("first").isNull(), 1).when(F.col("cut"), 2).otherwise(0)
    return marked.select("conv_id", "place", "turn", "gone", (kind * 4 + fault).alias("code"))


# Codes of ``symbols``: 4 * place of the initial + fault, where blank (3) and duplicate (1) both must go.
FAULT = np.array([OK, MUST_GO, TRUNCATED, MUST_GO])

BLOCKS = (
    "conv_id long, block long, codes binary, matrix array<long>, first int, last int, first_turn long, last_turn long, "
    "turns long, blank long, duplicate long, truncated long, illegal long"
)
LEGAL = {(0, 1), (1, 2), (2, 1)}  # places of initials that may follow each other: su, ua, au


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.fill_null(0).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy(zero_copy_only=False)


def block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row a block: codes, matrix, faults, and what its neighbours need to know."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        held = table
        if len(table) < PORTION:
            continue
        flat = table.combine_chunks().to_batches()[0]
        key = _block_key(flat)
        last = int(np.flatnonzero(np.any(key != key[-1], axis=1)).max(initial=-1)) + 1
        if last:
            yield _blocks_of(flat.slice(0, last))
            held = pa.Table.from_batches([flat.slice(last)])
    if held is not None and len(held):
        yield _blocks_of(held.combine_chunks().to_batches()[0])


def _block_key(flat: pa.RecordBatch) -> np.ndarray:
    null = flat.column("conv_id").is_null().to_numpy(zero_copy_only=False)
    return np.stack([null.astype(np.int64), _flat(flat, "conv_id"), _flat(flat, "block")], axis=1)


def _blocks_of(flat: pa.RecordBatch) -> pa.RecordBatch:
    key = _block_key(flat)
    new = np.ones(len(key), dtype=bool)
    new[1:] = np.any(key[1:] != key[:-1], axis=1)
    head = np.flatnonzero(new)
    block_no = np.cumsum(new) - 1
    here = ~_flat(flat, "gone").astype(bool)
    code, block_of = _flat(flat, "code")[here], block_no[here]
    blocks = len(head)
    lengths = np.bincount(block_of, minlength=blocks)
    initial, fault = code // 4, code % 4
    codes = (3 * initial + FAULT[fault]).astype(np.uint8)
    filled = np.flatnonzero(lengths)
    products = products_to_end(codes, lengths[filled])
    starts = np.cumsum(lengths) - lengths
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    matrix = np.tile(unit, (blocks, 1, 1))
    matrix[filled] = products[starts[filled]]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(block_of, weights=mask, minlength=blocks).astype(np.int64)

    ends = np.zeros((2, blocks), dtype=np.int64)
    ends[0, filled], ends[1, filled] = initial[starts[filled]], initial[(starts + lengths)[filled] - 1]
    inner = block_of[1:] == block_of[:-1]
    legal = np.zeros((4, 4), dtype=bool)
    for pair in LEGAL:
        legal[pair] = True
    wrong = np.zeros(len(code), dtype=bool)
    wrong[1:] = inner & ~legal[initial[:-1], initial[1:]]
    # Turns are in order, nulls first, so a block's first and last turns are its least and greatest.
    turn, known = _flat(flat, "turn")[here], flat.column("turn").is_valid().to_numpy(zero_copy_only=False)[here]
    turn, turn_block = turn[known], block_of[known]
    with_turn = np.bincount(turn_block, minlength=blocks)
    turn_ends = np.cumsum(with_turn)
    changed = np.ones(len(turn), dtype=bool)
    changed[1:] = (turn[1:] != turn[:-1]) | (turn_block[1:] != turn_block[:-1])
    turns = np.bincount(turn_block, weights=changed, minlength=blocks).astype(np.int64)
    some = np.flatnonzero(with_turn)
    turn_range = np.zeros((2, blocks), dtype=np.int64)
    turn_range[0, some], turn_range[1, some] = turn[(turn_ends - with_turn)[some]], turn[turn_ends[some] - 1]
    raw, bounds = codes.tobytes(), np.append(starts, len(codes)).tolist()
    none, no_turn = lengths == 0, with_turn == 0
    columns = [
        flat.column("conv_id").take(pa.array(head)),
        flat.column("block").take(pa.array(head)),
        pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
        pa.array(list(matrix.reshape(blocks, 16)), pa.list_(pa.int64())),
        *[pa.array(e.astype(np.int32), mask=none) for e in ends],
        *[pa.array(t, mask=no_turn) for t in turn_range],
        pa.array(turns),
        *[pa.array(count(mask)) for mask in (fault == 3, fault == 1, fault == 2, wrong)],
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCKS.split(", ")])


def ends_of(matrices: list[list[int]]) -> list[list[int]]:
    """Costs to the end behind every block of a conversation, from the blocks' matrices in order."""
    costs, behind = AT_END, []
    for matrix in reversed(matrices):
        behind.append(costs.tolist())
        costs = (np.array(matrix).reshape(4, 4) + costs).min(axis=1)
    return behind[::-1]


def _with_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation: what is known of it, its cost and the costs behind each block."""
    for batch in batches:
        ends, costs, gaps, illegal = [], [], [], []
        for blocks in batch.column("blocks"):
            blocks = blocks.as_py()
            ends.append(ends_of([b["matrix"] for b in blocks]))
            first = np.array(blocks[0]["matrix"]).reshape(4, 4) + np.array(ends[-1][0])
            costs.append(int(first.min(axis=1)[START]))
            full = [b for b in blocks if b["first"] is not None]
            wrong = sum((a["last"], b["first"]) not in LEGAL for a, b in zip(full, full[1:]))
            illegal.append(wrong + sum(b["illegal"] for b in blocks))
            timed = [b for b in blocks if b["first_turn"] is not None]
            shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
            distinct = sum(b["turns"] for b in timed) - shared
            gaps.append(timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0)
        columns = [batch.column(c) for c in ("conv_id", "blank", "duplicate", "truncated")]
        numbers = [pa.array(n, pa.int64()) for n in (gaps, illegal, costs)]
        names = ["conv_id", "blank", "duplicate", "truncated", "gaps", "illegal", "cost", "block_nos", "ends"]
        numbered = pa.array([[b["block"] for b in blocks.as_py()] for blocks in batch.column("blocks")], pa.list_(pa.int64()))
        ends_column = pa.array(ends, pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([*columns, *numbers, numbered, ends_column], names)


def _ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block's (state it is left in, audit) by the state it is entered in."""
    for batch in batches:
        raw = [c.as_py() for c in batch.column("codes")]
        ends = np.array(batch.column("at_end").to_pylist(), dtype=np.int64).reshape(len(raw), 4)
        done: list[tuple[list[int], list[str]]] = [([0, 1, 2, 3], [""] * 4)] * len(raw)
        # Blocks of a like length together: paths are as wide as the longest of them.
        order = [i for i in sorted(range(len(raw)), key=lambda i: len(raw[i])) if raw[i]]
        while order:
            part, size = [], 0
            while order and (not part or (size + len(raw[order[0]]) <= PORTION and len(raw[order[0]]) <= 2 * len(raw[part[0]]))):
                part.append(order.pop(0))
                size += len(raw[part[-1]])
            lengths = np.array([len(raw[i]) for i in part])
            codes = np.frombuffer(b"".join(raw[i] for i in part), dtype=np.uint8).astype(np.int64)
            for i, result in zip(part, audits(codes, lengths, ends[part])):
                done[i] = result
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("block"),
                pa.array([d[0] for d in done], pa.list_(pa.int32())),
                pa.array([d[1] for d in done], pa.list_(pa.string())),
            ],
            ["conv_id", "block", "left_in", "audits"],
        )


SUMMARY = "conv_id long, blank long, duplicate long, truncated long, gaps long, illegal long, cost long"


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    ``rows`` are those of ``damaged``.  A conversation has a block for every 2^14 rows or so,
    and an audit letter a row, so what is gathered here is shorter than the audit it returns.
    """
    block = F.shiftright("place", BLOCK_BITS).alias("block")
    placed = symbols(rows).select("conv_id", block, "place", "turn", "gone", "code")
    dealt = placed.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    blocks = settle(dealt.mapInArrow(block_rows, BLOCKS), "blocks")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    parts = F.struct("block", "matrix", "first", "last", "first_turn", "last_turn", "turns", "illegal")
    # The sum of a block's counts goes along as ``illegal``; blocks in order of their places.
    whole = blocks.groupBy("conv_id").agg(*sums, F.sort_array(F.collect_list(parts)).alias("blocks"))
    summed = settle(whole.mapInArrow(_with_ends, f"{SUMMARY}, block_nos array<long>, ends array<array<long>>"), "costs")
    behind = summed.select(
        "conv_id", F.inline(F.arrays_zip(F.col("block_nos").alias("block"), F.col("ends").alias("at_end")))
    )
    own = [F.col("conv_id").eqNullSafe(F.col("_conv")), F.col("block") == F.col("_block")]
    ranked = (
        blocks.select("conv_id", "block", "codes")
        .join(behind.toDF("_conv", "_block", "at_end"), own)
        .select("conv_id", "block", "codes", "at_end")
        .mapInArrow(_ranked, "conv_id long, block long, left_in array<int>, audits array<string>")
    )
    steps = F.sort_array(F.collect_list(F.struct("block", "left_in", "audits")))
    begin = F.struct(F.lit(START).alias("state"), F.array().cast("array<string>").alias("parts"))

    def follow(found: Column, step: Column) -> Column:
        at = found["state"] + 1
        return F.struct(
            F.element_at(step["left_in"], at).alias("state"),
            F.concat(found["parts"], F.array(F.element_at(step["audits"], at))).alias("parts"),
        )

    joined = ranked.groupBy(F.col("conv_id").alias("_conv")).agg(F.aggregate(steps, begin, follow).alias("path"))
    tail = F.element_at(F.array(*[F.lit(t) for t in TAIL]), F.col("path.state") + 1)
    audit = F.concat(F.array_join("path.parts", ""), tail).alias("audit")
    return summed.join(joined, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit
    )


class Repair:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _add(self, initial: str) -> None:
        self.state = STEP[initial][self.state]

    def inserted(self) -> list[str]:
        """The turns that are inserted here, as ``role:``."""
        turns = []
        while self.audit[self.at : self.at + 1] == "I":
            initial, role = ROLE_OF_STATE[self.state]
            turns.append(f"{role}:")
            self._add(initial)
            self.at += 1
        return turns

    def row(self, role: str, text: str) -> list[str]:
        """The turns that stand for the next row, with those inserted before it."""
        turns = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            turns.append(f"{role}:{text}")
            self._add(role[0])
        elif edit == "R":
            initial, new_role = ROLE_OF_STATE[self.state]
            turns.append(f"{new_role}:{text}")
            self._add(initial)
        return turns


DIGEST_COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of conversations, each a row with its audit and then its rows in order, to one row each."""
    names = [f.split()[0] for f in DIGEST_COLUMNS.split(", ")]
    done: list[list] = []
    head, repair, digest, any_turn = None, None, None, False

    def add(turns: list[str]) -> None:
        nonlocal any_turn
        for turn in turns:
            digest.update((("\n" if any_turn else "") + turn).encode("utf-8", "surrogatepass"))
            any_turn = True

    def close() -> None:
        if head is not None:
            add(repair.inserted())
            done.append([*head, digest.hexdigest()])

    def out() -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()] * 2
        columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *names, "repaired_sha256"])

    for batch in batches:
        ids, heads = batch.column("conv_id").to_pylist(), batch.column("head").to_pylist()
        roles, texts = batch.column("role"), batch.column("text")
        for i, found in enumerate(heads):
            if found is not None:
                close()
                head = [ids[i], *[found[n] for n in names]]
                repair, digest, any_turn = Repair(found["audit"]), hashlib.sha256(), False
            else:
                add(repair.row(roles[i].as_py(), texts[i].as_py()))
        if len(done) >= 4096:
            yield out()
    close()
    if done:
        yield out()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text): faults, cost, audit and repaired digest.

    A null conv_id is a conversation of its own; null turns come first and count in no gap;
    null roles and texts are one space.  Rows of one turn follow by role, then by SHA-256 of
    role and text.  A conversation without rows after the damage has zeros, an empty audit and
    the digest of nothing; an empty table gives no rows.  Other columns are ignored.
    """
    # Only what stays after the damage is hashed; the rows that are gone still name their conversation.
    broken = damaged(rows)
    found = repairs(broken)
    head = F.struct(*[f.split()[0] for f in DIGEST_COLUMNS.split(", ")])
    none = F.lit(None)
    heads = found.select(
        "conv_id",
        none.cast("long").alias("turn"),
        none.cast("string").alias("role"),
        none.cast("string").alias("text"),
        none.cast("binary").alias("digest"),
        head.alias("head"),
    )
    texts = broken.where("not gone").select("conv_id", "turn", "role", "text", "digest", none.cast(found.select(head).schema[0].dataType).alias("head"))
    order = ["conv_id", F.col("head").isNull(), F.asc_nulls_first("turn"), "role", "digest"]
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
    return stream.mapInArrow(_hashed, f"conv_id long, {DIGEST_COLUMNS}, repaired_sha256 string")
