"""Token counts by rank-synchronous merging over ragged arrays.

A piece model splits a text into characters and joins the pair of neighbours whose joint
piece has the best rank, leftmost first, until no pair forms a piece.  No piece has a space
mark after another character, and characters outside the vocabulary join nothing, so texts
fall into pre-tokens that merge independently.  The distinct unseen pre-tokens of a portion
of text are held as one ragged array of symbols; in every round each sequence applies its
lowest-rank pair, all at once, and what survives at the end is counted.

Counts of pre-tokens stay in a bounded cache of the Python worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import text_or_empty
from pitchframe.llm.token_files import in_portions

MARK = "▁"  # stands for a space
NO_RANK = np.int64(1) << 32  # above every score, and small enough to be multiplied by places
LONGEST = 64  # symbols; longer pre-tokens merge through a heap, one pair at a time
CACHE_WORDS = 600_000
PORTION = 1 << 20  # characters
STRETCH = 1 << 22  # characters of one text that are looked at together
TO_SPLIT = re.compile("[^\n]+|\n")
PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """Merge ranks of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        scores = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(model.get_piece_size())
            if not any(test(i) for test in special)
        }
        if sum(model.is_byte(i) for i in range(model.get_piece_size())) != 256:
            raise ValueError("the model has no byte fallback")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in scores) or any(c not in scores for p in scores for c in p):
            raise ValueError("pieces must begin with their space marks and be made of pieces")
        self.number = {p: n for n, p in enumerate(scores)}
        self.newline_known = any("\n" in p for p in scores)
        self.size = len(scores) + 1  # the last number stands for any unknown character
        pairs: dict[int, tuple[int, int]] = {}
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                left, right = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = (int(score), self.number[piece])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        self.pairs = pairs
        self.words: dict[str, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of every pair; NO_RANK where it forms none."""
        wanted = left.astype(np.int64) * self.size + right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        there = self.keys[place] == wanted
        return np.where(there, self.ranks[place], NO_RANK), self.merged[place]

    def surviving(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence of the ragged array (flat, lengths >= 1)."""
        left_over = lengths.copy()
        alive = np.arange(len(lengths))
        while len(alive):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            ranks = np.full(len(flat), NO_RANK)
            pieces = np.zeros(len(flat), dtype=np.int32)
            inner = np.ones(len(flat), dtype=bool)
            inner[starts + lengths - 1] = False
            at = np.flatnonzero(inner)
            ranks[at], pieces[at] = self.look_up(flat[at], flat[at + 1])
            # The place breaks ties of a rank: leftmost first.
            best = np.minimum.reduceat(ranks * len(flat) + np.arange(len(flat)), starts)
            merging = best < NO_RANK * len(flat)
            left_over[alive[~merging]] = lengths[~merging]
            place = best[merging] % len(flat)
            flat[place] = pieces[place]
            keep = np.repeat(merging, lengths)
            keep[place + 1] = False
            flat = flat[keep]
            alive, lengths = alive[merging], lengths[merging] - 1
        return left_over

    def surviving_long(self, symbols: list[int]) -> int:
        """Symbols left of one long sequence, merging in the same order with a heap."""
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (pair := self.pairs.get(symbols[i] * self.size + symbols[j])) is not None:
                heapq.heappush(heap, (pair[0], i, symbols[i], symbols[j], pair[1]))

        for i in range(len(symbols) - 1):
            offer(i)
        count = len(symbols)
        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else -1
            if j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = piece, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            count -= 1
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return count

    def learn(self, words: list[str]) -> None:
        """Add the counts of unseen pre-tokens to the cache."""
        unknown = self.size - 1
        number = self.number
        sequences = [[number.get(c, unknown) for c in w] for w in words]
        # An unknown character is one token for each of its bytes and merges with nothing.
        more = [
            sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in w if c not in number) if unknown in s else 0
            for w, s in zip(words, sequences)
        ]
        short = [n for n, s in enumerate(sequences) if len(s) <= LONGEST]
        counts = dict.fromkeys(words, 0)
        if short:
            lengths = np.array([len(sequences[n]) for n in short])
            flat = np.array([x for n in short for x in sequences[n]], dtype=np.int32)
            counts.update(zip((words[n] for n in short), self.surviving(flat, lengths).tolist()))
        for n, s in enumerate(sequences):
            if len(s) > LONGEST:
                counts[words[n]] = self.surviving_long(s)
        for word, extra in zip(words, more):
            counts[word] += extra
        self.words.update(counts)

    def pre_tokens(self, text: str, first: bool) -> list[str]:
        """``first``: the text is the start of its document and gets a space before it."""
        lead = MARK if first and text else ""
        text = lead + text.replace(" ", MARK)
        if self.newline_known:
            return PRE_TOKEN.findall(text)
        return [p for line in TO_SPLIT.findall(text) for p in PRE_TOKEN.findall(line)]

    def count(self, texts: list[tuple[str, bool]]) -> list[int]:
        split = [self.pre_tokens(text, first) for text, first in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        unseen = {p for parts in split for p in parts if p not in self.words}
        if unseen:
            self.learn(list(unseen))
        known = self.words
        return [sum([known[p] for p in parts]) for parts in split]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per Python worker."""
    return PieceModel(path)


def stretches(text: str, limit: int = STRETCH) -> Iterator[tuple[str, bool]]:
    """A text in pieces that end where a space follows another character."""
    start = 0
    while len(text) - start > limit:
        cut = start + limit
        while (cut := text.find(" ", cut)) > 0 and text[cut - 1] in (" ", MARK):
            cut += 1
        if cut < 0:
            break
        yield text[start:cut], start == 0
        start = cut
    yield text[start:], start == 0


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``).

    Whole texts are counted; a null text is empty and has no tokens.  Null or repeated
    doc_ids and repeated rows are counted each; other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in batches:
            ids, sizes, totals = batch.column("doc_id"), batch.column("n_bytes"), np.zeros(len(batch), dtype=np.int64)
            texts = ((n, t.as_py()) for n, t in enumerate(batch.column("text")))
            for portion in in_portions(texts, PORTION):
                parts = [(n, *s) for n, text in portion for s in stretches(text)]
                counts = own.count([(text, first) for _, text, first in parts])
                np.add.at(totals, [n for n, _, _ in parts], counts)
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
