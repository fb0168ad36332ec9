"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The items are indexed, and every passage of the training texts is a query: windows of words,
half overlapping, wide enough that an item's copy lies whole in one.  A posting's impact is
its BM25 score as a share of the item's score against itself, so one threshold serves all
items; where the copies that step 3 admits can lose more than that, the item's impacts are
raised, so that none of them is missed.  Per passage:

1. The items are cut into ranges with a maximum per term; only ranges that the passage's
   different terms can lift to the threshold are looked at, all windows of a text at once.
2. Block-max WAND walks their posting lists and retrieves every item above the threshold.
3. The passage must hold the item's question and its answer: the given share of the item's
   words in their order, counted by the fewest words changed, added or left out in either
   part (``edits_of``, ``allowed``), or the share of the five-word shingles of both, in any
   order.

Items are taken in shards of bounded size; each shard is one pass over the texts with a
broadcast index, so any number of items works.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import settle, text_or_empty

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of an item's score against itself
RANGES = 64  # of items, with a common maximum per term
OVERLAP = 0.8
WORDS = 5
SHARD_WORDS = 1_000_000  # of items in one broadcast index
BLOCK = 64  # postings with a common maximum
NARROWEST = 64  # words of an item up to which windows have 128
STRETCH = 1 << 20  # characters of a text looked at together
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = r"[.?!]\s+(?=[^.?!]*[.?!]?\s*$)"
TELLING = 4  # words from which a part has to be there by itself
FOUND = (
    "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, at_word long, in_order double"
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: Column) -> tuple[Column, Column]:
    """A text's last sentence is its answer, all before it the question; of a single sentence it is both."""
    parts = F.split(text, SENTENCE_END, 2)
    return parts[0], F.element_at(parts, -1)


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    width = min(WORDS, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def overlap(part: set[tuple[str, ...]], passage: list[str]) -> float:
    """Share of a part's shingles in the passage; nothing is asked of an empty part."""
    if not part:
        return 1.0
    width = len(next(iter(part)))
    there = {tuple(passage[i : i + width]) for i in range(len(passage) - width + 1)}
    return len(part & there) / len(part)


def edits_of(part: list[str], passage: list[str]) -> int:
    """Fewest words to change, add or leave out to make ``part`` of some stretch of ``passage``.

    Myers' bit vectors, a bit for each word of the part.
    """
    if not part:
        return 0
    masks: dict[str, int] = defaultdict(int)
    for n, word in enumerate(part):
        masks[word] |= 1 << n
    every, last = (1 << len(part)) - 1, 1 << len(part) - 1
    up, down, edits = every, 0, len(part)
    fewest = edits
    for word in passage:
        same = masks.get(word, 0)
        across = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(across | up) & every, up & across
        edits += bool(more & last) - bool(less & last)
        more, less = more << 1, less << 1
        up = (less | ~(same | down | more)) & every
        down = more & (same | down)
        fewest = min(fewest, edits)
    return fewest


def allowed(n_words: int, least: float) -> int:
    """Edits that a part may have by itself: the share, or up to three of its words but half of them at
    most; a part of a few words tells nothing by itself and counts only in the edits of the whole item."""
    if n_words < TELLING:
        return n_words
    return max(int((1 - least) * n_words + 1e-9), min(3, n_words // 2))


class ItemIndex:
    """Inverted index with block maxima of items of one length class."""

    def __init__(
        self, items: list[tuple[int, str, str]], idf: dict[str, float], mean_words: float, window: int, least: float = OVERLAP
    ):
        self.window, self.least = window, least
        self.margin = 0  # words that an admitted copy may reach beyond a window
        self.words, self.lifted = [], []
        self.ids = [i for i, _, _ in items]
        self.parts = []
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for place, (_, question, answer) in enumerate(items):
            q, a = words_of(question), words_of(answer)
            self.parts.append((shingles(q), shingles(a)))
            counts = Counter(q if question == answer else q + a)
            norm = K1 * (1 - B + B * sum(counts.values()) / mean_words)
            scores = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in counts.items()}
            whole = sum(scores.values())
            n_words = sum(counts.values())
            edits = int((1 - least) * n_words + 1e-9)
            self.margin = max(self.margin, edits)
            # An edit loses one word, a term goes when all of its words do: the costliest loss.
            lost, left = 0.0, edits
            for term in sorted(counts, key=lambda t: -scores[t] / counts[t]):
                lost += scores[term] * min(1.0, left / counts[term])
                left -= min(left, counts[term])
            lift = max(1.0, THRESHOLD / (1 - lost / whole)) if lost < whole else 1.0
            self.words.append((q, [] if question == answer else a, edits))
            self.lifted.append(lift)
            for term, score in scores.items():
                lists[term].append((place, lift * score / whole))
        self.number = {t: n for n, t in enumerate(lists)}
        self.postings = [([p for p, _ in own], [s for _, s in own]) for own in lists.values()]
        self.most = np.array([max(s) for _, s in self.postings])
        self.blocks = [[max(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] for _, s in self.postings]
        self.cuts = np.unique(np.linspace(0, len(items), RANGES + 1).astype(int))
        self.range_most = np.zeros((len(self.postings), len(self.cuts) - 1), dtype=np.float32)
        for term, (places, scores) in enumerate(self.postings):
            which = np.searchsorted(self.cuts, places, side="right") - 1
            np.maximum.at(self.range_most[term], which, scores)

    def live_ranges(self, terms: np.ndarray, n_words: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """(start, distinct terms, ranges they can lift to the threshold) of each window that has any.

        ``terms`` numbers a text's words, -1 for those of no item.
        """
        step = self.window // 2
        windows = max(1, -(-(n_words - step) // step))
        known = np.flatnonzero(terms >= 0)
        half, term = known // step, terms[known]
        # A half lies in the window that starts with it and in the one before.
        window = np.concatenate([half, half - 1])
        inside = (window >= 0) & (window < windows)
        width = len(self.postings)
        pairs = np.unique((window * width + np.concatenate([term, term]))[inside])
        if not len(pairs):
            return
        window, term = pairs // width, pairs % width
        first = np.flatnonzero(np.diff(window, prepend=-1))
        # A little room for rounding.
        live = np.add.reduceat(self.range_most[term], first) >= THRESHOLD - 1e-4
        stops = np.append(first[1:], len(pairs))
        for n in np.flatnonzero(live.any(axis=1)).tolist():
            own = term[first[n] : stops[n]].tolist()
            yield int(window[first[n]]) * step, own, np.flatnonzero(live[n]).tolist()

    def retrieve(self, terms: list[int], threshold: float, ranges: list[int] | None = None) -> list[tuple[int, float]]:
        """(place, score) of every item, or of those in ``ranges``, that the distinct ``terms``
        score at the threshold or above."""
        ranges = range(len(self.cuts) - 1) if ranges is None else ranges
        return [hit for r in ranges for hit in self._walk(terms, threshold, int(self.cuts[r]), int(self.cuts[r + 1]))]

    def _walk(self, terms: list[int], threshold: float, first: int, end: int) -> list[tuple[int, float]]:
        """Block-max WAND over the items from ``first`` to before ``end``."""
        cursors = []  # (item, term, place in its list)
        for term in terms:
            items = self.postings[term][0]
            place = bisect_left(items, first)
            if place < len(items) and items[place] < end:
                cursors.append([items[place], term, place])
        found = []

        def advance(cursor: list, target: int) -> None:
            items = self.postings[cursor[1]][0]
            cursor[2] = bisect_left(items, target, cursor[2])
            cursor[0] = min(items[cursor[2]], end) if cursor[2] < len(items) else end

        while True:
            cursors.sort()
            reach, pivot = 0.0, None
            for n, (item, term, _) in enumerate(cursors):
                if item == end:
                    break
                reach += self.most[term]
                if reach >= threshold:
                    pivot = n
                    break
            if pivot is None:
                return found
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            upper, next_block = 0.0, end
            for cursor in cursors[: pivot + 1]:
                items = self.postings[cursor[1]][0]
                block = bisect_left(items, target, cursor[2]) // BLOCK
                if block < len(self.blocks[cursor[1]]):
                    upper += self.blocks[cursor[1]][block]
                    after = (block + 1) * BLOCK
                    next_block = min(next_block, items[after]) if after < len(items) else next_block
            if upper < threshold:
                # No item before the next block of any of these lists can reach it.
                beyond = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                target = max(target + 1, min(next_block, beyond))
            else:
                score = 0.0
                for cursor in cursors[: pivot + 1]:
                    advance(cursor, target)
                    if cursor[0] == target:
                        score += self.postings[cursor[1]][1][cursor[2]]
                if score >= threshold:
                    found.append((target, score))
                target += 1
            for cursor in cursors[: pivot + 1]:
                if cursor[0] < target:
                    advance(cursor, target)

    def in_order(self, place: int, passage: list[str]) -> float:
        """Share of an item's words in the passage in their order; 0 if it has more edits than it may."""
        question, answer, most = self.words[place]
        here = edits_of(question, passage)
        if here > min(most, allowed(len(question), self.least)):
            return 0.0
        there = edits_of(answer, passage)
        if here + there > most or there > allowed(len(answer), self.least):
            return 0.0
        return 1 - (here + there) / (len(question) + len(answer))

    def search(self, words: list[str], first: int) -> Iterator[tuple[int, float, float, float, int, float]]:
        """(item_id, score, question overlap, answer overlap, at word, in order) for the passages of ``words``."""
        get = self.number.get
        terms = np.array([get(w, -1) for w in words], dtype=np.int64)
        for start, distinct, ranges in self.live_ranges(terms, len(words)):
            passage = words[start : start + self.window]
            # An edited copy may be longer than its item.
            wider = words[max(0, start - self.margin) : start + self.window + self.margin]
            for place, score in self.retrieve(distinct, THRESHOLD - 1e-9, ranges):
                question, answer = (overlap(part, passage) for part in self.parts[place])
                share = self.in_order(place, wider)
                yield self.ids[place], score / self.lifted[place], question, answer, first + start, share


def window_of(n_words: int) -> int:
    """Twice the length class of an item: with steps of half a window it lies whole in one."""
    return 2 * max(NARROWEST, 1 << max(0, n_words - 1).bit_length())


def stretches(text: str) -> Iterator[str]:
    """The text in parts that end at a space."""
    start = 0
    while len(text) - start > STRETCH and (cut := text.find(" ", start + STRETCH)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


def finds_of(index: ItemIndex, text: str) -> Iterator[tuple[int, float, float, float, int, float]]:
    """All finds in a text; from stretch to stretch the last window and half a one before are carried over."""
    words: list[str] = []
    first, step = 0, index.window // 2
    for stretch in stretches(text):
        words += words_of(stretch)
        yield from index.search(words, first)
        done = max(0, (len(words) - index.window) // step - 1) * step
        words, first = words[done:], first + done


def passages_of(index: ItemIndex, text: str) -> Iterator[tuple[int, float, float, float, int]]:
    """The finds without their share in order."""
    return (find[:5] for find in finds_of(index, text))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, shard_words) of the distinct terms of every item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, t, n)
                for i, q, a in zip(*[batch.column(k).to_pylist() for k in ("item_id", "question", "answer")])
                for n in [len(words_of(q)) + (len(words_of(a)) if a != q else 0)]
                for t in sorted(set(words_of(q) + words_of(a)))
            ]
            columns = zip(*rows) if rows else ((), (), ())
            types = (pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "term", "n_words"])

    return items.mapInArrow(run, "item_id long, term string, n_words long")


def contaminated(docs: DataFrame, items: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, at_word, in_order): items that a text holds.

    The overlaps are shares of shingles, ``in_order`` the share of the item's words in their
    order (0 if there are too many edits); either can hold the item.  A question without its
    answer is no item, unless the answer has less than ``TELLING`` words.


    ``items`` is (item_id, question, answer); equal ones stand for a text that is not cut.
    Case, punctuation and white space do not count.  One row for a document and item, the
    best passage; ``at_word`` is the passage's first word.  Items without words, null texts
    and empty texts match nothing; null or repeated doc_ids are searched each, and give one
    row for each doc_id and item.  Repeated item_ids are items of their own, reported as one.
    Other columns are ignored; no items or no documents give no rows.
    """
    spark = docs.sparkSession
    items = settle(
        items.select(
            F.col("item_id").cast("long").alias("item_id"),
            text_or_empty("question").alias("question"),
            text_or_empty("answer").alias("answer"),
        ),
        "items",
    )
    terms = settle(item_terms(items), "item-terms")
    by_item = terms.groupBy("item_id").agg(F.max("n_words").alias("n_words"))
    totals = by_item.agg(F.count("*").alias("n"), F.avg("n_words").alias("mean"), F.sum("n_words").alias("sum")).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if not totals["n"]:
        return spark.createDataFrame([], FOUND)
    frequency = terms.groupBy("term").agg(F.countDistinct("item_id").alias("df"))
    shards = -(-totals["sum"] // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    passes = []
    for number in range(shards):
        # Bounded: about SHARD_WORDS words of items.
        own = items.where(shard == number).select("item_id", "question", "answer").toArrow().to_pylist()
        dfs = terms.where(shard == number).select("term").distinct().join(frequency, "term").toArrow().to_pylist()
        idf = {r["term"]: log(1 + (totals["n"] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in dfs}
        classes: dict[int, list[tuple[int, str, str]]] = defaultdict(list)
        for r in own:
            n_words = len(words_of(r["question"])) + (len(words_of(r["answer"])) if r["answer"] != r["question"] else 0)
            if n_words:
                classes[window_of(n_words)].append((r["item_id"], r["question"], r["answer"]))
        if classes:
            passes.append(_searched(texts, dict(classes), idf, totals["mean"], least))
    if not passes:
        return spark.createDataFrame([], FOUND)
    found = reduce(DataFrame.unionByName, passes)
    best = Window.partitionBy("doc_id", "item_id").orderBy(
        F.desc(F.col("question_overlap") + F.col("answer_overlap")), F.desc("in_order"), F.desc("score"), "at_word"
    )
    return found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def _searched(texts: DataFrame, classes: dict, idf: dict[str, float], mean: float, least: float) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((classes, idf, mean))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequencies, mean_words = shared.value
        indexes = [ItemIndex(some, frequencies, mean_words, window, least) for window, some in own.items()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                best: dict[int, tuple] = {}
                for index in indexes:
                    for item, score, question, answer, at, share in finds_of(index, text.as_py()):
                        if question >= least and answer >= least or share > 0:
                            ranked = (question + answer, share, score, -at)
                            if item not in best or ranked > best[item][0]:
                                best[item] = (ranked, (doc_id, item, score, question, answer, at, share))
                rows += [row for _, row in best.values()]
            columns = zip(*rows) if rows else [()] * 7
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
            names = [f.split()[0] for f in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts.mapInArrow(run, FOUND)
