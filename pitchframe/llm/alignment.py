"""Alignment of two tokenizers: which of their ids cover the same bytes, and how often corpus-wide.

A text is encoded by both; where tokens of both end, the tokens are cut into groups, and two
tokens are linked where their bytes overlap.  The count of an id pair is the number of
documents that hold it linked.

*Encoding.*  Both tokenizers keep words apart at a space behind a black character, so the
different words of a portion of text are encoded and aligned once and kept in a bounded cache;
documents are then gathered from words by offsets.  Any other text is encoded whole.

*External counting.*  A portion of documents yields records (pair, document, times), sorted
with the first tokenizer's id as the major key and split by its radix into runs: zstandard
blobs in the rows of a table in the shared folder.  Runs are merged many at a time through a
heap, block by block, into runs of (pair, documents) and these again until one is left per
radix; in it the pairs of an id follow each other and yield its highest count.  The record
runs then stream past their radix' counts and give every document its share back.  A radix is
cut into salts, so a frequent id fills no task, and memory follows the different pairs of a
radix, which the vocabularies bound.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import settle

MARK = "▁"  # stands for a space in pieces
RADIX = 64  # runs of a portion
PORTION = (4 << 20, 50_000)  # bytes and documents that make up a portion, about
CACHE_WORDS = 300_000
FAN_IN = 64  # runs that are merged together
RUN_BLOCK = 8_192  # pairs of a block of a run
PORTIONS_A_SALT = 256


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as.

    Printable bytes stand for themselves, all others for the characters from 256 on, in order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


# Arrays as bytes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each in its narrowest type, as one zstandard frame."""
    parts = []
    for array in arrays:
        narrow = array.astype(np.min_scalar_type(int(array.max(initial=0))))
        parts += [bytes([narrow.itemsize]), len(narrow).to_bytes(8, "little"), narrow.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(frame: bytes) -> list[np.ndarray]:
    raw, at, arrays = zstandard.ZstdDecompressor().decompress(frame), 0, []
    while at < len(raw):
        size, length = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        arrays.append(np.frombuffer(raw, dtype=f"<u{size}", count=length, offset=at + 9).astype(np.int64))
        at += 9 + size * length
    return arrays


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0)


# Encoding


class Aligned:
    """Sequences of tokens of both sides, with their links: ragged arrays by sequence."""

    def __init__(self, a: list[list[int]], b: list[list[int]], a_sizes: np.ndarray, b_sizes: np.ndarray, both: np.ndarray):
        """Sequences are not empty and have as many bytes on both sides; ``both`` maps (a, b) ids to keys."""
        self.n_a, self.n_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
        ids_a = np.array([i for s in a for i in s], dtype=np.int64)
        ids_b = np.array([i for s in b for i in s], dtype=np.int64)
        ends_a, ends_b = np.cumsum(a_sizes[ids_a]), np.cumsum(b_sizes[ids_b])
        # Between neighbouring ends of either side lies one link, and no other link has those bytes.
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.keys = both(ids_a[at_a], ids_b[at_b])
        last = ends_a[np.cumsum(self.n_a) - 1] if len(a) else ends_a
        self.n_links = np.diff(np.searchsorted(ends, last, side="right"), prepend=0)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_ends = np.searchsorted(shared, last, side="right")
        self.n_groups = np.diff(group_ends, prepend=0)
        self.groups = self._texts(ids_a, ids_b, ends_a, ends_b, shared, group_ends)

    @staticmethod
    def _texts(ids_a, ids_b, ends_a, ends_b, shared, group_ends) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every sequence."""
        a, b = [str(i) for i in ids_a.tolist()], [str(i) for i in ids_b.tolist()]
        cuts_a = [0, *np.searchsorted(ends_a, shared, side="right").tolist()]
        cuts_b = [0, *np.searchsorted(ends_b, shared, side="right").tolist()]
        groups = [
            f"{','.join(a[i:j])}|{','.join(b[k:n])}" for i, j, k, n in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
        ]
        bounds = [0, *group_ends.tolist()]
        return [";".join(groups[i:j]).encode() for i, j in zip(bounds, bounds[1:])]


class Growing:
    """A numpy array with room to grow."""

    def __init__(self):
        self.room, self.size = np.zeros(1024, dtype=np.int64), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(max(need, len(self.room)), dtype=np.int64)])
        self.room[self.size : need] = values
        self.size = need


class Aligner:
    """Both tokenizers of a worker, and the words it has seen lately."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        self.words_apart = self._words_apart()
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def _words_apart(self) -> bool:
        """Whether both sides cut at every space behind a black character."""
        import json

        setup = json.loads(self.a.to_str())
        before = setup["pre_tokenizer"] or {}
        by_regex = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        return bool(by_regex and setup["normalizer"] is None and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces))

    # Pairs as numbers: radix of the first id, the rest of it, the second id.

    @property
    def pairs_a_radix(self) -> int:
        return -(-len(self.a_bytes) // RADIX) * len(self.b_bytes)

    def both(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a % RADIX) * self.pairs_a_radix + (a // RADIX) * len(self.b_bytes) + b

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.good_end: list[bool] = []
        self.groups: list[bytes] = []
        self.numbers = {name: Growing() for name in ("n_a", "n_b", "n_groups", "n_links", "first_link", "usable")}
        self.keys = Growing()

    def encode(self, texts: list[str]) -> tuple[Aligned, np.ndarray]:
        """Texts with a space before them; ``usable`` marks those that both sides give back byte by byte."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        usable = np.zeros(len(texts), dtype=bool)
        for n, text in enumerate(texts):
            raw = b" " + text.encode()
            usable[n] = b"".join([a_bytes[i] for i in a[n]]) == raw and b"".join([b_bytes[i] for i in b[n]]) == raw
        kept = np.flatnonzero(usable).tolist()
        return Aligned([a[i] for i in kept], [b[i] for i in kept], self.a_sizes, self.b_sizes, self.both), usable

    def learn(self, words: list[str]) -> None:
        found, usable = self.encode(words)
        numbers = {"usable": usable.astype(np.int64)}
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            numbers[name] = np.zeros(len(words), dtype=np.int64)
            numbers[name][usable] = getattr(found, name)
        numbers["first_link"] = self.keys.size + np.cumsum(numbers["n_links"]) - numbers["n_links"]
        self.keys.extend(found.keys)
        for name, values in numbers.items():
            self.numbers[name].extend(values)
        texts = iter(found.groups)
        self.groups += [next(texts) if u else b"" for u in usable.tolist()]
        self.good_end += [bool(w) and unicodedata.category(w[-1])[0] not in "CZ" and w[-1] != MARK for w in words]
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))

    def portion(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """(numbers, group digests) by document, and (document, key) of every link."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        docs = len(texts)
        numbers = {name: np.zeros(docs, dtype=np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        digests = [""] * docs
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        by_words = np.zeros(docs, dtype=bool)
        owners, keys = [], []
        if self.words_apart and docs:
            split = pc.split_pattern(texts, " ")
            offsets = split.offsets.to_numpy()
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            self.learn([w for w in words if w not in self.words])
            number = np.array([self.words[w] for w in words], dtype=np.int64)[coded.indices.to_numpy()]
            usable = self.numbers["usable"].room[number].astype(bool)
            good = np.array([self.good_end[self.words[w]] for w in words], dtype=bool)[coded.indices.to_numpy()]
            good[offsets[1:] - offsets[0] - 1] = True  # behind the last word nothing is cut
            offsets = offsets - offsets[0]
            by_words = np.logical_and.reduceat(usable & good, offsets[:-1]) & ~empty
            counts = np.diff(offsets)
            for name, values in numbers.items():
                values[by_words] = np.add.reduceat(self.numbers[name].room[number], offsets[:-1])[by_words]
            chosen = np.repeat(by_words, counts)
            links = self.numbers["n_links"].room[number[chosen]]
            before = np.cumsum(links) - links
            first = self.numbers["first_link"].room[number[chosen]]
            keys.append(self.keys.room[np.arange(int(links.sum())) + np.repeat(first - before, links)])
            owners.append(np.repeat(np.repeat(np.arange(docs), counts)[chosen], links))
            groups, ends = self.groups, offsets.tolist()
            for doc in np.flatnonzero(by_words).tolist():
                own = number[ends[doc] : ends[doc + 1]].tolist()
                digests[doc] = hashlib.sha256(b";".join([groups[n] for n in own])).hexdigest()
        whole = np.flatnonzero(~by_words & ~empty)
        if len(whole):
            found, usable = self.encode(texts.take(pa.array(whole)).to_pylist())
            kept = whole[usable]
            for name, values in numbers.items():
                values[kept] = getattr(found, name)
            for doc, text in zip(kept.tolist(), found.groups):
                digests[doc] = hashlib.sha256(text).hexdigest()
            keys.append(found.keys)
            owners.append(np.repeat(kept, found.n_links))
        none = np.zeros(0, dtype=np.int64)
        return numbers, digests, np.concatenate(owners or [none]), np.concatenate(keys or [none])


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker."""
    return Aligner(a_path, b_path)


# Runs


def record_runs(owners: np.ndarray, keys: np.ndarray, docs: int, pairs_a_radix: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, pairs with their numbers of documents, documents and times) of a portion's links."""
    records, times = np.unique(keys * docs + owners, return_counts=True)
    key, doc = records // docs, records % docs
    cuts = np.searchsorted(key, np.arange(RADIX + 1) * pairs_a_radix)
    for radix, (start, end) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if start < end:
            pairs, holders = np.unique(key[start:end] - radix * pairs_a_radix, return_counts=True)
            yield radix, pack(steps(pairs), holders), pack(doc[start:end], times[start:end])


class Run:
    """Ascending pairs with counts, in packed blocks."""

    def __init__(self, blocks: list[bytes]):
        self.blocks = blocks

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in self.blocks:
            pairs, counts = unpack(block)
            yield np.cumsum(pairs), counts


def merge(runs: list[Run]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge: a heap knows whose loaded block ends first; up to that end all blocks are summed."""
    sources = [iter(run) for run in runs]
    loaded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def load(i: int) -> None:
        block = next(sources[i], None)
        if block is None:
            loaded.pop(i, None)
        else:
            loaded[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        bound = heap[0][0]
        parts = []
        for i, (pairs, counts) in loaded.items():
            cut = int(np.searchsorted(pairs, bound, side="right"))
            if cut:
                parts.append((pairs[:cut], counts[:cut]))
                loaded[i] = (pairs[cut:], counts[cut:])
        while heap and heap[0][0] == bound:
            load(heapq.heappop(heap)[1])
        pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        counts = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(counts, place, np.concatenate([c for _, c in parts]))
        yield pairs, counts


class Counter:
    """Runs that are merged FAN_IN at a time, and the results again, so that few are held."""

    def __init__(self):
        self.levels: list[list[Run]] = []

    def add(self, run: Run, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_IN:
            runs, self.levels[level] = self.levels[level], []
            self.add(self._merged(runs), level + 1)

    @staticmethod
    def _merged(runs: list[Run]) -> Run:
        blocks: list[bytes] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            pairs, counts = (np.concatenate(side) for side in zip(*held))
            blocks.extend(
                pack(steps(pairs[at : at + RUN_BLOCK]), counts[at : at + RUN_BLOCK]) for at in range(0, len(pairs), RUN_BLOCK)
            )
            held.clear()

        for part in merge(runs):
            held.append(part)
            if sum(len(p) for p, _ in held) >= RUN_BLOCK:
                flush()
        if held:
            flush()
        return Run(blocks)

    def result(self) -> Run:
        runs = [run for level in self.levels for run in level]
        return runs[0] if len(runs) == 1 else self._merged(runs)


# Spark

DOC_COLUMNS = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>"
PORTIONS = f"portion long, radix int, pairs binary, holders binary, docs int, {DOC_COLUMNS}"


def _portion_rows(a_path: str, b_path: str):
    """(doc_id, text) to a row of documents (radix -1) and the record runs of every portion."""
    lists = [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string())]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), *lists]
    names = [f.split()[0] for f in PORTIONS.split(", ")]

    def rows(found: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = aligner(a_path, b_path)
        portion = TaskContext.get().partitionId() << 32
        held_ids: list[pa.Array] = []
        held_texts: list[pa.Array] = []
        size = 0

        def finish() -> pa.RecordBatch:
            nonlocal portion
            ids, texts = pa.concat_arrays(held_ids), pa.concat_arrays(held_texts)
            held_ids.clear()
            held_texts.clear()
            numbers, digests, owners, keys = own.portion(texts)
            found = [[portion, -1, None, None, len(ids), ids.to_pylist(), *[v.tolist() for v in numbers.values()], digests]]
            for radix, pairs, holders in record_runs(owners, keys, len(ids), own.pairs_a_radix):
                found.append([portion, radix, pairs, holders, len(ids), *[None] * 6])
            portion += 1
            return rows(found)

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_string())
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(batch):
                upto = np.cumsum(sizes[start : start + PORTION[1]]) + size
                take = min(int(np.searchsorted(upto, PORTION[0])) + 1, len(upto))
                held_ids.append(ids.slice(start, take))
                held_texts.append(texts.slice(start, take))
                size, start = int(upto[take - 1]), start + take
                if size >= PORTION[0] or sum(map(len, held_ids)) >= PORTION[1]:
                    yield finish()
                    size = 0
        if held_ids:
            yield finish()

    return run


RUNS = "radix int, blocks array<binary>"


def _run_rows(counters: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    for radix in sorted(counters):
        columns = [pa.array([radix], pa.int32()), pa.array([counters[radix].result().blocks], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["radix", "blocks"])


def _count_portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record runs of many portions to one run of counts a radix."""
    counters: dict[int, Counter] = {}
    for batch in batches:
        for radix, pairs in zip(batch.column("radix").to_pylist(), batch.column("pairs")):
            counters.setdefault(radix, Counter()).add(Run([pairs.as_py()]))
    yield from _run_rows(counters)


def _totals(second_size: int):
    """The runs of a radix to its pairs, their counts and whether a count is its first id's highest."""

    def total(radix: int, counter: Counter) -> pa.RecordBatch:
        pairs, counts = (np.concatenate(side) for side in zip(*counter.result()))
        first = pairs // second_size
        heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        most = np.repeat(np.maximum.reduceat(counts, heads), np.diff(np.append(heads, len(pairs))))
        packed = pack(steps(pairs), counts, (counts == most).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([packed], pa.binary())], ["radix", "totals"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counter = None, Counter()
        for batch in batches:
            for radix, blocks in zip(batch.column("radix").to_pylist(), batch.column("blocks")):
                if radix != now and now is not None:
                    yield total(now, counter)
                    counter = Counter()
                now = radix
                counter.add(Run(blocks.as_py()))
        if now is not None:
            yield total(now, counter)

    return run


def exact_sums(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place; ``bincount`` adds doubles, so high and low bits go apart."""
    low = np.bincount(places, weights=values & 0xFFFFFF, minlength=size)
    high = np.bincount(places, weights=values >> 24, minlength=size)
    return low.astype(np.int64) + (high.astype(np.int64) << 24)


SHARES = "portion long, docs int, shares binary"


def _shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A radix' totals and the record runs behind them to the documents' sums."""
    pairs = counts = best = None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if row["totals"] is not None:
                deltas, counts, best = unpack(row["totals"])
                pairs = np.cumsum(deltas)
                continue
            deltas, holders = unpack(row["pairs"])
            doc, times = unpack(row["holders"])
            at = np.repeat(np.searchsorted(pairs, np.cumsum(deltas)), holders)
            sums = exact_sums(doc, counts[at] * times, row["docs"])
            found.append((row["portion"], row["docs"], pack(sums, exact_sums(doc, best[at] * times, row["docs"]))))
        types = [pa.int64(), pa.int32(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SHARES.split(", ")])


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shares of every portion, which follow each other, summed."""

    def out(portion: int, sums: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([portion], pa.int64()), *[pa.array([s.tolist()], pa.list_(pa.int64())) for s in sums]]
        return pa.RecordBatch.from_arrays(columns, ["portion", "count_sum", "n_best"])

    now, sums = None, None
    for batch in batches:
        for portion, shares in zip(batch.column("portion").to_pylist(), batch.column("shares")):
            own = np.array(unpack(shares.as_py()))
            if portion != now:
                if now is not None:
                    yield out(now, sums)
                now, sums = portion, own
            else:
                sums = sums + own
    if now is not None:
        yield out(now, sums)


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level tokenizers file, ``b_path`` a sentencepiece model that puts a space
    before a text.  Whole texts count.  Texts that are null or empty, or that one side does not
    give back byte by byte, have no tokens: zeros, and an empty string for the digest.  Null or
    repeated doc_ids and repeated rows are documents of their own; other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    portions = settle(rows.mapInArrow(_portion_rows(a_path, b_path), PORTIONS), "portions")
    runs = portions.where("radix >= 0")
    counted = runs.select("radix", "pairs").mapInArrow(_count_portions, RUNS)
    second_size = len(aligner(a_path, b_path).b_bytes)
    totals = counted.repartition("radix").sortWithinPartitions("radix").mapInArrow(_totals(second_size), "radix int, totals binary")
    totals = settle(totals, "totals")

    salts = -(-portions.where("radix = -1").count() // PORTIONS_A_SALT) or 1
    salt = F.pmod(F.xxhash64("portion"), F.lit(salts)).cast("int")
    records = runs.select("radix", salt.alias("salt"), "portion", "docs", "pairs", "holders", F.lit(None).cast("binary").alias("totals"))
    none = F.lit(None)
    known = totals.select(
        "radix",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        none.cast("long").alias("portion"),
        none.cast("int").alias("docs"),
        none.cast("binary").alias("pairs"),
        none.cast("binary").alias("holders"),
        "totals",
    )
    dealt = known.unionByName(records).repartition("radix", "salt")
    stream = dealt.sortWithinPartitions("radix", "salt", F.asc_nulls_first("portion"))
    shares = stream.mapInArrow(_shares, SHARES)
    sums = shares.repartition("portion").sortWithinPartitions("portion").mapInArrow(
        _summed, "portion long, count_sum array<long>, n_best array<long>"
    )
    names = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups"]
    both = portions.where("radix = -1").select("portion", "docs", *names).join(sums, "portion", "left")
    zeros = F.array_repeat(F.lit(0).cast("long"), F.col("docs"))
    filled = [F.coalesce(F.col(c), zeros).alias(c) for c in ("count_sum", "n_best")]
    row = both.select(F.inline(F.arrays_zip(*[F.col(n).alias(n) for n in names], *filled)))
    return row.select(
        F.col("doc_ids").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.col("groups").alias("groups_sha256"),
    )
