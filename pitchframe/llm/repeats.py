"""Removal of repeated passages over suffix arrays, sharded by content.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document
with a smaller doc_id.

Sharding.  The strings of LENGTH bytes that share their smallest k-mer hash (minimizer) and
follow each other make a segment of about LENGTH + 13 bytes.  Equal strings have equal
minimizers wherever they stand, so segments dealt by minimizer bring all occurrences of a
string into one shard, and every occurrence lies in exactly one segment.  Minimizers that
occur once are dropped first (4 bytes each decide it), and only the segments of the others
travel, each different one once per pack of documents, with its smallest doc_id.

Hot minimizers.  A phrase that is the minimizer of different text in very many documents would
bring them all to one shard.  Segments of a minimizer that occurs more than ``HOT`` times do not
travel: each of their strings is dealt by its own digest (128 bits), with its smallest doc_id.
Equal strings have equal minimizers, so all occurrences of a string go the same way, and only
equal strings meet by necessity.

Index.  A shard joins its different segments to one text, sorts its suffixes by prefix
doubling and finds where the runs of the Burrows-Wheeler transform begin.  The array is whole:
memory follows the different bytes of a shard and not runs.  Match lengths with the suffix
before are computed at the run heads alone; from these samples they stream over the text,
one less from each position to the next (within a run the preceding characters agree).
Suffixes in order that match in LENGTH bytes or more are the occurrences of one string, and
the smallest doc_id among them goes back to every segment of every pack.

Packs are about 2 MB of whole documents, a very long document is one by itself, and shards
are as many as the corpus asks for.  What a shard holds of one minimizer is bounded by ``HOT``
different segments.  What still grows with the corpus in one task: a string that stands in
every document costs its shard one segment or digest a pack, and a minimizer costs 4 bytes
for each of its occurrences while they are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import settle, text_or_empty
from pitchframe.llm.shingles import BASE, BYTE_VALUES, mixed, powers

LENGTH = 50
KMER = 24
PACK = 1 << 21  # bytes of whole documents packed together
SHARD = 1 << 21  # bytes of corpus per shard
PART = 1 << 20  # bytes of a pack whose segments are found together
HOT = 1 << 12  # segments of a minimizer from which their strings are dealt one by one
DIGEST = 16
SYMBOLS = 7  # of 9 bits in one sort key
NOBODY = np.iinfo(np.int64).max  # stands for a null doc_id: smaller than none
PACKS = "pack long, n_bytes long, doc_ids binary, sizes binary, payload binary"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def make_packs(docs: DataFrame) -> DataFrame:
    """Whole documents (doc_id, text) in packs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def pack(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            row = [number, int(sizes.sum()), np.array(ids, dtype=np.int64).tobytes(), sizes.tobytes(), squeeze(b"".join(texts))]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = [f.split()[0] for f in PACKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                if size and size + len(raw) > PACK:
                    yield pack(ids, texts)
                    number += 1
                    ids, texts, size = [], [], 0
                ids.append(NOBODY if doc_id is None else doc_id)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield pack(ids, texts)

    return docs.mapInArrow(run, PACKS)


class Segments:
    """The segments of a pack: ``start``, number of strings ``n``, minimizer ``hash``, content name, doc."""

    def __init__(self, data: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, length: int, kmer: int):
        doc_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        found = [_segments(data, doc_of, a, length, kmer) for a in range(0, max(1, len(data) - length + 1), PART)]
        self.start, self.n, self.hash, self.name = (np.concatenate(c) for c in zip(*found))
        self.doc = doc_ids[doc_of[self.start]] if len(self.start) else np.zeros(0, dtype=np.int64)
        self.hot = np.zeros(len(self.start), dtype=bool)

    def shards(self, bits: int) -> np.ndarray:
        return (self.hash >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.hash), dtype=np.int64)

    def keep(self, mask: np.ndarray) -> None:
        self.start, self.n, self.hash = self.start[mask], self.n[mask], self.hash[mask]
        self.name, self.doc, self.hot = self.name[mask], self.doc[mask], self.hot[mask]

    def take_hot(self, data: np.ndarray, length: int, bits: int) -> "Strings":
        """The strings of the hot segments, which are dropped here."""
        n = self.n[self.hot]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, doc = np.repeat(self.start[self.hot], n) + inner, np.repeat(self.doc[self.hot], n)
        self.keep(~self.hot)
        return Strings(data, at, doc, length, bits)


class Strings:
    """Strings of a pack dealt one by one: ``at``, ``doc``; by shard and digest the different ones with
    their smallest doc, in an order that only the pack's content decides."""

    def __init__(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int, bits: int):
        self.at, self.doc = at, doc
        raw = data.tobytes() if len(at) else b""
        digests = b"".join([hashlib.blake2b(raw[a : a + length], digest_size=DIGEST).digest() for a in at.tolist()])
        names, self.which = _different_digests(digests)
        self.names = names
        self.least = np.full(len(names), NOBODY)
        np.minimum.at(self.least, self.which, doc)
        first = np.frombuffer(names.tobytes(), dtype=">u8")[::2].astype(np.uint64)
        # Digests are in order, so those of a shard follow each other.
        self.shard = (first >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), dtype=np.int64)

    def by_shard(self) -> Iterator[tuple[int, np.ndarray]]:
        return _by_shard(self.shard)


def _different_digests(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different digests in the order of their bytes, and of each digest its place among them."""
    halves = np.frombuffer(digests, dtype=">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ranked = halves[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    return ranked[fresh].astype(">u8"), which


def _segments(data: np.ndarray, doc_of: np.ndarray, first: int, length: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Segments of the strings that start in [first, first + PART)."""
    data = data[first : first + PART + length - 1]
    size = len(data)
    if size < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers(max(PART * 2, 1 << (size - 1).bit_length()))
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:size], out=sums[1:])
    hashes = mixed((sums[kmer:] - sums[:-kmer]) * down[: size - kmer + 1])
    # Smallest of the window by the upper half of the hash, leftmost of equal ones.
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, covered = length - kmer + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    docs = doc_of[first : first + size]
    inside = docs[: len(at)] == docs[length - 1 :]
    turn = np.ones(len(at), dtype=bool)
    turn[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (docs[1 : len(at)] != docs[: len(at) - 1])
    start = np.flatnonzero(turn)
    n = np.diff(np.append(start, len(at)))
    used = inside[start]
    start, n = start[used], n[used]
    name = mixed((sums[start + n + length - 1] - sums[start]) * down[start] + n.astype(np.uint64))
    # Smallest hashes are small numbers: mixed once more they spread over the shards.
    return start + first, n, mixed(hashes[at[start]] ^ np.uint64(BASE)), name


def _opened(row: dict, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Segments]:
    data = np.frombuffer(unsqueeze(row["payload"]), dtype=np.uint8)
    doc_ids, sizes = (np.frombuffer(row[k], dtype=np.int64) for k in ("doc_ids", "sizes"))
    return data, doc_ids, sizes, Segments(data, doc_ids, sizes, length, kmer)


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in their order)."""
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(shards[places[0]]), places


def _only_repeated(segments: Segments, bits: int, flags: list[dict] | None) -> None:
    """Drop the segments whose minimizer occurs once and mark the hot ones, by the flags of every shard."""
    mask = np.zeros(len(segments.hash), dtype=bool)
    known = {f["shard"]: f for f in flags or []}
    for shard, places in _by_shard(segments.shards(bits)):
        own = known[shard]
        mask[places] = np.unpackbits(np.frombuffer(own["flags"], dtype=np.uint8), count=len(places)).astype(bool)
        if own["hot"]:
            segments.hot[places] = np.unpackbits(np.frombuffer(own["hot"], dtype=np.uint8), count=len(places)).astype(bool)
    segments.keep(mask)


def _different(segments: Segments, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first places of its different segments, place in these of each of its segments)."""
    for shard, places in _by_shard(segments.shards(bits)):
        _, first, which = np.unique(segments.name[places], return_index=True, return_inverse=True)
        yield shard, places[first], np.stack([places, which])


def repeated_minimizers(packs: DataFrame, bits: int, length: int, kmer: int, hot: int) -> DataFrame:
    """(pack, all): for every pack the flags (shard, bits, bits of the hot) of its segments in order."""

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segments = _opened(row, length, kmer)[3]
                short = ((segments.hash << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                parts = [(shard, short[places].tobytes()) for shard, places in _by_shard(segments.shards(bits))]
                shards, own = zip(*parts) if parts else ((), ())
                columns = [pa.array(shards, pa.int32()), pa.array([row["pack"]] * len(shards), pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "pack", "marks"])

    def flag(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(m, dtype=np.uint32) for m in table["marks"].to_pylist()]
        _, which, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(m) for m in own])[:-1]
        again = [np.packbits(a).tobytes() for a in np.split(counts[which] > 1, cuts)]
        often = [np.packbits(a).tobytes() if a.any() else b"" for a in np.split(counts[which] > hot, cuts)]
        out = table.select(["pack", "shard"]).append_column("flags", pa.array(again, pa.binary()))
        return out.append_column("hot", pa.array(often, pa.binary()))

    drawn = packs.mapInArrow(marks, "shard int, pack long, marks binary")
    flagged = drawn.groupBy("shard").applyInArrow(flag, "pack long, shard int, flags binary, hot binary")
    # One entry a shard: bounded by the pack.
    return flagged.groupBy("pack").agg(F.collect_list(F.struct("shard", "flags", "hot")).alias("all"))


def sorted_suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of segments joined to ``text``; ``ends`` is each position's segment end.

    A suffix stops at its segment's end; equal ones follow each other by position.
    """
    size = len(text)
    left = ends - np.arange(size)
    key = np.zeros(size, dtype=np.uint64)
    for i in range(SYMBOLS):
        symbol = np.zeros(size, dtype=np.uint64)
        symbol[: size - i] = text[i:].astype(np.uint64) + np.uint64(1)
        symbol[left <= i] = 0
        key = (key << np.uint64(9)) | symbol
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    rank = np.zeros(size + 1, dtype=np.int64)  # of the first of equal suffixes, from 1; 0 beyond the end

    def name(where: np.ndarray, fresh: np.ndarray) -> None:
        """Ranks for the sorted places ``where``: those of the last fresh one."""
        rank[order[where]] = np.maximum.accumulate(np.where(fresh, where, 0)) + 1

    fresh = np.ones(size, dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    name(np.arange(size), fresh)
    depth = SYMBOLS
    while True:
        # Places in groups of equals; those shorter than ``depth`` agree to their end.
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        where = np.flatnonzero(tied)
        where = where[left[order[where]] >= depth]
        if not len(where):
            return order
        here = order[where]
        beyond = np.where(left[here] > depth, rank[np.minimum(here + depth, size)], 0)
        both = (rank[here].astype(np.uint64) << np.uint64(32)) | beyond.astype(np.uint64)
        moved = np.argsort(both, kind="stable")
        order[where] = here[moved]
        both = both[moved]
        own = np.ones(len(where), dtype=bool)
        own[1:] = both[1:] != both[:-1]
        fresh[where] = own
        name(where, own)
        depth *= 2


def run_heads(text: np.ndarray, order: np.ndarray, starts_segment: np.ndarray) -> np.ndarray:
    """Places in suffix order where a run of the Burrows-Wheeler transform begins."""
    before = text[order - 1]
    first = starts_segment[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (before[1:] != before[:-1]) | first[1:] | first[:-1]
    return np.flatnonzero(head)


def match_lengths(text: np.ndarray, ends: np.ndarray, order: np.ndarray, heads: np.ndarray, most: int) -> np.ndarray:
    """By text position, the length (up to about ``most``) of the match with the suffix before in order."""
    here, there = order[heads], order[heads - 1]
    limit = np.minimum(ends[here] - here, ends[there] - there)
    limit[heads == 0] = 0
    limit = np.minimum(limit, len(text))
    matched = np.zeros(len(heads), dtype=np.int64)
    active = np.flatnonzero(limit > 0)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    words = np.zeros(len(text) + 1, dtype=np.uint64)
    for i in range(8):
        words[:-1] |= padded[i : i + len(text)].astype(np.uint64) << np.uint64(8 * i)
    while len(active):
        at = matched[active]
        x, y = here[active] + at, there[active] + at
        differ = words[np.minimum(x, len(text))] ^ words[np.minimum(y, len(text))]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3)
        matched[active] = np.minimum(at + same, limit[active])
        active = active[(same == 8) & (matched[active] < limit[active])]
    # Not capped at ``most``: positions that follow lose one each.
    sample = np.zeros(len(text), dtype=np.int64)
    at = np.zeros(len(text), dtype=bool)
    at[here] = True
    sample[here] = matched + here
    last = np.maximum.accumulate(np.where(at, np.arange(len(text)), 0))
    return sample[last] - np.arange(len(text))


def smallest_holders(segments: list[bytes], holders: np.ndarray, length: int) -> list[np.ndarray]:
    """For every string of each segment the smallest holder of a segment that has it."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(segments), dtype=np.uint8)
    stops = np.cumsum(sizes)
    of = np.repeat(np.arange(len(segments)), sizes)
    ends = stops[of]
    first = np.zeros(len(text), dtype=bool)
    first[stops - sizes] = True
    order = sorted_suffixes(text, ends)
    matches = match_lengths(text, ends, order, run_heads(text, order, first), length)
    group = np.flatnonzero(matches[order] < length)
    least = np.minimum.reduceat(holders[of[order]], group)
    by_position = np.empty(len(text), dtype=np.int64)
    by_position[order] = np.repeat(least, np.diff(np.append(group, len(order))))
    return [by_position[stop - size : stop - length + 1] for stop, size in zip(stops.tolist(), sizes.tolist())]


def holders_by_pack(packs: DataFrame, bits: int, length: int, kmer: int) -> DataFrame:
    """(pack, found): for every pack and shard the smallest holders of its segments' strings."""

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, _, _, segments = _opened(row, length, kmer)
                _only_repeated(segments, bits, row["all"])
                strings = segments.take_hot(data, length, bits)
                alone = {shard: (strings.names[p].tobytes(), strings.least[p].tobytes()) for shard, p in strings.by_shard()}
                rows = []
                for shard, first, pairs in _different(segments, bits):
                    least = np.full(len(first), NOBODY)
                    np.minimum.at(least, pairs[1], segments.doc[pairs[0]])
                    sizes = (segments.n[first] + length - 1).astype(np.int64)
                    whole = b"".join([data[s : s + n].tobytes() for s, n in zip(segments.start[first].tolist(), sizes.tolist())])
                    own = (least.tobytes(), sizes.astype(np.uint16).tobytes(), squeeze(whole))
                    rows.append((shard, row["pack"], *own, *alone.pop(shard, (b"", b""))))
                rows += [(shard, row["pack"], b"", b"", squeeze(b""), *own) for shard, own in alone.items()]
                columns = zip(*rows) if rows else [()] * 7
                types = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
                names = ["shard", "pack", "holders", "sizes", "payload", "strings", "string_holders"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def index(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        least: list[int] = []
        of_pack = []
        for holders, sizes, payload in zip(*[table[c].to_pylist() for c in ("holders", "sizes", "payload")]):
            raw, start, own = unsqueeze(payload), 0, []
            for holder, size in zip(np.frombuffer(holders, dtype=np.int64).tolist(), np.frombuffer(sizes, dtype=np.uint16).tolist()):
                n = number.setdefault(raw[start : start + size], len(number))
                start += size
                if n == len(least):
                    least.append(holder)
                elif holder < least[n]:
                    least[n] = holder
                own.append(n)
            of_pack.append(own)
        found = smallest_holders(list(number), np.array(least, dtype=np.int64), length) if number else []
        none = np.zeros(0, dtype=np.int64)
        out = [squeeze(np.concatenate([none, *[found[n] for n in own]]).tobytes()) for own in of_pack]
        names = table["strings"].to_pylist()
        _, which = _different_digests(b"".join(names))
        holders = np.frombuffer(b"".join(table["string_holders"].to_pylist()), dtype=np.int64)
        smallest = np.full(which.max(initial=-1) + 1, NOBODY)
        np.minimum.at(smallest, which, holders)
        cuts = np.cumsum([len(n) // DIGEST for n in names])[:-1]
        alone = [squeeze(a.tobytes()) if len(a) else b"" for a in np.split(smallest[which], cuts)]
        given = table.select(["pack", "shard"]).append_column("found", pa.array(out, pa.binary()))
        return given.append_column("strings", pa.array(alone, pa.binary()))

    columns = "holders binary, sizes binary, payload binary, strings binary, string_holders binary"
    drawn = packs.mapInArrow(contents, f"shard int, pack long, {columns}")
    found = drawn.groupBy("shard").applyInArrow(index, "pack long, shard int, found binary, strings binary")
    return found.groupBy("pack").agg(F.collect_list(F.struct("shard", "found", "strings")).alias("found"))


def _cut(row: dict, bits: int, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, doc_ids, sizes, mask of removed bytes) of a pack."""
    data, doc_ids, sizes, segments = _opened(row, length, kmer)
    _only_repeated(segments, bits, row["all"])
    strings = segments.take_hot(data, length, bits)
    steps = np.zeros(len(data) + 1, dtype=np.int32)
    known = {f["shard"]: f["found"] for f in row["found"] or []}
    alone = {f["shard"]: f["strings"] for f in row["found"] or []}
    if len(strings.at):
        least = np.concatenate([np.frombuffer(unsqueeze(alone[shard]), dtype=np.int64) for shard, _ in strings.by_shard()])
        goes = strings.at[least[strings.which] < strings.doc]
        np.add.at(steps, goes, 1)
        np.add.at(steps, goes + length, -1)
    for shard, first, (places, which) in _different(segments, bits):
        holders = np.frombuffer(unsqueeze(known[shard]), dtype=np.int64)
        offsets = np.cumsum(segments.n[first]) - segments.n[first]
        n = segments.n[places]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(segments.start[places], n) + inner
        goes = at[holders[np.repeat(offsets[which], n) + inner] < np.repeat(segments.doc[places], n)]
        np.add.at(steps, goes, 1)
        np.add.at(steps, goes + length, -1)
    return data, doc_ids, sizes, np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left).

    Texts count as UTF-8 bytes, a null text as none; matches never cross documents, and a
    removal may split a character.  Strings are judged on the input.  A null doc_id is larger
    than all others.  Rows with one doc_id, so also repeated rows, do not remove each other's
    bytes.  Other columns are ignored; an empty table gives no rows.
    """
    kmer = min(KMER, length)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    packs = settle(make_packs(texts), "packs")
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, -(-total // SHARD) - 1).bit_length()
    flags = settle(repeated_minimizers(packs, bits, length, kmer, hot), "flags")
    flagged = packs.join(flags, "pack", "left")
    found = settle(holders_by_pack(flagged.select("pack", "doc_ids", "sizes", "payload", "all"), bits, length, kmer), "holders")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, doc_ids, sizes, gone = _cut(row, bits, length, kmer)
                rows, start = [], 0
                for doc_id, size in zip(doc_ids.tolist(), sizes.tolist()):
                    own = gone[start : start + size]
                    kept = data[start : start + size][~own].tobytes()
                    spans = int(own[:1].sum() + np.count_nonzero(own[1:] & ~own[:-1]))
                    start += size
                    named = None if doc_id == NOBODY else doc_id
                    digest = hashlib.sha256(kept).hexdigest()
                    rows.append((named, size, size - len(kept), spans, digest, kept if with_text else None))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    cut = flagged.join(found, "pack", "left").mapInArrow(run, f"{REMOVED}, kept binary")
    return cut if with_text else cut.drop("kept")
