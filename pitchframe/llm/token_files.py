"""Token ids in a binary format: every document compressed by itself with a shared dictionary.

A dataset is a folder with two Parquet tables, so Spark's committer writes it and a lost
task leaves no part behind:

``dictionary``  one row: its SHA-256, the zstandard dictionary trained on serialised id
                arrays of a bounded sample, the width of an id in bytes, and the end id;
``blocks``      up to ``BLOCK_DOCS`` consecutive documents a row: payload (one zstandard
                frame per document, end to end), offset index (``ends``, the byte at which
                each frame ends), doc_ids, token counts, and the dictionary's hash.

Blocks are in ascending doc_id order by (file_no, block_no), which makes positions of whole
documents prefix sums over counts.  ``first_doc`` and ``last_doc`` have Parquet statistics,
so one document costs one block and one short frame.

Whole texts go through the tokenizers library.  Its byte-level pre-tokens never join text
across a step from black to a space or line break, or from a Latin letter to a sign.  A text
without special strings whose words (cut at these steps) all end in black is gathered from the ids of
its words, and only unseen words reach the library (many a call, as lines); any other text reaches it whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.alignment import Growing
from pitchframe.llm.common import text_or_empty

BLOCK_DOCS = 1024
BLOCK_BYTES = 1 << 20
CACHE_WORDS = 600_000
LINES = 256  # words that reach the library as one text
PORTION = 2 << 20  # bytes of text that are split together, about
SAMPLE_DOCS = 1_000  # documents, about, that the dictionary is trained on, each of SAMPLE_CHARS at most
SAMPLE_CHARS = (64, 8_192)
DICTIONARY_BYTES = 65_536
BLOCKS = (
    "file_no int, block_no int, first_doc long, last_doc long, n_docs int, n_ids long, "
    "doc_ids array<long>, counts array<long>, ends array<long>, dictionary string, payload binary"
)
DECODED = "doc_id long, file_no int, block_no int, before long, n_tokens long, ids_crc32 long"

# What a line of library input begins with: nothing there joins a break and what follows it.
LINE = "\n"
# Where texts are cut into words; a text that holds it goes to the library whole.
CUT = "\x01"
# A Latin letter and an ASCII sign behind it: no pre-token holds both.
SIGN_BEHIND, SIGN_APART = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-&(-/:-@\[-`{-~])", rf"\1{CUT}\2"


class Encoder:
    """Texts to serialised id arrays with a tokenizers file.

    The words of a portion are found and numbered in Arrow; each different word is looked up
    once, and documents are gathered from the ids of their words by offsets.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{width}")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = added
        (self.line_end,) = self.library.encode(LINE, add_special_tokens=False).ids
        self.line_ids = np.array([self.line_end], dtype=self.kind).tobytes()
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.starts, self.lengths, self.usable = Growing(), Growing(), Growing(), Growing()

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in encoded]

    def in_lines(self, words: list[str]) -> list[bytes]:
        """Ids of words without breaks that end in black, many a text, as lines."""
        parts = [words[start : start + LINES] for start in range(0, len(words), LINES)]
        encoded = self.encode_whole([LINE.join(part) for part in parts])
        found: list[bytes] = []
        size = self.kind.itemsize
        for part, raw in zip(parts, encoded):
            stops = (np.flatnonzero(np.frombuffer(raw, dtype=self.kind) == self.line_end) * size).tolist()
            if len(stops) != len(part) - 1:
                found += self.encode_whole(part)
            else:
                found += [raw[a:b] for a, b in zip([0, *[s + size for s in stops]], [*stops, len(raw)])]
        return found

    def learn(self, words: list[str]) -> None:
        """Add unseen words; one that does not end in black is of no use by itself."""
        good = [bool(w) and not may_go_on(w[-1]) for w in words]
        # A break before black is a pre-token of its own.
        broken = [w.startswith(LINE) and g for w, g in zip(words, good)]
        bare = [w[1:] if b else w for w, b in zip(words, broken)]
        lined = [n for n, g in enumerate(good) if g and LINE not in bare[n] and not (broken[n] and may_go_on(bare[n][0]))]
        ids = [b""] * len(words)
        for n, raw in zip(lined, self.in_lines([bare[n] for n in lined])):
            ids[n] = self.line_ids + raw if broken[n] else raw
        there = set(lined)
        rest = [n for n, g in enumerate(good) if g and n not in there]
        for n, raw in zip(rest, self.encode_whole([words[n] for n in rest])):
            ids[n] = raw
        lengths = np.array([len(i) for i in ids], dtype=np.int64) // self.kind.itemsize
        self.starts.extend(self.ids.size + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.usable.extend(np.array(good, dtype=np.int64))
        self.ids.extend(np.frombuffer(b"".join(ids), dtype=self.kind))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of words, each different one looked up once."""
        coded = words.dictionary_encode()
        # By way of numpy, which makes the strings in one go.
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.words.get, different)]
        unseen = [w for w, n in zip(different, found) if n is None]
        if unseen:
            self.learn(unseen)
            found = [self.words[w] if n is None else n for w, n in zip(different, found)]
        return np.array(found, dtype=np.int64)[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        if len(self.words) > CACHE_WORDS:
            self.forget()
        # Words are what spaces, line breaks and signs behind Latin letters begin, and keep them.
        marked = texts
        for before in (" ", LINE):
            marked = pc.replace_substring(marked, before, CUT + before)
        split = pc.split_pattern(pc.replace_substring_regex(marked, SIGN_BEHIND, SIGN_APART), CUT)
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        number = self.numbers(flat)
        # A text that begins with a space or a break has an empty word before it.
        usable = self.usable.room[number].astype(bool)
        usable[offsets[:-1]] |= pc.equal(flat.take(pa.array(offsets[:-1])), "").to_numpy(zero_copy_only=False)
        usable = np.logical_and.reduceat(usable, offsets[:-1])
        for apart in (CUT, *self.special):
            usable &= ~pc.match_substring(texts, apart).to_numpy(zero_copy_only=False)
        lengths = self.lengths.room[number]
        before = np.cumsum(lengths) - lengths
        ids = self.ids.room[np.arange(int(lengths.sum())) + np.repeat(self.starts.room[number] - before, lengths)]
        raw, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
        ends = (np.append(before, len(ids))[offsets] * size).tolist()
        whole = np.flatnonzero(~usable)
        encoded = self.encode_whole(texts.take(pa.array(whole)).to_pylist()) if len(whole) else []
        by_place = dict(zip(whole.tolist(), encoded))
        return [by_place[n] if n in by_place else raw[a:b] for n, (a, b) in enumerate(zip(ends, ends[1:]))]


def may_go_on(character: str) -> bool:
    """Whether a space behind the character might not begin a new pre-token: white space, controls and the like."""
    return unicodedata.category(character)[0] in "CZ"


@lru_cache(maxsize=2)
def encoder(path: str, width: int) -> Encoder:
    """One per Python worker."""
    return Encoder(path, width)


def in_portions(texts: Iterable, limit: int = 1 << 20) -> Iterator[list]:
    """(index, text) pairs in lists of about ``limit`` characters."""
    portion, size = [], 0
    for item in texts:
        portion.append(item)
        size += len(item[1])
        if size >= limit:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def id_arrays(tokenizer: str, width: int, end_id: int):
    """A ``mapInArrow`` function from (doc_id, text) to (doc_id, ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        own = encoder(tokenizer, width)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(batch):
                before = int(upto[start - 1]) if start else 0
                stop = min(len(batch), int(np.searchsorted(upto, before + PORTION)) + 1)
                # Taken and not sliced, so that offsets begin at 0.
                some = pa.concat_arrays([texts.slice(start, stop - start)])
                encoded = [e + end for e in own.encode(some)]
                ids = pa.array(encoded, pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), ids], ["doc_id", "ids"])
                start = stop
        # Workers live on after a step: what Arrow keeps for later use goes back.
        pa.default_memory_pool().release_unused()

    return run


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end_id: int) -> bytes:
    """A dictionary from about SAMPLE_DOCS documents of common length, drawn by a hash.

    Too few documents to train on give an empty dictionary: frames then stand alone.
    """
    usable = docs.where(F.length("text").between(*SAMPLE_CHARS))
    part = min(1.0, SAMPLE_DOCS / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(part * (1 << 40)))
    rows = sample.mapInArrow(id_arrays(tokenizer, width, end_id), "doc_id long, ids binary").collect()
    samples = sorted(bytes(r["ids"]) for r in rows)
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dict_data(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _blocks(tokenizer: str, width: int, end_id: int, raw: bytes, digest: str):
    schema = pa.schema(
        [
            ("file_no", pa.int32()),
            ("block_no", pa.int32()),
            ("first_doc", pa.int64()),
            ("last_doc", pa.int64()),
            ("n_docs", pa.int32()),
            ("n_ids", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("counts", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int64())),
            ("dictionary", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no = TaskContext.get().partitionId()
        frame = zstandard.ZstdCompressor(level=3, dict_data=_dict_data(raw)).compress
        block_no = 0

        def block(docs: list[int | None], counts: list[int], frames: list[bytes]) -> pa.RecordBatch:
            known = [d for d in docs if d is not None]
            ends = np.cumsum([len(f) for f in frames]).tolist()
            row = [file_no, block_no, min(known, default=None), max(known, default=None), len(docs), sum(counts)]
            row += [docs, counts, ends, digest, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        docs, counts, frames, size = [], [], [], 0
        for batch in id_arrays(tokenizer, width, end_id)(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids.as_py()
                docs.append(doc_id)
                counts.append(len(ids) // width)
                frames.append(frame(ids))
                size += len(frames[-1])
                if len(docs) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block(docs, counts, frames)
                    block_no += 1
                    docs, counts, frames, size = [], [], [], 0
        if docs:
            yield block(docs, counts, frames)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int) -> None:
    """Encode ``docs`` (doc_id, text) and write a dataset in ascending doc_id order below ``path``.

    Null texts count as empty and hold the end id alone; null doc_ids come first.  Rows with
    one doc_id follow in order of their texts.  Other columns are ignored; an empty table
    gives an empty dataset.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    raw = train_dictionary(docs, tokenizer, width, end_id)
    digest = hashlib.sha256(raw).hexdigest()
    header = spark.createDataFrame(
        [(digest, bytearray(raw), width, end_id)], "dictionary string, bytes binary, width int, end_id int"
    )
    header.coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = ordered.mapInArrow(_blocks(tokenizer, width, end_id, raw, digest), BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _decoder(header):
    raw, digest, width = bytes(header["bytes"]), header["dictionary"], header["width"]

    def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, int, np.ndarray]]:
        """(block, place in it, ids) of every document."""
        if hashlib.sha256(raw).hexdigest() != digest:
            raise ValueError("the dictionary does not match its hash")
        unframe = zstandard.ZstdDecompressor(dict_data=_dict_data(raw)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError(f"block {row['file_no']}/{row['block_no']} was written with another dictionary")
                payload, start = memoryview(row["payload"]), 0
                for place, end in enumerate(row["ends"]):
                    ids = np.frombuffer(unframe(payload[start:end]), dtype=f"<u{width}")
                    start = end
                    yield row, place, ids

    return frames


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` is the number of ids of all documents before it.  The files' totals are summed
    first (a row per file), then the blocks' within their file.
    """
    frames = _decoder(spark.read.parquet(f"{path}/dictionary").first())
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before = 0
        for row, place, ids in frames(batches):
            before = 0 if place == 0 else before
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            out.append((row["doc_ids"][place], row["file_no"], row["block_no"], before, len(ids), crc))
            before += len(ids)
            if len(out) == 8192:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in DECODED.split(", ")])

    decoded = blocks.select("file_no", "block_no", "doc_ids", "ends", "dictionary", "payload").mapInArrow(run, DECODED)
    earlier = (Window.unboundedPreceding, -1)
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    in_files = Window.partitionBy(F.lit(0)).orderBy("file_no").rowsBetween(*earlier)
    file_starts = files.select("file_no", F.coalesce(F.sum("n").over(in_files), F.lit(0)).alias("file_start"))
    in_blocks = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(*earlier)
    starts = (
        blocks.select("file_no", "block_no", F.coalesce(F.sum("n_ids").over(in_blocks), F.lit(0)).alias("block_start"))
        .join(file_starts, "file_no")
        .select("file_no", "block_no", (F.col("file_start") + F.col("block_start")).alias("block_start"))
    )
    return decoded.join(starts, ["file_no", "block_no"]).select(
        "doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every row stored with this doc_id: reads only blocks that can hold it."""
    frames = _decoder(spark.read.parquet(f"{path}/dictionary").first())
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [ids.astype(np.int64).tolist() for row, place, ids in frames(batches) if row["doc_ids"][place] == doc_id]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64()))], ["ids"])

    holding = blocks.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return [r["ids"] for r in holding.mapInArrow(run, "ids array<long>").collect()]
