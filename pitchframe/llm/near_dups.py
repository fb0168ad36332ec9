"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidates.

A document's set of word shingles is hashed once; the hash space is cut into bins, and the
smallest hash of each bin is its minimum.  An empty bin borrows from a non-empty one that
hashing (bin, attempt) picks, the same for all documents (optimal densification).  ``ROWS``
minima make a band, equal bands a bucket.

Documents with one and the same set are one node from the start.  The shingles that no other
set in a bucket has bound what a node can share: nodes that cannot be near any set of their
bucket leave it.  In a bucket not all pairs
are compared but a star: the node that shares most buckets with others against the rest.
Links are confirmed on the full sets.  A bucket whose other nodes are then all in one
component is done; otherwise nodes of all its components but the largest become the next
centres, 16 times as many each round (of few components several each), compared with the
nodes of other components, until every pair in a bucket is in one component or was compared.
So the stars leave no candidate out, no pair within a component is compared, and the rounds
grow with the logarithm of a bucket's nodes.

With similarity 0.85, 60 bands of 10 miss a pair with probability 2e-6, and few pairs that are
less alike meet in a bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchframe.llm.common import settle, text_or_empty
from pitchframe.llm.components import components
from pitchframe.llm.shingles import forget_words, mixed, shingle_set

BANDS = 60
ROWS = 10
MARKED = 1 << 25  # bytes of sets whose marks are counted together
SHARE = 1_000_000  # shingles of partners that one copy of a centre's set serves
SKETCH = "doc_id long, text_hash long, node binary, size long, buckets array<long>"
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def set_name(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set: two sums of differently mixed hashes."""
    first, second = mixed(hashes + np.uint64(1)).sum(), mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    return np.array([first, second + np.uint64(len(hashes))], dtype=">u8").tobytes()


def minima(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """The densified minima (set x bin) of non-empty sorted sets."""
    found = np.zeros((len(sets), bins), dtype=np.uint64)
    filled = np.zeros((len(sets), bins), dtype=bool)
    for n, hashes in enumerate(sets):
        # Bins are ranges of the hash, so the first hash of a sorted set in a bin is its minimum.
        bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bin_of, prepend=-1))
        found[n, bin_of[first]] = hashes[first]
        filled[n, bin_of[first]] = True
    row, column = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        choice = mixed(column.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(bins)
        lends = filled[row, choice.astype(np.int64)]
        found[row[lends], column[lends]] = found[row[lends], choice[lends].astype(np.int64)]
        row, column = row[~lends], column[~lends]
    return found


def bucket_names(found: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit name (set x band) for the minima of every band."""
    weighted = mixed(found) * FACTORS[: found.shape[1]]
    names = weighted.reshape(len(found), -1, rows).sum(axis=2, dtype=np.uint64)
    return mixed(names + np.arange(names.shape[1], dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, node, size, buckets) of every row; without shingles node is empty and buckets null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                sets = [shingle_set(t.as_py()) for t in part.column("text")]
                used = [s for s in sets if len(s)]
                names = iter(bucket_names(minima(used, bands * rows), rows).tolist() if used else [])
                columns = [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array([set_name(s) if len(s) else b"" for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(names) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "buckets"])
        forget_words()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) for ``nodes`` (node, holder): recomputed from the holder's text.

    The holder is named by its doc_id and a hash of its text, so that rows which share a doc_id
    (or have none) do not all meet.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                names, own = part.column("node").to_pylist(), []
                for name, text in zip(names, part.column("text")):
                    hashes = shingle_set(text.as_py())
                    # Another row with the holder's doc_id may have another text of one hash.
                    own.append((name, hashes.tobytes()) if len(hashes) and set_name(hashes) == name else None)
                columns = zip(*[o for o in own if o]) if any(own) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["node", "shingles"])
        forget_words()

    holders = nodes.select("node", F.col("holder.doc_id").alias("holder_id"), F.col("holder.text_hash").alias("holder_hash"))
    at_holder = F.col("doc_id").eqNullSafe(F.col("holder_id")) & (F.xxhash64("text") == F.col("holder_hash"))
    held = docs.join(holders, at_holder).select("node", "text")
    # Repeated rows give one set several times.
    return held.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def common_counts(sets: DataFrame) -> DataFrame:
    """(node, common): how many shingles of each set some other set has too, or a few more.

    Marks of 4 bytes are counted by ranges of the hash; marks that agree by chance only raise
    ``common``, which serves as an upper bound.
    """
    total = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    bits = max(0, -(-total // MARKED) - 1).bit_length()

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                own = [np.frombuffer(s, dtype=np.uint64) for s in part.column("shingles").to_pylist()]
                owner = np.repeat(np.arange(len(own)), [len(s) for s in own])
                hashes = np.concatenate(own)
                shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)
                short = ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                order = np.argsort(shard, kind="stable")
                names, rows = part.column("node").to_pylist(), []
                for places in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    owners, counts = np.unique(owner[places], return_counts=True)
                    rows.append((int(shard[places[0]]), [names[i] for i in owners], counts.tolist(), short[places].tobytes()))
                types = (pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "nodes", "counts", "marks"]
                )

    def tally(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(m, dtype=np.uint32) for m in table["marks"].to_pylist()]
        _, which, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        counts = np.concatenate([np.array(c) for c in table["counts"].to_pylist()])
        common = np.add.reduceat((times[which] > 1).astype(np.int64), np.cumsum(counts) - counts)
        nodes = pa.chunked_array([pa.array(n, pa.binary()) for n in table["nodes"].to_pylist()], pa.binary())
        return pa.table({"node": nodes, "common": pa.array(common)})

    drawn = sets.mapInArrow(marks, "shard int, nodes array<binary>, counts array<long>, marks binary")
    tallies = drawn.groupBy("shard").applyInArrow(tally, "node binary, common long")
    return tallies.groupBy("node").agg(F.sum("common").alias("common"))


def confirmed(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (centre, node) those with 100 * intersection >= percent * union.

    A centre's set goes to as many tasks as its partners' shingles fill, never to one alone.
    """
    sized = pairs.join(sizes.select("node", "size"), "node")
    copies = sized.groupBy("centre").agg((F.sum("size") / SHARE + 1).cast("int").alias("copies"))
    dealt = sized.join(copies, "centre").select(
        "centre", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"), "node", F.lit(1).alias("role")
    )
    centres = copies.select(
        "centre",
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
        F.col("centre").alias("node"),
        F.lit(0).alias("role"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            links = []
            for c, role, node, raw in zip(*[batch.column(k).to_pylist() for k in ("centre", "role", "node", "shingles")]):
                hashes = np.frombuffer(raw, dtype=np.uint64)
                if role == 0:
                    centre, own = c, hashes
                    continue
                if c != centre:
                    raise ValueError("a partner came without its centre")
                both = len(np.intersect1d(own, hashes, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(hashes) - both):
                    links.append((c, node))
            columns = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["u", "v"])

    rows = dealt.unionByName(centres).join(sets, "node").select("centre", "copy", "role", "node", "shingles")
    ordered = rows.repartition("centre", "copy").sortWithinPartitions("centre", "copy", "role")
    return ordered.mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the
    distinct five-word shingles, or with fewer words the whole sequence as one.  Null texts
    and texts without words have empty sets and are linked with nothing: component_id is
    their doc_id.  Elsewhere it is the smallest doc_id reachable over links; a null doc_id
    never names a component with others.  Repeated rows are linked.  Other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    drawn = settle(sketches(docs, bands, rows), "sketches")
    # Rows of one set are one node; its buckets are those of any of them.
    nodes = settle(
        drawn.where("size > 0")
        .groupBy("node", "size", "buckets")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("holder"))
        .dropDuplicates(["node"]),
        "nodes",
    )
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    members = settle(members.join(shared, "bucket").select("bucket", "node"), "members")
    meeting = members.select("node").distinct()
    sets = settle(full_sets(docs, nodes.join(meeting, "node", "left_semi").select("node", "holder")), "sets")
    sizes = settle(nodes.select("node", "size").join(common_counts(sets), "node"), "sizes")
    # An intersection holds common shingles only: a node that even so is too far from the
    # smallest set of its bucket that could be near it has no link there.
    least = members.join(sizes, "node").groupBy("bucket").agg(F.min("size").alias("least"))
    floor = F.greatest(F.col("least"), F.ceil(F.col("size") * percent / 100))
    near = 100 * F.col("common") >= percent * (F.col("size") + floor - F.col("common"))
    members = members.join(sizes, "node").join(least, "bucket").where(near).select("bucket", "node")
    held = members.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    members = settle(members.join(held, "bucket"), "members")
    rank = members.groupBy("node").agg(F.sum("held").alias("rank"))
    centres = (
        members.select("bucket", "node")
        .join(rank, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("rank", "node")).alias("best"))
        .select("bucket", F.col("best.node").alias("centre"))
    )
    centres = settle(centres, "centres")
    labels = settle(rank.select("node", F.col("node").alias("component")), "labels")
    tested: DataFrame | None = None
    width = 1
    while True:
        known = labels.join(sizes, "node")
        # At most a bucket per band in a list.
        lies_in = F.collect_list("bucket").over(Window.partitionBy("node"))
        named = members.select("bucket", "node", lies_in.alias("buckets")).join(known, "node")
        leads = F.collect_list("bucket").over(Window.partitionBy("centre"))
        middle = centres.select("bucket", F.col("centre").alias("node"), leads.alias("leads")).join(known, "node")
        middle = middle.select("bucket", "leads", *[F.col(c).alias(f"centre_{c}") for c in known.columns])
        # The intersection holds at most the common shingles of either set.
        most = F.least("common", "centre_common")
        near = 100 * most >= percent * (F.col("size") + F.col("centre_size") - most)
        # A pair that meets in several buckets is taken from the first.
        first = F.array_min(F.array_intersect("buckets", "leads")) == F.col("bucket")
        met = named.join(middle.withColumnRenamed("centre_node", "centre"), "bucket")
        pairs = (
            met.where((F.col("component") != F.col("centre_component")) & near & first)
            .select(F.greatest("centre", "node").alias("x"), F.least("centre", "node").alias("y"), "centre", "node")
            .groupBy("x", "y")
            .agg(F.min("centre").alias("centre"))
            .select("centre", F.when(F.col("centre") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("node"))
        )
        if tested is not None:
            pairs = pairs.join(tested, ["centre", "node"], "left_anti")
        pairs = settle(pairs, "pairs")
        if not pairs.isEmpty():
            links = settle(confirmed(pairs, sets, sizes, percent), "links")
            merged = (
                links.join(labels.withColumnsRenamed({"node": "u", "component": "cu"}), "u")
                .join(labels.withColumnsRenamed({"node": "v", "component": "cv"}), "v")
                .select(F.col("cu").alias("u"), F.col("cv").alias("v"))
            )
            if not links.isEmpty():
                moved = components(merged).select(F.col("node").alias("component"), F.col("component").alias("moved"))
                labels = settle(
                    labels.join(moved, "component", "left").select("node", F.coalesce("moved", "component").alias("component")),
                    "labels",
                )
            turned = pairs.select(F.col("node").alias("centre"), F.col("centre").alias("node"))
            now = pairs.unionByName(turned)
            tested = settle(now if tested is None else tested.unionByName(now), "tested")
        members = members.select("bucket", "node").join(
            centres.withColumnRenamed("centre", "node"), ["bucket", "node"], "left_anti"
        )
        groups = members.join(labels, "node").groupBy("bucket", "component").agg(F.count("*").alias("n"))
        split = settle(groups, "groups")
        mixed_buckets = split.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
        members = settle(members.join(mixed_buckets, "bucket"), "members")
        if members.isEmpty():
            break
        width *= 16
        in_bucket = Window.partitionBy("bucket")
        smallest = F.row_number().over(in_bucket.orderBy("n", "component"))
        others = F.count("*").over(in_bucket) - 1
        # The largest component's nodes are compared as the others' partners.
        chosen = (
            split.withColumn("place", smallest)
            .withColumn("others", others)
            .where((F.col("place") <= F.col("others")) & (F.col("place") <= width))
            .select("bucket", "component", F.ceil(F.lit(width) / F.col("others")).alias("most"))
        )
        turn = F.row_number().over(Window.partitionBy("bucket", "component").orderBy("node"))
        centres = settle(
            members.join(labels, "node")
            .join(chosen, ["bucket", "component"])
            .withColumn("turn", turn)
            .where((F.col("turn") <= F.col("most")) & (F.col("turn") <= width))
            .select("bucket", F.col("node").alias("centre")),
            "centres",
        )
    return _named(drawn, labels)


def _named(drawn: DataFrame, labels: DataFrame) -> DataFrame:
    """Components named by their smallest doc_id."""
    named = settle(
        drawn.select("doc_id", "node", "size")
        .join(labels, "node", "left")
        .select("doc_id", "size", F.coalesce("component", "node").alias("component")),
        "named",
    )
    firsts = named.where("size > 0").groupBy("component").agg(F.min("doc_id").alias("first"))
    found = named.join(firsts, "component", "left")
    component_id = F.when(F.col("size") > 0, F.col("first")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component_id.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
