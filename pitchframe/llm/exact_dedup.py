"""Exact deduplication over an extendible-hash index kept as shared files.

The key of a text is a 64-bit hash of its normalised form.  The directory maps the
first bits of a key to a bucket.  It starts as one bucket and doubles as long as some
bucket holds more than ``capacity`` keys: an overfull bucket is split on the next bit
and the others keep their depth, so several directory slots may share a bucket.  Every
bucket is a range of keys, a folder of the index, and belongs to one owner task, which
chains the entries of colliding keys.  Texts are compared byte by byte: the rows of a
group are first folded within each input partition (so that a text holding a third of
all rows moves once per partition), then per key and text.

Only DataFrame operations are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import SPACE, new_path, settle, text_or_empty

DIRECTORY_BITS = 16  # at most 65,536 directory slots of 12 bytes
CAPACITY = 65_536  # keys of a bucket before it is split


def normalised(text: str = "text") -> Column:
    """Runs of ASCII white space as one space; a null text counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def slot(key: Column, bits: int = DIRECTORY_BITS) -> Column:
    """The first ``bits`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int")


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, bucket, depth) for every slot in use; ``keys`` has one row per distinct ``key``.

    A bucket is named by its first slot.  Buckets at full depth may stay above ``capacity``.
    """
    pending = settle(keys.groupBy(slot(F.col("key")).alias("slot")).agg(F.count("*").alias("n")), "slots")
    closed = []
    for depth in range(DIRECTORY_BITS + 1):
        rest = DIRECTORY_BITS - depth
        bucket = F.shiftleft(F.shiftright(F.col("slot"), rest), rest)
        placed = pending.withColumn("bucket", bucket)
        load = placed.groupBy("bucket").agg(F.sum("n").alias("held"))
        sized = settle(placed.join(load, "bucket"), f"depth{depth}")
        fits = (F.col("held") <= capacity) | F.lit(rest == 0)
        closed.append(sized.where(fits).select("slot", "bucket", F.lit(depth).alias("depth")))
        pending = sized.where(~fits).select("slot", "n")
        if pending.isEmpty():
            break
    return reduce(DataFrame.unionByName, closed)


def build_index(docs: DataFrame, keys: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Write the index of ``docs`` below ``path`` and return its entries.

    One entry per different text: key, chain (its place among the texts with this key),
    text_sha256, keep_id (smallest doc_id) and group_size, in folders by bucket.
    """
    spark = docs.sparkSession
    directory = build_directory(keys, capacity)
    directory.write.parquet(f"{path}/directory")
    # Bounded: DIRECTORY_BITS limits the directory to 65,536 rows.
    directory = F.broadcast(spark.read.parquet(f"{path}/directory").select("slot", "bucket"))
    same_text = (
        docs.select("doc_id", normalised().alias("norm"))
        .groupBy(F.xxhash64("norm").alias("key"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    entries = same_text.select(
        "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", slot(F.col("key")).alias("slot")
    )
    collisions = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    (
        entries.join(directory, "slot")
        .repartition("bucket")
        .withColumn("chain", F.row_number().over(collisions))
        .drop("slot")
        .sortWithinPartitions("bucket", "key", "chain")
        .write.partitionBy("bucket")
        .parquet(f"{path}/entries")
    )
    stored = "key long, text_sha256 string, keep_id long, group_size long, chain int, bucket int"
    return spark.read.schema(stored).parquet(f"{path}/entries")


def exact_dedup(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing every run of ASCII white space by one
    space; the smallest doc_id of equal texts stays.  Null texts count as empty.  A null
    doc_id never wins over another one; in a group without any, keep_id is null and its
    rows stay.  Repeated rows (same doc_id, same text) are all marked alike.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    norm = docs.select("doc_id", normalised().alias("norm"))
    keyed = settle(
        norm.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256")), "keyed"
    )
    index = build_index(docs, keyed.select("key").distinct(), path or new_path(spark, "exact-index"), capacity)
    # Two texts with the same key and the same SHA-256 would make this lookup ambiguous.
    texts = F.count("*").over(Window.partitionBy("key", "text_sha256"))
    entry = index.withColumn("texts", texts).select(
        "key",
        "text_sha256",
        "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts share a 64-bit key and a SHA-256")))
        .alias("group_size"),
    )
    found = keyed.join(entry, ["key", "text_sha256"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
