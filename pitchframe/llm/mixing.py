"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  A document of a source with target / size = 1.3 is
due 1.3 times: the whole part is certain, and the rest is an inclusion probability p.
For the rest, documents are ranked by random odds divided by inclusion odds,

    q = (u / (1 - u)) / (p / (1 - p)),      u in (0, 1) from a hash of doc_id,

(of doc_id, content and occurrence where a doc_id is null or repeated)
and the smallest q are taken until the source's missing words are reached.  Ranking is
not a sort of a source: log(q) is cut into cells, running sums over cells find the one
in which the target is crossed, and only that cell's documents are put in order.  So a
source that holds a third of all documents is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import WORD, settle, text_or_empty

CELLS_PER_UNIT = 512  # of log(q); one cell holds at most about 1/2,000 of a source
U_BITS = 52
EARLIER = (Window.unboundedPreceding, -1)


def occurrences(rows: DataFrame) -> DataFrame:
    """(row_no, occurrence) from 1 on among the rows (doc_id, content, part, row_no) that agree in doc_id and content.

    Such rows are the same, so any numbering will do: by part, behind the rows of earlier parts.
    """
    same = ["doc_id", "content"]
    parts = rows.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*same).orderBy("part").rowsBetween(*EARLIER))
    starts = parts.select(*[F.col(c).alias(f"_{c}") for c in (*same, "part")], F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*same, "part").orderBy("row_no"))
    there = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("content") == F.col("_content")) & (F.col("part") == F.col("_part"))
    return rows.withColumn("inside", inside).join(starts, there).select("row_no", (F.col("start") + F.col("inside")).alias("occurrence"))


def seed_keys(sized: DataFrame) -> DataFrame:
    """(row_no, key) of the rows whose doc_id is null or repeated: what tells them apart, however they are partitioned."""
    counts = sized.groupBy("doc_id").agg(F.count("*").alias("n"))
    several = counts.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"))
    rows = sized.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("content"), F.col("occurrence"))
    return rows.join(occurrences(rows.select("row_no", "doc_id", "content", "part")), "row_no").select("row_no", key.alias("key"))


def uniform(seed: int, key: str = "doc_id") -> Column:
    """A number in (0, 1) from the MD5 of seed and key; a null key counts as empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    whole = F.conv(F.substring(digest, 1, U_BITS // 4), 16, 10).cast("long")
    return (whole + F.lit(0.5)) / F.lit(float(2**U_BITS))


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): the numbers of ``cycle`` dealt to the sources by code point, null last.

    ``sources`` has one row per source, so the window is over that short list.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    numbers = F.array(*[F.lit(w) for w in cycle])
    return sources.select("source", F.element_at(numbers, place % len(cycle) + 1).alias("weight"))


def source_targets(weighted: DataFrame, share: float, ceiling: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): shares of ``share`` times all words.

    No target passes ``ceiling`` times the source's size; the excess goes to the others by
    weight.  In order of ceiling / weight the sources at their ceiling come first, so one
    pass of running sums over the list of sources finds the level of the others.
    """
    everyone = Window.partitionBy(F.lit(0))
    order = everyone.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(*EARLIER)
    total = F.sum("source_size").over(everyone)
    level = (F.lit(share) * total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    first_open = F.first(F.when(F.col("level") < F.col("fills_at"), F.col("level")), ignorenulls=True)
    return (
        weighted.withColumn("most", F.col("source_size") * F.lit(ceiling))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", first_open.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
        .drop("most", "fills_at", "level")
    )


def take_in_order(ranked: DataFrame, needs: DataFrame, nearest: bool) -> DataFrame:
    """Of ``ranked`` (row_no, source_no, size, q, content) the first by q that make up ``need`` words of ``needs``.

    ``nearest`` also takes the crossing document if that ends nearer to the need.
    Ties of q go by content, then by row_no, where it makes no difference.
    """
    ranked = ranked.withColumn("cell", F.floor(F.log("q") * CELLS_PER_UNIT))
    cells = ranked.groupBy("source_no", "cell").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source_no").orderBy("cell")
    # Crossed in the last cell that starts below the need.
    starts = cells.withColumn("start", F.coalesce(F.sum("words").over(running.rowsBetween(*EARLIER)), F.lit(0)))
    cut = (
        starts.join(needs, "source_no")
        .where(F.col("start") < F.col("need"))
        .groupBy("source_no", "need")
        .agg(F.max("cell").alias("cut"), F.max("start").alias("start"))
    )
    placed = ranked.join(cut, "source_no").where(F.col("cell") <= F.col("cut"))
    sure = placed.where(F.col("cell") < F.col("cut")).select("row_no", "source_no", "size")
    inside = Window.partitionBy("source_no").orderBy("q", "content", "row_no").rowsBetween(*EARLIER)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.lit(0.5 if nearest else 1.0)
    last = (
        placed.where(F.col("cell") == F.col("cut"))
        .withColumn("before", before)
        .where(F.col("before") + F.col("size") * part <= F.col("need"))
        .select("row_no", "source_no", "size")
    )
    return sure.unionByName(last)


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 20,
    row_no: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken, and row_no.

    ``weights`` is (source, weight) with a weight above 0 for every source, else the run
    fails; without it the weights 5, 2, 1 repeat.  size counts runs of anything but ASCII white space (null text: 0),
    copies is how often the mix takes the document, taken = copies * size, and ``row_no`` is
    the given column of distinct numbers, or made here.  The first pass
    takes documents while they fit; a second one fills the gap left by the first document
    that did not, from those small enough.  A null source is a source of its own.  Rows whose
    doc_id is null or repeated are told apart by a hash of their content (all plain columns but
    ``row_no``) and, where that agrees too, by number, so reruns over other partitions take the
    same documents.  Sources without words get target 0.  An empty table gives no rows.
    """
    plain = [c for c, kind in docs.dtypes if c != row_no and not kind.startswith(("map", "struct", "array", "variant"))]
    sized = settle(
        docs.select(
            (F.monotonically_increasing_id() if row_no is None else F.col(row_no)).alias("row_no"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(*[F.col(f"`{c}`") for c in sorted(plain)]).alias("content"),
            F.spark_partition_id().alias("part"),
        ),
        "mix-sizes",
    )
    keyed = sized.join(seed_keys(sized), "row_no", "left")
    key = F.coalesce("key", F.col("doc_id").cast("string"))
    sized = settle(keyed.withColumn("key", key).withColumn("u", uniform(seed, "key")).drop("key", "part"), "mix-drawn")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = cycled_weights(sizes) if weights is None else weights
    weighted = weighted.select(F.col("source").alias("of_source"), F.col("weight").cast("double").alias("weight"))
    usable = F.when(F.col("weight") > 0, F.col("weight")).otherwise(
        F.raise_error(F.lit("every source needs a weight above 0"))
    )
    listed = sizes.join(weighted, F.col("source").eqNullSafe(F.col("of_source")), "left").select(
        "source", "source_size", usable.alias("weight")
    )
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    sources = settle(
        source_targets(listed, share, ceiling)
        .withColumn("whole", F.floor(rate))
        .withColumn("p", rate - F.col("whole"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("source_no", number),
        "mix-sources",
    )
    known = sources.withColumnRenamed("source", "at_source")
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    all_docs = sized.join(known, sized["source"].eqNullSafe(known["at_source"])).drop("at_source")
    ranked = all_docs.where((F.col("p") > 0) & (F.col("size") > 0)).select("row_no", "source_no", "size", q.alias("q"), "content")
    needs = sources.select("source_no", "need")
    first = settle(take_in_order(ranked, needs, nearest=False), "mix-first")
    gaps = settle(
        needs.join(first.groupBy("source_no").agg(F.sum("size").alias("has")), "source_no", "left").select(
            "source_no", (F.col("need") - F.coalesce("has", F.lit(0))).alias("need")
        ),
        "mix-gaps",
    )
    small = (
        ranked.join(first.select("row_no"), "row_no", "left_anti")
        .join(gaps, "source_no")
        .where(F.col("size") <= F.col("need"))
        .drop("need")
    )
    more = take_in_order(small, gaps, nearest=True)
    extra = first.unionByName(more).select("row_no", F.lit(1).alias("extra"))
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    return all_docs.join(extra, "row_no", "left").select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row_no"
    )
