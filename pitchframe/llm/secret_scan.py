"""Secret scans with an incremental ledger of blobs.

Every text is a blob, named by its SHA-256.  The ledger holds two tables in the shared
folder: ``scanned`` (blob, kind, version) and ``findings`` (blob, kind, version, start,
end).  A scan looks only at pairs of blob and rule version that the ledger has not seen,
appends what it finds, and joins the findings back to every path that holds the blob, so
a text that thousands of paths share is scanned once, and a later version of the table
costs only its new texts.  A rule whose pattern changes gets a new version.

Only DataFrame operations are used.  Spark's functions give matches without positions;
these come from the lengths of the text between matches (``split`` with the same pattern).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import new_path, text_or_empty

PAIRS = "blob string, kind string, version int"
SPANS = f"{PAIRS}, start long, end long"


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds and their order.  A run of hex digits or of key characters
# that is too short contains no long enough one, so the least length may stand in the pattern.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
ADDED_RULES = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + ADDED_RULES


def blob_id() -> Column:
    return F.sha2(text_or_empty(), 256)


def unseen_blobs(paths: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, holder, todo): blobs with the kinds still to scan, and one doc_id that holds the text."""
    spark = paths.sparkSession
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    wanted = blobs.select("blob", "holder", F.inline(pairs))
    if has_table(spark, f"{ledger}/scanned"):
        scanned = spark.read.schema(PAIRS).parquet(f"{ledger}/scanned")
        wanted = wanted.join(scanned, ["blob", "kind", "version"], "left_anti")
    # At most one row per rule in a group.
    return wanted.groupBy("blob", "holder").agg(F.collect_set("kind").alias("todo"))


def has_table(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def matches(rule: Rule) -> Column:
    """Array of (kind, version, gap, size, holds) for every match in ``text``, else null.

    ``gap`` is the length of the text between the match before and this one; lengths count
    code points.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.split("text", rule.pattern, -1)
    found = F.regexp_extract_all("text", pattern, F.lit(0))

    def one(gap: Column, match: Column) -> Column:
        part = match if rule.group == 0 else F.regexp_extract(match, rule.pattern, rule.group)
        return F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            F.length(gap).cast("long").alias("gap"),
            F.length(match).cast("long").alias("size"),
            (F.length(part) >= rule.least).alias("holds"),
        )

    # One gap more than matches: the end of the text.
    measured = F.zip_with(F.slice(gaps, 1, F.size(found)), found, one)
    return F.when(F.array_contains("todo", rule.kind) & F.rlike("text", pattern), measured)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the unseen pairs of ``docs`` (doc_id, text, blob) and append to the ledger.

    Findings are written before the pairs count as scanned: a run that dies between the two
    scans them again, and readers drop the repeated findings.
    """
    spark = docs.sparkSession
    unseen = new_path(spark, "unseen-blobs")
    unseen_blobs(docs.select("doc_id", "blob"), ledger, rules).write.parquet(unseen)
    todo = spark.read.schema("blob string, holder long, todo array<string>").parquet(unseen)
    holds = docs["doc_id"].eqNullSafe(todo["holder"]) & (docs["blob"] == todo["blob"])
    texts = docs.join(todo, holds).select(todo["blob"], text_or_empty().alias("text"), "todo")
    rows = texts.select(
        "blob", F.monotonically_increasing_id().alias("copy"), F.array(*[matches(r) for r in rules]).alias("by_rule")
    )
    found = rows.select("blob", "copy", F.explode("by_rule").alias("all")).where("all IS NOT NULL")
    each = found.select("blob", "copy", F.posexplode("all").alias("place", "m")).select(
        "blob", "copy", "place", "m.*"
    )
    upto = Window.partitionBy("blob", "copy", "kind").orderBy("place")
    ends = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    spans = ends.where("holds").select(
        "blob", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end"
    )
    spans.write.mode("append").parquet(f"{ledger}/findings")
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    done = todo.select("blob", F.explode("todo").alias("kind"))
    done.select("blob", "kind", F.element_at(version, F.col("kind")).alias("version")).write.mode("append").parquet(
        f"{ledger}/scanned"
    )


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, blob, and ``spans``, the findings of its text.

    ``spans`` is an array of (start, kind_no, kind, end) in order of start, then of the rules;
    positions count code points, the end is exclusive.  A null text counts as empty; null or
    repeated doc_ids and repeated rows each get their findings.  Other columns are ignored;
    an empty table gives no rows.  ``ledger`` is a folder that is kept between runs (a new one
    by default): what it has seen is not scanned again.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", blob_id().alias("blob"))
    scan(docs, ledger, rules)
    numbers = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (f"{r.kind} {r.version}", n)])
    findings = (
        spark.read.schema(SPANS)
        .parquet(f"{ledger}/findings")
        .withColumn("kind_no", F.try_element_at(numbers, F.concat_ws(" ", "kind", "version")))
        .where("kind_no IS NOT NULL")
    )
    # One text's findings: bounded by the text.
    by_blob = findings.groupBy("blob").agg(
        F.array_sort(F.collect_set(F.struct("start", "kind_no", "kind", "end"))).alias("spans")
    )
    return (
        docs.select("doc_id", "blob")
        .join(by_blob, "blob", "left")
        .select("doc_id", "blob", F.coalesce("spans", F.array().cast(by_blob.schema["spans"].dataType)).alias("spans"))
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
