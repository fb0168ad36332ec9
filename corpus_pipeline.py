"""From raw documents to token files: language, near copies, leaks, mix, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import new_path, scratch, settle
from pitchframe.llm.decontamination import contaminated
from pitchframe.llm.language_id import UNKNOWN, learnable, predict, train
from pitchframe.llm.mixing import mix
from pitchframe.llm.near_dups import near_duplicates
from pitchframe.llm.queries import benchmark_items
from pitchframe.llm.token_files import read_token_files, write_token_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_KNOWN = 0.6  # of a text's words and long n-grams to its language, for it to be kept
ROW, ROW_AT = "_row", "_row_at"

# Language ID learns from the data, which SQL cannot express.
ORACLE_SQL = None


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, so that null and repeated doc_ids keep apart.

    Numbers follow from the place of a row in its files: every scan of one frame gives the same.
    ``ROW_AT`` tells the place itself, and ``chosen`` compares it.
    """
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW), place.alias(ROW_AT))


def of_files(docs: DataFrame) -> DataFrame:
    """``docs`` as a scan of files, which it is between stages."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return settle(docs.select(*COLUMNS), "rows")


def by_number(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` by ``rows`` (ROW and ROW_AT, of another scan), joined by number."""
    there = rows.withColumnRenamed(ROW_AT, "_there")
    same = F.when(F.col(ROW_AT) == F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.lit("the rows were numbered otherwise")))
    return docs.join(there, ROW).where(same).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters and those of which the winning language knows less than LEAST_KNOWN.

    Where nothing could be learned, texts with a letter stay.
    """
    docs = docs.select(*COLUMNS)
    model = train(learnable(docs))
    if not model:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    judged = predict(docs, model, COLUMNS, with_known=True)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= LEAST_KNOWN)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the shingles) the row with the smallest doc_id stays."""
    docs = numbered(of_files(docs))
    stays = new_path(spark, "stays")
    with scratch(spark, "near-copies"):
        groups = near_duplicates(by_number(docs), percent=80, bands=60, rows=8).select(
            F.col("doc_id").alias(ROW), F.col("component_id").alias("group")
        )
        order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), ROW, ROW_AT)
        firsts = docs.select(ROW, ROW_AT, "doc_id").join(groups, ROW).groupBy("group").agg(F.min(order).alias("first"))
        rows = settle(firsts.select(f"first.{ROW}", f"first.{ROW_AT}"), "stays", stays)
    return chosen(docs, rows)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = numbered(of_files(docs))
    leaks = contaminated(by_number(docs), benchmark_items(spark, sf_dir)).select(F.col("doc_id").alias(ROW)).distinct()
    rows = docs.select(ROW, ROW_AT).join(leaks, ROW, "left_anti")
    return chosen(docs, settle(rows, "clean"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    docs = numbered(of_files(docs))
    taken = new_path(spark, "taken")
    with scratch(spark, "mixture"):
        copies = mix(docs.drop(ROW_AT), row_no=ROW).where("copies > 0").select(F.col("row_no").alias(ROW), "copies")
        rows = settle(docs.select(ROW, ROW_AT).join(copies, ROW), "taken", taken)
    each = rows.select(ROW, ROW_AT, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return chosen(docs, each)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; return every document's place in them."""
    path = new_path(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, vocabulary=50_257)
    return read_token_files(spark, path)


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
