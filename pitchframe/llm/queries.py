"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm import sql
from pitchframe.llm.alignment import align_tokens
from pitchframe.llm.common import new_path, table
from pitchframe.llm.conversations import repair_conversations
from pitchframe.llm.decontamination import contaminated, question_and_answer
from pitchframe.llm.exact_dedup import exact_dedup
from pitchframe.llm.inner_products import top_inner_products
from pitchframe.llm.language_id import identify_languages
from pitchframe.llm.mixing import mix
from pitchframe.llm.near_dups import near_duplicates
from pitchframe.llm.repeats import remove_repeats
from pitchframe.llm.secret_scan import BASE_RULES, find_secrets, span_list
from pitchframe.llm.token_counts import count_tokens
from pitchframe.llm.token_files import read_token_files, write_token_files
from pitchframe.llm.url_filter import any_bad, judge_urls

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

# Public suffixes of two labels under which many sites register a name of their own.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "edu.au", "net.au", "org.au", "co.nz", "org.nz", "ac.jp", "co.jp", "ne.jp",
    "or.jp", "com.br", "org.br", "com.cn", "org.cn", "co.in", "org.in", "co.kr", "or.kr", "co.za", "org.za", "com.ar", "com.mx",
    "com.tr", "com.tw", "com.hk", "com.sg", "co.il", "com.ua",
)

Query = Callable[[SparkSession, str], DataFrame]


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    question, answer = question_and_answer(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", question.alias("question"), answer.alias("answer"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the items."""
    found = contaminated(table(spark, sf_dir, "documents"), benchmark_items(spark, sf_dir))
    shares = [F.round(c, 6).alias(c) for c in ("question_overlap", "answer_overlap")]
    return found.select("doc_id", "item_id", *shares)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2, vocabulary=50_257)
    return read_token_files(spark, path)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the page's number; toxic or low-quality pages are bad."""
    bad = any_bad(F.col("toxic") == 1, F.col("quality") == 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, outcomes, URL_RULES, SUFFIXES).select("page_id", "host", "path", "rule", "verdict")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind_no"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(rule.kind) for rule in BASE_RULES],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
    )


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align_tokens(table(spark, sf_dir, "documents"), *paths)


def op12_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024.0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_near_dups": op8_near_dups,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_token_alignment": op11_token_alignment,
    "op12_inner_products": op12_inner_products,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = sql.STATEMENTS
