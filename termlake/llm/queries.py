"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm import chat, exact_dedup, lm_scoring, minhash, packing, pii, quality_model, quality_rules, sentencepiece_codec, warc
from termlake.llm.common import qualified
from termlake.storage import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, with the three probabilities."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return scored.where("quality >= 0.5").select("doc_id", "evidence", "prior", "quality")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, with their measures."""
    return quality_rules.keep(table(spark, sf_dir, "documents"), measures=True)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as a log of events, with drafts, edits, regenerations and repeats, folded into conversations and rendered."""
    return chat.conversations(chat.log_of(table(spark, sf_dir, "conversations")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, written as compressed archives to the shared folder, as the reader finds them there."""
    folder = qualified(spark, new_folder(spark, "warc"))
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark, folder)
    return found.select(F.col("headers")["x-page-id"].cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), F.col("content").cast("string").alias("html"), "error")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_quality_classifier, op4_quality_rules, op5_chat, op6_sentencepiece, op7_minhash, op8_pii, op9_warc, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, duplicate_of FROM (
              SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of,
                     row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth
              FROM documents WHERE text IS NOT NULL)
            WHERE nth > 1""",
        "op4_quality_rules": quality_rules.SQL,
        "op5_chat": chat.SQL,
        "op9_warc": "SELECT page_id, url, html, CAST(NULL AS VARCHAR) AS error FROM pages",
    }
