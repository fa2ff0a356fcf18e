"""The corpus pipeline: stages in order, each over all that its predecessor kept.

A stage takes the session, the documents so far and the folder of the tables, and returns documents with the same
columns, but for the last, which returns packed sequences. Between two stages the documents are written as Parquet
to the shared folder and read again, so a lost executor costs at most part of one stage.

Documents without a text (null), or without words, are rejected by the classifier, so later stages see none of these. Rows that agree in
everything are exact copies: one stays. Ids may be null or repeat; of copies the one with the smallest id stays, null being largest. Texts of any
length go through whole. Columns beside those of ``documents`` stay through all stages but the last, whatever their names. Empty tables give
no windows; without labels the classifier rejects no text that has words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termlake.llm import exact_dedup, minhash, packing, pii, quality_model
from termlake.storage import new_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the one with the smallest id stays."""
    return minhash.near_dedup(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens for training."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("pii", private), ("packing", packed)]

#: SQL can't express the classifier, the sketches, the checksums' context or the tokenizer. Tests hold each stage against plain Python: the
#: classifier's score and the PII candidates in the tests of those operators, the others here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
