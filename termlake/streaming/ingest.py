"""Streaming ingest: documents that arrive become searchable, a micro-batch at a time.

A batch writes its documents' terms to a folder of its own, named by the batch, which a retry overwrites: so each batch counts once.
Statistics of the whole corpus move with every batch, so impacts aren't stored: a search reads counts, and sums up totals and document
frequencies of what has arrived. ``compact`` merges what is there into one table, so that a search doesn't go through every batch
again; batches that come later are read beside it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termlake.functions.text import Analyzer
from termlake.operators.index import LexicalIndex, _complete, doc_runs, term_counts
from termlake.params import BM25Params
from termlake.storage import if_small, stored


def ingest(stream: DataFrame, folder: str, checkpoint: str, id_col: str = "id", title_col: str | None = "title", content_col: str = "content", watermark: tuple[str, str] | None = None, analyzer: Analyzer = Analyzer(), **trigger) -> StreamingQuery:
    """Starts the stream. ``watermark`` (time column, delay): documents sent again within the delay are taken once.

    ``trigger``: for ``DataStreamWriter.trigger``; by default all that is there, then the stream ends.
    """
    if watermark:
        stream = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([id_col])

    def append(batch: DataFrame, number: int) -> None:
        doc_runs(batch, id_col, title_col, content_col, analyzer).write.mode("overwrite").parquet(f"{folder}/runs/batch={number}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the subfolders ``name=number``, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{name}="))


def _latest(spark: SparkSession, folder: str) -> tuple[DataFrame | None, list[int], int]:
    """``doc_id, dl, runs, batch`` of the last batch with each document, the batches that aren't compacted, and the last of all."""
    upto = max(_numbers(spark, f"{folder}/compacted", "upto"), default=-1)
    newer = [n for n in _numbers(spark, f"{folder}/runs", "batch") if n > upto]
    parts = [spark.read.parquet(f"{folder}/compacted/upto={upto}")] if upto >= 0 else []
    if newer:
        parts.append(spark.read.option("basePath", f"{folder}/runs").parquet(*[f"{folder}/runs/batch={n}" for n in newer]).withColumn("batch", F.col("batch").cast("bigint")))
    if not parts:
        return None, [], -1
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _last_of_each(rows) if newer else rows, newer, max([upto, *newer])


def _last_of_each(rows: DataFrame) -> DataFrame:
    """The row of the last batch for each document. Only ids are compared, and only documents that came several times are shuffled."""
    several = stored(rows.groupBy(F.col("doc_id").alias("twice")).count().where("count > 1").select("twice"))
    if several.isEmpty():
        return rows
    same, several = F.col("doc_id").eqNullSafe(F.col("twice")), if_small(several)
    last = rows.join(several, same, "left_semi").groupBy("doc_id").agg(F.max_by(F.struct("dl", "runs"), "batch").alias("x"), F.max("batch").alias("batch"))
    return rows.join(several, same, "left_anti").unionByName(last.select("doc_id", "x.*", "batch"))


def compact(spark: SparkSession, folder: str) -> int:
    """Merges all that has arrived into one table, and drops the batches that are in it; the number of batches merged.

    The table gets its name when it is whole. A search that has begun on the old files must have ended.
    """
    latest, newer, last = _latest(spark, folder)
    if latest is None or not newer:
        return 0
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    latest.write.parquet(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f"compacted/upto={n}" for n in _numbers(spark, f"{folder}/compacted", "upto")]
    system.mkdirs(path(f"{folder}/compacted"))
    if not system.rename(path(draft), path(f"{folder}/compacted/upto={last}")):
        raise OSError(f"{draft} can't be renamed")
    for name in old + [f"runs/batch={n}" for n in newer]:
        system.delete(path(f"{folder}/{name}"), True)
    return len(newer)


def arrived(spark: SparkSession, folder: str, params: BM25Params = BM25Params(), analyzer: Analyzer = Analyzer()) -> LexicalIndex:
    """The index of what has arrived; of several documents with an id the one of the latest batch counts. Before the first batch it is empty.

    ``analyzer``: what the documents were taken in with."""
    latest, _, _ = _latest(spark, folder)
    if latest is None:
        latest = spark.createDataFrame([], "doc_id string, dl bigint, runs array<string>")
    return _complete(term_counts(latest), latest.select("doc_id", "dl"), params, analyzer=analyzer)
