"""Shared storage for what a job keeps between steps, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this number of rows, and joined by shuffle beyond it.
BROADCAST_ROWS = 500_000
#: About as many rows are sorted or summed up in one task; a step over more of them takes more partitions, not larger ones.
TASK_ROWS = 1_000_000


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for a step over so many rows: at most ``TASK_ROWS`` each, and the session's number unless that makes tiny ones."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // TASK_ROWS), min(usual, -(-rows // max(1, TASK_ROWS // 50))))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors see.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="termlake-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a folder in the shared one. It stays there until ``clean``: tables that are read from it may be used at any time."""
    _made.append(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> int:
    """Deletes the folders that ``new_folder`` named in this process, when nothing that was computed in them is needed any more; their number."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet, in the shared folder unless a path is given, and read again: later steps neither
    compute it again nor depend on the executors that did."""
    path = path or new_folder(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    The count stops at the limit. Meant for sides that are cheap to compute, or stored.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
