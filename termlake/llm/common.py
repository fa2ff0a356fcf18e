"""What the operators share: scratch storage on shared disk, private column names, row numbers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves a local master; on a cluster that is an error,
    since a folder of one machine can't be read by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="termlake-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Hadoop takes it to be on, as libraries other than Spark need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept on shared storage, with its partitions and their order, so that it
    survives the loss of executors. The files stay, unless ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on: then
    they go when the result is no longer referenced."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Plans that yield their rows in the same places each time: tables and checkpoints, read, cut to columns and filtered.
_STEADY = {"LogicalRelation", "Relation", "DataSourceV2ScanRelation", "LogicalRDD", "LocalRelation", "Project", "Filter", "Range", "SerializeFromObject", "ExternalRDD"}


def steady(df: DataFrame) -> DataFrame:
    """``df`` itself if it is read as it lies; any other plan, whose rows may come in another order the next time, is stored."""
    held = [df._jdf.queryExecution().optimizedPlan()]
    while held:
        node = held.pop()
        if node.nodeName().split(" ")[0] not in _STEADY:
            return settled(df)
        below = node.children()
        held += [below.apply(i) for i in range(below.size())]
    return df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row. It depends on the place of the row in its partition, so ``df``
    should be a stored table or another plan that yields its rows in the same order each time."""
    return df.withColumn(name, F.monotonically_increasing_id())


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
