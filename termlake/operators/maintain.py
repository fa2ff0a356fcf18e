"""Adding documents to a corpus and removing them. Each change moves idf and the average length, so every impact: the index
is built again from the new corpus, in one distributed job, and nothing that was derived from the old one is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.storage import if_small


def added(docs: DataFrame, more: DataFrame, id_col: str = "id") -> DataFrame:
    """Both corpora; ValueError if an id is in both, or twice or null in the new one."""
    from termlake.sources.corpus import distinct_ids

    distinct_ids(more, id_col)
    clash = docs.select(id_col).join(if_small(more.select(id_col)), id_col, "left_semi").first()
    if clash is not None:
        raise ValueError(f"document {clash[0]!r} is there already")
    return docs.unionByName(more)


def removed(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The corpus without these ids; ValueError if one isn't there."""
    gone = ids.select(F.col(id_col)).distinct()
    missing = gone.join(docs.select(id_col), id_col, "left_anti").first()
    if missing is not None:
        raise ValueError(f"document {missing[0]!r} isn't there")
    return docs.join(if_small(gone), id_col, "left_anti")
