"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of characters. The distinct blocks are sorted, within hash buckets, and each
gets its rank as an integer name, which its occurrences take over. Then adjacent names are paired, and each distinct pair is named
by its rank in the same way, until each document has a single name. Two documents finish in the same round under
the same name if and only if their texts are equal: names are ranks, so there are no collisions. A digest of a block only stands in for it
between the step that makes blocks distinct and the one that hands out names; digests that two different blocks share are found
there, by comparing the blocks, and those blocks get names of their own.

Blocks are made distinct on each partition before they are shuffled, and so are pairs: one that a third of all documents have is a row from
each partition. Names go back to occurrences by a join with one row a name, whose other side may be skewed and is split at run time; its
rows have a few integers. Documents leave as soon as they have one name, so a later round holds only the longer documents: half of the
names at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.llm.common import fresh, numbered, quoted, settled, steady
from termlake.storage import if_small

BLOCK_CHARS = 1024
#: Ranks are taken within buckets: a sort group holds few names, and none has to be gathered in one task.
BUCKETS = 1 << 22
#: Rows to drop are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_ROWS = 2_000_000


def _digest(block: Column) -> list[Column]:
    return [F.xxhash64(block), F.xxhash64(F.lit("again"), block)]


def _named(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``name``: bucket and rank of their values in ``by`` as one integer; equal exactly where all of these are equal."""
    kinds = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))  # summed on each partition first
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*by))
    names = kinds.select(*by, (F.shiftleft(bucket, 40) + rank.cast("bigint")).alias("name"))
    return rows.join(names, list(by))


def _first_names(blocks: DataFrame) -> DataFrame:
    """``row, doc, n, pos, name`` from ``row, doc, n, pos, block``."""
    a, b = _digest(F.col("block"))
    marked = blocks.withColumns({"d": a, "e": b})
    distinct = marked.select("d", "e", "block").distinct()
    shared = settled(distinct.groupBy("d", "e").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("d", "e"))
    if shared.isEmpty():
        return _named(marked.select("row", "doc", "n", "pos", "d", "e"), "d", "e")
    both = distinct.join(if_small(shared), ["d", "e"], "left_semi")
    nth = both.withColumn("nth", F.row_number().over(Window.partitionBy("d", "e").orderBy("block")))
    told = marked.join(if_small(nth), ["d", "e", "block"], "left")
    return _named(told.select("row", "doc", "n", "pos", "d", "e", F.coalesce("nth", F.lit(0)).alias("nth")), "d", "e", "nth")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row, doc, round, name`` for each row of ``docs`` whose text isn't null.

    (round, name) is the same for two rows if and only if their texts are. ``row`` numbers the rows as
    ``common.numbered`` does. An empty text is a text like any other: one empty block. The length of a text has no
    limit but that of a string. Rows are told apart by ``row``, so ids may repeat or be null. Columns other than the
    two named are ignored. An empty table gives an empty result.
    """
    rows = numbered(docs.select(quoted(id_col).alias("doc"), quoted(text_col).cast("string").alias("text")), "row").where("text IS NOT NULL")
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = rows.select("row", "doc", cut.alias("blocks")).select("row", "doc", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    names = settled(_first_names(blocks).select("row", "doc", "n", "pos", "name"))
    done, at = [], 0
    while True:
        done.append(names.where("n = 1").select("row", "doc", F.lit(at).alias("round"), "name"))
        left = names.where("n > 1")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        odd = F.expr("pos % 2 = 1")
        pairs = left.groupBy("row", F.expr("cast(pos div 2 as int)").alias("pos")).agg(
            F.max("doc").alias("doc"),
            F.max(F.expr("cast((n + 1) div 2 as int)")).alias("n"),
            F.max(F.when(~odd, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(0)).alias("b"),
        )
        names = settled(_named(settled(pairs), "a", "b").select("row", "doc", "n", "pos", "name"))
        at += 1


def _redundant(named: DataFrame) -> DataFrame:
    """``row, doc, first`` of all rows but the first of each identity; the first is found by partial minima."""
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "row")
    firsts = named.groupBy("round", "name").agg(F.min(place).alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1")
    joined = named.join(firsts.select("round", "name", F.col("x.doc").alias("first"), F.col("x.row").alias("first_row")), ["round", "name"])
    return joined.where("row <> first_row").select("row", "doc", "first")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, duplicate_of``: each row whose text an earlier row has too, and the id of the first such row.

    Of rows with the same text the first is the one with the smallest id; null ids come last, and rows that agree
    in both go by their place in the table. A row repeated as a whole is a copy too (then both columns are equal).
    Rows with a null text are neither copies nor copied. Other columns don't matter. An empty table gives an empty result.
    """
    return _redundant(identities(docs, id_col, text_col, block_chars)).select(F.col("doc").alias("doc_id"), F.col("first").alias("duplicate_of"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, all columns, without the rows that ``copies`` lists; rows with a null text stay.

    Rows are told apart by their places, so ``docs`` is stored first unless it is read as it lies (``common.steady``).
    """
    docs = steady(docs)
    (row,) = fresh(docs, "row")
    drop = settled(_redundant(identities(docs, id_col, text_col, block_chars)).select(F.col("row").alias(row)))
    return numbered(docs, row).join(if_small(drop, BROADCAST_ROWS), row, "left_anti").drop(row)
