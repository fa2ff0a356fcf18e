"""Ranked search as joins, sums and a ranking.

A query is a bag of terms: one that it repeats counts again. Candidates are the documents with any of its terms. Results are
ordered by score (rounded to 9 digits), then by document id. Scores are summed exactly (``exact_sum``), so the order of a sum's parts doesn't matter.

The terms of all queries, with their statistics, are the small side: they are broadcast where a count finds them small, and
postings of other terms are never shuffled. Those of their terms are shuffled once, by document and before each becomes a row for every query
that asks for it, into as many partitions as the terms' document frequencies call for: so what a task sums up and sorts doesn't grow with the
corpus. For the ranking at most k rows a query come from each partition. With stored impacts (an index that was saved) scoring is a sum of a column, times the idf that a query's
term brings; otherwise, and for other parameters than the index has, the same score is computed from counts and lengths.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.operators.index import LexicalIndex, doc_totals, idf, impact
from termlake.params import BM25Params, checked_k
from termlake.storage import BROADCAST_ROWS, if_small, parts, stored

DIGITS = 6


def query_terms(queries: DataFrame, analyzer: T.Analyzer = T.Analyzer()) -> DataFrame:
    """``query_id, term, qtf`` from ``query_id, query``; nothing for queries that are null, empty or all stop words."""
    runs = queries.select("query_id", F.explode(T.term_runs(analyzer.terms(F.col("query")))).alias("run"))
    each = runs.select("query_id", T.run_term(F.col("run")).alias("term"), T.run_count(F.col("run")).alias("qtf"))
    return each.groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))


def matches(index: LexicalIndex, asked: DataFrame, params: BM25Params | None = None) -> DataFrame:
    """``query_id, doc_id, term, qtf, impact``: the postings that queries touch."""
    if index.eager and params in (None, index.params):
        known = asked.join(index.term_stats.select("term", "idf"), "term")
        found = index.weights.select("term", "doc_id", "weight").join(if_small(known), "term")
        return found.select("query_id", "doc_id", "term", "qtf", (F.col("idf") * F.col("weight")).alias("impact"))
    p = params or index.params
    known = asked.join(index.term_stats.select("term", "idf"), "term").crossJoin(F.broadcast(index.corpus_stats.select("avgdl")))  # one row
    counts = index.counts if index.counts is not None else index.weights.select("term", "doc_id", "tf", "dl")
    joined = counts.join(if_small(known), "term")
    return joined.select("query_id", "doc_id", "term", "qtf", impact(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"), p).alias("impact"))


def known_terms(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """``query_id, term, qtf, df, idf`` of those terms of queries that the index has. Where an index has no stored statistics, only these terms are counted."""
    if index.counts is None or index.kept:
        stats = index.term_stats.select("term", "df", "idf")
    else:
        held = index.counts.select("term").join(if_small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        n = F.broadcast(doc_totals(index.doc_stats).select("num_docs"))  # one row
        stats = held.crossJoin(n).select("term", "df", idf(F.col("num_docs"), F.col("df")).alias("idf"))
    return asked.join(stats, "term").select("query_id", "term", "qtf", "df", "idf")


def touched(index: LexicalIndex, known: DataFrame, columns: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, qtf, idf`` and ``columns`` of the postings that queries touch, all rows of a document in one partition.

    ``known``: from ``known_terms``; it is used several times. With ``pairs`` (query_id, doc_id), each of them is a row too, with ``given`` = 1 and no posting.
    """
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("rows")).first()
    rows = size.rows + (0 if pairs is None else pairs.count())
    source = (index.weights if index.counts is None else index.counts).select("term", "doc_id", *columns)
    small = size.n <= BROADCAST_ROWS
    terms = known.select("query_id", "term", "qtf", "idf")
    if small:  # a row for each query only after the shuffle
        found = source.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").withColumn("query", F.lit(None).cast(known.schema["query_id"].dataType))
    else:
        found = source.join(terms.withColumnRenamed("query_id", "query"), "term")
    if pairs is not None:
        found = found.unionByName(pairs.select(F.col("query_id").alias("query"), "doc_id", F.lit(1).alias("given")), allowMissingColumns=True)
    found = found.repartition(parts(index.spark, rows), "doc_id")
    if not small:
        return found.withColumnRenamed("query", "query_id").drop("term")
    joined = found.join(F.broadcast(terms), "term", "inner" if pairs is None else "left")
    return joined.withColumn("query_id", F.coalesce("query_id", "query")).drop("query", "term")


def candidates(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """``query_id, doc_id`` of the documents with any of the terms."""
    return touched(index, stored(known_terms(index, asked)), []).select("query_id", "doc_id").distinct()


def exact_sum(x: Column) -> Column:
    """Sum that is the same in any order: of whole 2**-20 and of 2**-60 parts, both as whole numbers. A sum of doubles differs in its last bit
    with the order in which parts arrive, and where it lies between two roundings, equal documents would change places."""
    scaled = x * 2.0**20
    whole = F.floor(scaled)
    rest = F.rint((scaled - whole) * 2.0**40).cast("bigint")
    return F.sum(whole) / F.lit(2.0**20) + F.sum(rest) / F.lit(2.0**60)


def scores(index: LexicalIndex, asked: DataFrame, params: BM25Params | None = None) -> DataFrame:
    """``query_id, doc_id, score`` of all candidates."""
    return known_scores(index, stored(known_terms(index, asked)), params)


def known_scores(index: LexicalIndex, known: DataFrame, params: BM25Params | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """As ``scores``, of terms from ``known_terms``; with ``pairs``, of just these, 0 where a document has no term."""
    if index.eager and params in (None, index.params):
        rows, part = touched(index, known, ["weight"], pairs), F.col("idf") * F.col("weight")
    else:
        stats = index.corpus_stats if index.counts is None else doc_totals(index.doc_stats)
        rows = touched(index, known, ["tf", "dl"], pairs).crossJoin(F.broadcast(stats.select("avgdl")))  # one row
        part = impact(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"), params or index.params)
    score = exact_sum(F.col("qtf") * part)
    grouped = rows.groupBy("query_id", "doc_id")
    if pairs is None:
        return grouped.agg(score.alias("score"))
    return grouped.agg(F.coalesce(score, F.lit(0.0)).alias("score"), F.max("given").alias("given")).where("given = 1").drop("given")


def best_first(*more: str) -> list[Column]:
    return [F.round("score", 9).desc(), *map(F.col, more or ("doc_id",))]


def top(scored: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, doc_id, score``: the k best of each query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first()))
    ranked = scored.withColumn("rank", place).where(F.col("rank") <= checked_k(k))
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", DIGITS).alias("score"))


def search_batch(index: LexicalIndex, queries: DataFrame, k: int = 10, exclude: DataFrame | None = None, params: BM25Params | None = None) -> DataFrame:
    """``query_id, rank, doc_id, score`` for all queries (query_id, query) in one job.

    ``exclude`` (query_id, doc_id): pairs that were seen and don't come again. A query without terms has no rows.
    """
    checked_k(k)
    scored = scores(index, query_terms(queries, index.analyzer), params)
    if exclude is not None:
        scored = scored.join(exclude.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top(scored, k)


def search(index: LexicalIndex, query: str | None, k: int = 10, exclude: DataFrame | None = None, params: BM25Params | None = None) -> DataFrame:
    """``rank, doc_id, score`` for one query. Its terms go to the scan as a filter; ``exclude`` has ``doc_id``."""
    checked_k(k)
    spark = index.spark
    weights = {r.term: r.qtf for r in query_terms(spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query")), index.analyzer).collect()}
    listed = F.col("term").isin(*weights)
    asked = spark.createDataFrame([(0, t, q) for t, q in weights.items()], "query_id int, term string, qtf bigint")
    some = lambda df: None if df is None else df.where(listed)
    narrow = replace(index, postings=some(index.postings), term_stats=some(index.term_stats), counts=some(index.counts), weights=some(index.weights))
    known = known_terms(narrow, asked)
    known = spark.createDataFrame(known.collect(), known.schema)  # at most the terms of one query
    scored = known_scores(narrow, known, params).select("doc_id", "score")
    if exclude is not None:
        scored = scored.join(exclude.select("doc_id"), "doc_id", "left_anti")
    found = scored.orderBy(*best_first()).limit(k)
    place = F.row_number().over(Window.orderBy(*best_first()))  # over at most k rows
    return found.select(place.cast("bigint").alias("rank"), "doc_id", F.round("score", DIGITS).alias("score"))


def search_pruned(index: LexicalIndex, query: str | None, k: int = 10) -> DataFrame:
    """As ``search``, with upper bounds: postings of terms that can't bring a document among the ``k`` best by themselves are read only for
    documents that have another term.

    The k-th best impact of the term with the highest bound is a score that k documents reach. Terms whose bounds add up to less are not
    essential: a document without any other term stays below it. The results are the same; what is saved is the shuffle of the
    frequent terms' postings.
    """
    checked_k(k)
    spark = index.spark
    asked = query_terms(spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query")), index.analyzer)
    bounds = sorted((r.bound, r.term, r.qtf) for r in asked.join(index.term_stats, "term").select("term", "qtf", (F.col("qtf") * F.col("max_impact")).alias("bound")).collect())
    if len(bounds) < 2:
        return search(index, query, k)
    schema = "query_id int, term string, qtf bigint"
    part = lambda rows: matches(index, spark.createDataFrame([(0, t, q) for _, t, q in rows], schema)).where(F.col("term").isin(*[t for _, t, _ in rows])).select("doc_id", (F.col("qtf") * F.col("impact")).alias("score"))
    best = part(bounds[-1:]).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    reached = best.least - 1e-8 if best.n == k else 0.0
    idle, total = 0, 0.0
    while idle < len(bounds) - 1 and (total := total + bounds[idle][0]) < reached:
        idle += 1
    rows = part(bounds[idle:])
    if idle:
        wanted = rows.select("doc_id").distinct()
        rows = rows.unionByName(part(bounds[:idle]).join(if_small(wanted), "doc_id", "left_semi"))
    found = rows.groupBy("doc_id").agg(exact_sum(F.col("score")).alias("score")).orderBy(*best_first()).limit(k)
    place = F.row_number().over(Window.orderBy(*best_first()))  # over at most k rows
    return found.select(place.cast("bigint").alias("rank"), "doc_id", F.round("score", DIGITS).alias("score"))


def with_documents(found: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Results with the documents' columns, fetched for the results only; results whose document is gone drop out."""
    return docs.withColumnRenamed(id_col, "doc_id").join(if_small(found), "doc_id")


def ranked(scored: DataFrame) -> DataFrame:
    """``query_id, rank, doc_id, score``: all rows of each query in order.

    All rows are sorted by ranges of (query, order), and the rows that a query has in the ranges before are added to a row's place: so a query
    with however many rows is no single task.
    """
    held = stored(scored.withColumn("rounded", F.round("score", 9)))  # else each comparison of a sort rounds again
    order = [F.col("query_id"), F.desc("rounded"), F.col("doc_id")]
    spread = held.repartitionByRange(parts(held.sparkSession, held.count()), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = stored(spread.select("query_id", "doc_id", "score", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("nth")))
    each = placed.groupBy("query_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))  # a row for each query and part
    sums = F.sum("n").over(Window.partitionBy("query_id").orderBy("part"))
    before = stored(each.select(F.col("query_id").alias("of"), F.col("part").alias("at"), (sums - F.col("n") - F.col("first") + 1).alias("shift")))
    joined = placed.join(if_small(before), F.col("query_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return joined.select("query_id", (F.col("nth") + F.col("shift")).alias("rank"), "doc_id", F.round("score", DIGITS).alias("score"))


def rank_documents(index: LexicalIndex, queries: DataFrame, pairs: DataFrame, params: BM25Params | None = None) -> DataFrame:
    """``query_id, rank, doc_id, score`` of the given pairs (query_id, doc_id), all of them: without any term the score is 0."""
    known = stored(known_terms(index, query_terms(queries, index.analyzer)).where("query_id IS NOT NULL"))
    return ranked(known_scores(index, known, params, pairs.select("query_id", "doc_id")))


def explain(index: LexicalIndex, queries: DataFrame, pairs: DataFrame, params: BM25Params | None = None) -> DataFrame:
    """``query_id, doc_id, term, term_score``: what each distinct term of the query adds once to the document's score, 0 for terms
    that the document hasn't or nobody knows."""
    asked = query_terms(queries, index.analyzer)
    wanted = pairs.select("query_id", "doc_id").distinct().join(asked.select("query_id", "term"), "query_id")
    parts = matches(index, asked, params).select("query_id", "doc_id", "term", "impact")
    joined = wanted.join(parts, ["query_id", "doc_id", "term"], "left")
    return joined.select("query_id", "doc_id", "term", F.round(F.coalesce("impact", F.lit(0.0)), DIGITS).alias("term_score"))


def posting_list(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` of the given terms; nothing for unknown ones."""
    source = index.weights if index.counts is None else index.counts
    return source.select("term", "doc_id", "tf").join(if_small(terms.select("term").distinct()), "term", "left_semi")


def term_lookup(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """``term, df, idf`` of the given terms; 0 for unknown ones."""
    known = index.term_stats.select("term", "df", "idf")
    return terms.select("term").distinct().join(known, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("idf", F.lit(0.0)).alias("idf"))


def frequency_lookup(index: LexicalIndex, pairs: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` of the given pairs (term, doc_id); 0 where the document hasn't the term."""
    wanted = pairs.select("term", "doc_id").distinct()
    return wanted.join(posting_list(index, wanted), ["term", "doc_id"], "left").select("term", "doc_id", F.coalesce("tf", F.lit(0)).alias("tf"))


def documents_by_id(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(if_small(ids.select(id_col).distinct()), id_col, "left_semi")
