"""Retrieval quality and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.operators.index import LexicalIndex, build
from termlake.params import checked_k
from termlake.storage import if_small, stored


def verbatim_judgments(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LexicalIndex | None = None) -> DataFrame:
    """``query_id, doc_id`` where the document holds the query's text as it is.

    A document that does has all terms of the query but those at its two ends, which may be parts of words there. So the documents of the
    rarest such term are compared with the query, and no others. A query without one (a word or two) is compared with all. ``index``:
    of these documents, with any parameters and an analyzer without a normalizer; by default one is made.
    """
    wanted = queries.where(F.length("query") > 0).select("query_id", "query")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if index is None:
        index = build(texts, "doc_id", None, "text", check_ids=False)
    word = r"[\p{L}\p{N}_]+"
    inner = wanted.withColumn("term", F.explode_outer(F.array_distinct(index.analyzer.terms(F.regexp_replace("query", f"^{word}|{word}$", " ")))))
    known = inner.where("term IS NOT NULL").join(index.term_stats.select("term", "df"), "term", "left")
    rarest = known.groupBy("query_id", "query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("x")).where("x.df > 0").select("query_id", "query", F.col("x.term").alias("term"))
    counts = index.weights if index.counts is None else index.counts
    near = stored(counts.select("term", "doc_id").join(if_small(rarest), "term").select("doc_id", "query_id", "query"))
    holds = F.contains(F.col("text"), F.col("query"))
    found = texts.join(if_small(near), "doc_id").where(holds).select("query_id", "doc_id")
    short = if_small(inner.where("term IS NULL").select("query_id", "query"))
    return found.unionByName(texts.join(short, holds).select("query_id", "doc_id"))


def quality(found: DataFrame, judged: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall, ndcg, mrr`` for each query: of results (query_id, rank, doc_id) and judgments (query_id, doc_id).

    Gains are 0 or 1. A query without relevant documents has 0 in all. Recall and NDCG look at the first k, MRR at all results.
    """
    checked_k(k)
    relevant = judged.select("query_id", "doc_id").distinct()
    hits = found.select("query_id", "rank", "doc_id").join(relevant, ["query_id", "doc_id"])
    within = F.col("rank") <= k
    got = hits.groupBy("query_id").agg(
        F.count_if(within).alias("hits"),
        F.coalesce(F.sum(F.when(within, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.max(1 / F.col("rank")).alias("mrr"),
    )
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    each = queries.select("query_id").distinct().join(n, "query_id", "left").join(got, "query_id", "left")
    return each.select(
        "query_id",
        F.round(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.col("dcg") / F.when(F.col("n") > 0, ideal), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce("mrr", F.lit(0.0)), 6).alias("mrr"),
    )


def mean_quality(each: DataFrame) -> DataFrame:
    return each.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in ("recall", "ndcg", "mrr")])


def at_position(sample: DataFrame, value: str, position: int, count: int) -> float | None:
    """The value at a position (from 0) of the sorted sample of ``count`` values, exactly.

    A quantile sketch brackets the place, a count says how many values lie below the bracket, and only what lies in it is
    sorted; so no task holds the sample.
    """
    if not 0 <= position < count:
        return None
    at = (position + 0.5) / count
    low, high = sample.agg(F.percentile_approx(value, [max(0.0, at - 0.005), min(1.0, at + 0.005)], 10_000)).first()[0]
    below = sample.where(F.col(value) < low).count()
    inside = sample.where(F.col(value).between(low, high)).select(value)
    here = inside.orderBy(value).offset(position - below).limit(1).first() if position >= below else None
    return here[0] if here is not None else sample.select(value).orderBy(value).offset(position).limit(1).first()[0]


def latency_summary(sample: DataFrame, value: str) -> DataFrame:
    """One row ``n, mean, median, p95, per_second``: of a sample of milliseconds. p95 is the value at position int(0.95 n) of the
    sorted sample; the median is the mean of the middle two where n is even. Nulls don't count."""
    held = sample.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n, mean = held.agg(F.count(F.lit(1)), F.avg("v")).first()
    spark = sample.sparkSession
    schema = "n bigint, mean double, median double, p95 double, per_second double"
    if not n:
        return spark.createDataFrame([(0, None, None, None, None)], schema)
    middle = [at_position(held, "v", p, n) for p in {(n - 1) // 2, n // 2}]
    return spark.createDataFrame([(n, round(mean, 6), round(sum(middle) / len(middle), 6), round(at_position(held, "v", int(n * 0.95), n), 6), round(1000 / mean, 6) if mean > 0 else 0.0)], schema)


def interpolated_percentiles(sample: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row ``p50, p95, p99`` (and so on), with linear interpolation between neighbours."""
    held = sample.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = held.count()
    out = []
    for q in at:
        place = q * (n - 1)
        low, high = at_position(held, "v", int(place), n), at_position(held, "v", min(int(place) + 1, n - 1), n)
        out.append(None if low is None else round(low + (high - low) * (place - int(place)), 6))
    return sample.sparkSession.createDataFrame([tuple(out)], ", ".join(f"p{round(q * 100):d} double" for q in at))


def topic_distribution(docs: DataFrame, path: str = "$.topic") -> DataFrame:
    """``topic, n`` from the metadata; documents without one are ``unknown``."""
    topic = F.coalesce(F.try_variant_get("metadata", path, "string"), F.lit("unknown"))
    return docs.groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row ``n, fingerprint``: of the whole contents, whatever their order."""
    one = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(one), F.lit(0)).alias("fingerprint"))
