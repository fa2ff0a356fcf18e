"""The inverted index, as DataFrames.

postings      term, doc_id, tf, dl, impact; stored with ``weight``, the impact before idf
doc_stats     doc_id, dl; documents without terms too
term_stats    term, df, idf, max_impact
corpus_stats  one row: num_docs, total_len, avgdl, num_terms, nnz

A document's terms are counted in its own row (sorted, then taken run by run), so no shuffle is needed for term
frequencies; document frequencies are counted with partial sums, so a term that most documents have is no hot
partition; a saved index shuffles postings once, by ranges, and no join with the terms' statistics ever does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.params import BM25Params
from termlake.storage import BROADCAST_ROWS, new_folder, parts, stored

TABLES = ("postings", "doc_stats", "term_stats", "corpus_stats")


def doc_runs(docs: DataFrame, id_col: str = "id", title_col: str | None = "title", content_col: str = "content", analyzer: T.Analyzer = T.Analyzer()) -> DataFrame:
    """``doc_id, dl, runs``: a row for each document; all else follows from it."""
    title = F.col(title_col) if title_col else F.lit("")
    found = docs.select(F.col(id_col).alias("doc_id"), analyzer.terms(T.indexed_text(title, F.col(content_col))).alias("terms"))
    return found.select("doc_id", F.size("terms").cast("bigint").alias("dl"), T.term_runs(F.col("terms")).alias("runs"))


def term_counts(runs: DataFrame) -> DataFrame:
    """``term, doc_id, tf, dl`` for each distinct term of each document."""
    each = runs.select("doc_id", "dl", F.explode("runs").alias("run"))
    return each.select(T.run_term(F.col("run")).alias("term"), "doc_id", T.run_count(F.col("run")).alias("tf"), "dl")


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def length_norm(dl: Column, avgdl: Column, b: float) -> Column:
    return F.lit(1.0) - b + b * F.coalesce(F.try_divide(dl, avgdl), F.lit(0.0))


def weight(tf: Column, dl: Column, avgdl: Column, p: BM25Params) -> Column:
    """What a term adds to a document's score, before its idf."""
    return (tf * (p.k1 + 1)) / (tf + p.k1 * length_norm(dl, avgdl, p.b))


def impact(tf: Column, dl: Column, idf_: Column, avgdl: Column, p: BM25Params) -> Column:
    """What a term adds to a document's score."""
    return idf_ * weight(tf, dl, avgdl, p)


def doc_totals(doc_stats: DataFrame) -> DataFrame:
    """One row: num_docs, total_len, avgdl (0 without documents)."""
    return doc_stats.agg(F.count(F.lit(1)).alias("num_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def _corpus_stats(totals: DataFrame, terms: DataFrame) -> DataFrame:
    return totals.crossJoin(terms.agg(F.count(F.lit(1)).alias("num_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("nnz")))


@dataclass(frozen=True)
class LexicalIndex:
    """The four tables, the parameters that their impacts have, and how texts become terms."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    params: BM25Params = BM25Params()
    counts: DataFrame | None = None  #: postings without impacts, where those are computed on demand; None if they are stored
    weights: DataFrame | None = None  #: postings as they are stored, with impacts before idf; None if they aren't stored
    analyzer: T.Analyzer = T.Analyzer()
    kept: bool = False  #: whether counts come from stored runs, so that using them again tokenizes nothing

    @property
    def eager(self) -> bool:
        return self.weights is not None

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def vocabulary_ids(self) -> DataFrame:
        """``term, term_id`` in order of the terms, from 0: terms are sorted by ranges, and each range begins after what the ones before hold."""
        from pyspark.sql import Window

        ranged = self.term_stats.select("term").repartitionByRange("term").sortWithinPartitions("term")
        place = F.monotonically_increasing_id()
        held = stored(ranged.select("term", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("nth")))
        each = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
        before = each.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part")), F.lit(0)) - F.col("n")).alias("before"))
        return held.join(F.broadcast(before), "part").select("term", (F.col("before") + F.col("nth")).alias("term_id"))

    def save(self, path: str) -> LexicalIndex:
        """The tables as Parquet under ``path``; the stored index is returned.

        Texts are tokenized once, if they weren't yet: counts are stored, and all tables follow from them. Postings are shuffled once, by ranges
        of (term, doc_id), and sorted, so that a search reads the row groups of its terms only and a frequent term is spread over files; there are
        as many ranges as the number of postings calls for. They hold impacts before idf, which needs no join; idf comes from the terms of a query.
        """
        if callable(self.analyzer.normalize):
            raise ValueError("only an index with a normalizer from NORMALIZERS can be saved")
        held = self
        if self.counts is not None and not self.kept:
            held = _complete(stored(self.counts), stored(self.doc_stats), self.params, analyzer=self.analyzer)
        held.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        held.term_stats.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
        terms = self.spark.read.parquet(f"{path}/term_stats")
        _corpus_stats(doc_totals(held.doc_stats), terms).write.mode("overwrite").parquet(f"{path}/corpus_stats")
        corpus = self.spark.read.parquet(f"{path}/corpus_stats").first()
        rows = (held.counts if held.weights is None else held.weights).repartitionByRange(parts(self.spark, corpus.nnz), "term", "doc_id").sortWithinPartitions("term", "doc_id")
        if held.weights is None:  # after the shuffle, which has less to move so
            rows = rows.select("term", "doc_id", "tf", "dl", weight(F.col("tf"), F.col("dl"), F.lit(corpus.avgdl), held.params).alias("weight"))
        rows.write.mode("overwrite").parquet(f"{path}/postings")
        how = [(self.params.k1, self.params.b, self.analyzer.stop, self.analyzer.normalize, _rare(terms))]
        self.spark.createDataFrame(how, "k1 double, b double, stop boolean, normalize string, rare bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
        return load(self.spark, path)


def _rare(terms: DataFrame) -> int:
    """A document frequency that at most ``BROADCAST_ROWS`` terms exceed, the least one; 0 if there are no more terms."""
    seen = 0
    for r in terms.groupBy("df").count().orderBy(F.desc("df")).collect():  # frequencies that differ: fewer than the root of twice the postings
        seen += r["count"]
        if seen > BROADCAST_ROWS:
            return r.df
    return 0


def _with_idf(weights: DataFrame, terms: DataFrame, rare: int, nnz: int) -> DataFrame:
    """Stored postings with ``idf``: terms in more than ``rare`` documents are broadcast, and only postings of the others are shuffled."""
    common = F.broadcast(terms.where(F.col("df") > rare).select("term", "idf"))
    found = weights.join(common, "term")
    if not rare:
        return found
    n = parts(weights.sparkSession, nnz)
    rest = weights.join(common, "term", "left_anti").repartition(n, "term")
    return found.unionByName(rest.join(terms.where(F.col("df") <= rare).select("term", "idf").repartition(n, "term"), "term"))


def load(spark: SparkSession, path: str) -> LexicalIndex:
    """A saved index, ready to be searched; FileNotFoundError if there is none."""
    from pyspark.errors import AnalysisException

    try:
        how = spark.read.parquet(f"{path}/params").first()
        weights, docs, terms, corpus = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise FileNotFoundError(path) from e
        raise
    nnz = corpus.first().nnz
    rare = how.rare if "rare" in how else nnz // BROADCAST_ROWS  # that few terms are in more documents, whatever the corpus
    postings = _with_idf(weights, terms, rare, nnz).select("term", "doc_id", "tf", "dl", (F.col("idf") * F.col("weight")).alias("impact"))
    return LexicalIndex(postings, docs, terms, corpus, BM25Params(how.k1, how.b), weights=weights, analyzer=T.Analyzer(how.stop, how.normalize))


def cached(docs: DataFrame, folder: str, id_col: str = "id", params: BM25Params = BM25Params(), analyzer: T.Analyzer = T.Analyzer(), **options) -> LexicalIndex:
    """The index of a corpus from ``folder``, where one is kept for each corpus (by its fingerprint), parameters and analyzer; it is built and
    saved there if it isn't yet."""
    from termlake.operators.evaluate import fingerprint

    text = T.indexed_text(F.col(options.get("title_col", "title")) if options.get("title_col", "title") else F.lit(""), F.col(options.get("content_col", "content")))
    mark = fingerprint(docs.select(F.col(id_col).alias("id"), text.alias("text")), "id", "text").first()
    path = f"{folder.rstrip('/')}/{mark.n}-{mark.fingerprint:x}-k{params.k1}-b{params.b}-{'stop' if analyzer.stop else 'all'}-{analyzer.normalize or 'plain'}"
    try:
        return load(docs.sparkSession, path)
    except FileNotFoundError:
        return build(docs, id_col, params=params, analyzer=analyzer, **options).save(path)


def _complete(counts: DataFrame, doc_stats: DataFrame, params: BM25Params, terms_at: str | None = None, analyzer: T.Analyzer = T.Analyzer(), kept: bool = False) -> LexicalIndex:
    totals = F.broadcast(doc_totals(doc_stats))  # one row
    one = impact(F.col("tf"), F.col("dl"), F.lit(1.0), F.col("avgdl"), params)
    best = counts.crossJoin(totals).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(one).alias("most"), F.max("num_docs").alias("n"))
    terms = best.withColumn("idf", idf(F.col("n"), F.col("df"))).select("term", "df", "idf", (F.col("idf") * F.col("most")).alias("max_impact"))
    if terms_at:
        terms = stored(terms, terms_at)
    stats = _corpus_stats(totals, terms)
    joined = counts.join(terms.select("term", "idf"), "term").crossJoin(totals)
    postings = joined.select("term", "doc_id", "tf", "dl", impact(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"), params).alias("impact"))
    return LexicalIndex(postings, doc_stats, terms, stats, params, counts, analyzer=analyzer, kept=kept)


def build(docs: DataFrame, id_col: str = "id", title_col: str | None = "title", content_col: str = "content", params: BM25Params = BM25Params(), keep: bool = True, check_ids: bool = True, analyzer: T.Analyzer = T.Analyzer()) -> LexicalIndex:
    """The index of a corpus. Its analyzer makes terms of documents, and later of queries.

    With ``keep``, texts are tokenized once: counts go to the shared folder, and everything else is computed from there, so
    neither a lost executor nor a second use of the index tokenizes again. Without, the tables are plans over ``docs``.
    Ids that repeat or are null are an error (with ``keep``, unless ``check_ids`` is false).
    """
    from termlake.sources.corpus import distinct_ids

    runs = doc_runs(docs, id_col, title_col, content_col, analyzer)
    if not keep:
        return _complete(term_counts(runs), runs.select("doc_id", "dl"), params, analyzer=analyzer)
    folder = new_folder(docs.sparkSession, "index")
    runs = stored(runs, f"{folder}/runs")
    doc_stats = runs.select("doc_id", "dl")
    if check_ids:
        distinct_ids(doc_stats, "doc_id")
    return _complete(term_counts(runs), doc_stats, params, f"{folder}/term_stats", analyzer, True)
