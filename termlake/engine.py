"""One engine for all of it: a corpus, its index, and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from termlake.functions.text import Analyzer, highlight, snippet
from termlake.operators import index as I
from termlake.operators import maintain
from termlake.operators import search as S
from termlake.operators.report import Phases
from termlake.params import BM25Params, checked_k
from termlake.plans.cache import ResultCache


class Engine:
    """Searches over a corpus ``id, title, content`` (further columns come back with results). ``phases`` has the seconds that building, saving
    and searching took."""

    def __init__(self, docs: DataFrame, params: BM25Params = BM25Params(), cache_size: int = 1000, index: I.LexicalIndex | None = None, analyzer: Analyzer = Analyzer()):
        self.docs = docs
        self.phases = Phases()
        self.params = params if index is None else index.params
        with self.phases("build"):
            self.index = index or I.build(docs, params=params, analyzer=analyzer)
        self.cache = ResultCache(cache_size)

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @classmethod
    def load(cls, path: str, docs: DataFrame, cache_size: int = 1000) -> Engine:
        """From a saved index, with the parameters that it was built with."""
        return cls(docs, cache_size=cache_size, index=I.load(docs.sparkSession, path))

    def save(self, path: str) -> None:
        """The index is stored, and used from there on; documents aren't part of it."""
        with self.phases("save"):
            self.index = self.index.save(path)

    def search(self, query: str | None, k: int = 10, exclude: DataFrame | None = None) -> DataFrame:
        """``rank, doc_id, score`` and the documents' columns."""
        found = S.search(self.index, query, k, exclude, self.params)
        return S.with_documents(found, self.docs)

    def results(self, query: str | None, k: int = 10) -> list[Row]:
        """The results in order, from the cache if they are there."""
        key = query, checked_k(k)
        found = self.cache.get(key)
        if found is None:
            with self.phases("search"):
                found = self.search(query, k).orderBy("rank").collect()
            if found and self.cache.capacity:
                self.cache.put(key, found)
        return list(found)

    def search_batch(self, queries: DataFrame | Sequence[str], k: int = 10, exclude: DataFrame | None = None) -> DataFrame:
        """``query_id, rank, doc_id, score``; a list of queries is numbered from 0."""
        if not isinstance(queries, DataFrame):
            queries = self.spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
        return S.search_batch(self.index, queries, k, exclude, self.params)

    def explain(self, query: str, doc_ids: Sequence) -> DataFrame:
        """``doc_id, term, term_score`` for the given documents."""
        kind = self.index.doc_stats.schema["doc_id"].dataType.simpleString()
        pairs = self.spark.createDataFrame([(0, d) for d in doc_ids], f"query_id int, doc_id {kind}")
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        return S.explain(self.index, asked, pairs, self.params).drop("query_id")

    def snippets(self, query: str, k: int = 10, size: int = 200, mark: str | None = None) -> DataFrame:
        """Results with a ``snippet`` of the content, its query terms between marks if there is one."""
        words = self.spark.range(1).select(S.T.terms(F.lit(query))).first()[0]
        part = snippet(F.col("content"), words, size)
        return self.search(query, k).withColumn("snippet", highlight(part, words, mark) if mark else part)

    def _renewed(self, docs: DataFrame) -> None:
        with self.phases("build"):
            self.docs, self.index = docs, I.build(docs, params=self.params, analyzer=self.index.analyzer)
        self.cache.clear()

    def add(self, more: DataFrame) -> None:
        self._renewed(maintain.added(self.docs, more))

    def remove(self, ids: Sequence) -> None:
        kind = self.docs.schema["id"].dataType.simpleString()
        self._renewed(maintain.removed(self.docs, self.spark.createDataFrame([(i,) for i in ids], f"id {kind}")))

    def stats(self) -> DataFrame:
        return self.index.corpus_stats
