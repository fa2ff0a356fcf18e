"""The queries by name, each over its whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.engine import Engine
from termlake.functions import text as T
from termlake.operators import evaluate, index, maintain, report, search
from termlake.params import BM25Params
from termlake.plans import compose
from termlake.sources import corpus
from termlake.storage import if_small, new_folder, parts
from termlake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
OTHER = BM25Params(k1=2.0, b=0.5)
WORDS = ("worthless", "thre")
UNKNOWN = "xyzzyq"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_table(table(spark, sf_dir, "documents"), metadata=["lang", "source"])


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def plain_index(spark: SparkSession, sf_dir: str) -> index.LexicalIndex:
    return index.build(documents(spark, sf_dir), keep=False)


def full_index(spark: SparkSession, sf_dir: str) -> index.LexicalIndex:
    return index.build(documents(spark, sf_dir))


def one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id bigint, query string")


# SQL

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"


def _terms(c: str, stop: bool = True, each: str = "") -> str:
    found = f"list_filter({_tokens(c)}, lambda x: x NOT IN ({_STOP}))" if stop else _tokens(c)
    return f"list_transform({found}, lambda x: {each})" if each else found


_DOCS = "SELECT doc_id, text FROM documents"
_BENCH = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _with(docs: str = _DOCS, queries: str = _BENCH, p: BM25Params = BM25Params(), stop: bool = True, each: str = "") -> str:
    """Common tables: tok, st, post, df, idx, q, sc. What several of them use is computed once."""
    return f"""
    WITH d AS ({docs}),
     tok AS MATERIALIZED (SELECT doc_id, {_terms("coalesce(text, '')", stop, each)} AS t FROM d),
     st AS (SELECT count(*) AS n, sum(len(t)) AS total_len, avg(len(t)) AS avgdl FROM tok),
     post AS MATERIALIZED (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
     df AS MATERIALIZED (SELECT term, count(*) AS df, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf FROM post, st GROUP BY term, n),
     idx AS MATERIALIZED (SELECT term, doc_id, idf * (tf * ({p.k1} + 1)) / (tf + {p.k1} * (1 - {p.b} + {p.b} * (dl / avgdl))) AS impact FROM post JOIN df USING (term), st),
     qs AS ({queries}),
     q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_terms("query", stop, each)}) AS term FROM qs) GROUP BY ALL),
     sc AS (SELECT query_id, doc_id, sum(qtf * impact) AS score FROM q JOIN idx USING (term) GROUP BY ALL),
     ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, score FROM sc)"""


_TOP = " SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10"
_ONE = " SELECT rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10"
FLAGSHIP = "thanedble and thintion in a licensed thre, the worthless erhation, thre"

PRUNED = "worthless en er re th es"


def _single(text: str) -> str:
    return f"SELECT 0::BIGINT AS query_id, '{text}' AS query"


# Text functions


@query
def tokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("position", "token")).withColumn("position", F.col("position").cast("bigint"))


_numbered = "SELECT {keys}, unnest(range(len(t))) AS position, unnest(t) AS token FROM (SELECT {keys}, {tokens} AS t FROM {table})"
SQL["tokenize"] = _numbered.format(keys="doc_id", tokens=_tokens("text"), table="documents")


@query
def tokenize_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(T.tokens(F.col("text"))).alias("position", "token")).withColumn("position", F.col("position").cast("bigint"))


SQL["tokenize_conversations"] = _numbered.format(keys="conv_id, turn", tokens=_tokens("text"), table="conversations")


@query
def remove_stop_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("position", "term"))
    return each.where(~F.col("term").isin(*T.STOP_WORDS)).withColumn("position", F.col("position").cast("bigint"))


SQL["remove_stop_words"] = f"SELECT doc_id, position, token AS term FROM ({SQL['tokenize']}) WHERE token NOT IN ({_STOP})"


@query
def unique_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))


SQL["unique_terms"] = f"SELECT DISTINCT doc_id, unnest({_terms('text')}) AS term FROM documents"


@query
def snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.snippet(F.col("text"), WORDS).alias("snippet"))


SQL["snippets"] = f"""
    WITH a AS (SELECT doc_id, text, greatest(coalesce(nullif(instr(lower(text), '{WORDS[0]}'), 0), nullif(instr(lower(text), '{WORDS[1]}'), 0), 1) - 41, 0) AS pos FROM documents),
     b AS (SELECT *, substring(text, pos + 1, 200) AS s FROM a),
     c AS (SELECT *, CASE WHEN pos > 0 THEN concat('...', CASE WHEN instr(s, ' ') BETWEEN 2 AND 20 THEN substring(s, instr(s, ' ') + 1) ELSE s END) ELSE s END AS s1 FROM b),
     e AS (SELECT *, CASE WHEN instr(s1, ' ') = 0 THEN -1 ELSE length(s1) - instr(reverse(s1), ' ') END AS z FROM c)
    SELECT doc_id, CASE WHEN text = '' THEN '' WHEN length(text) > pos + 200
      THEN concat(CASE WHEN z > length(s1) - 20 THEN substring(s1, 1, z) ELSE s1 END, '...') ELSE s1 END AS snippet FROM e"""


@query
def highlights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.highlight(F.col("text"), WORDS).alias("marked"))


SQL["highlights"] = f"SELECT doc_id, regexp_replace(text, '({'|'.join(sorted({f for w in WORDS for f in (w, w.upper(), w.capitalize())}, key=lambda f: (-len(f), f)))})', '**\\1**', 'g') AS marked FROM documents"


@query
def lead_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.lead(F.col("text")).alias("snippet"))


SQL["lead_snippets"] = "SELECT doc_id, concat(trim(replace(substring(text, 1, 200), chr(10), ' ')), CASE WHEN length(text) > 200 THEN '...' ELSE '' END) AS snippet FROM documents"


@query
def strip_markup(spark, sf_dir):
    """Of the texts between tags, with a tag before each space that follows a full stop."""
    marked = F.concat(F.lit("[b]"), F.regexp_replace("text", r"\. ", ". [i x=1] "), F.lit("[/b][] [open"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_markup(marked).alias("plain"))


SQL["strip_markup"] = r"SELECT doc_id, regexp_replace('[b]' || replace(text, '. ', '. [i x=1] ') || '[/b][] [open', '\[/?[^\]]+\]', '', 'g') AS plain FROM documents"


@query
def query_fragments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.fragment(F.col("text")).alias("fragment")).where("fragment IS NOT NULL")


SQL["query_fragments"] = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(substring(text, length(text) // 2 + 1, 200), '[^ \t\r\n]+') AS w FROM documents WHERE length(text) > 100)
    SELECT doc_id, array_to_string(w[2:least(6, len(w) - 1)], ' ') AS fragment FROM w WHERE len(w) >= 5"""


@query
def sampled_queries(spark, sf_dir):
    """A sample of 25 queries from the middles of documents; the limit is the operator's."""
    return corpus.sampled_queries(documents(spark, sf_dir), 25).select("query_id", "query", "doc_id")


SQL["sampled_queries"] = f"""
    SELECT 'q' || doc_id AS query_id, fragment AS query, doc_id FROM ({SQL["query_fragments"]})
    WHERE len(regexp_split_to_array(fragment, '\\s+')) >= 3 ORDER BY md5('42|' || doc_id), doc_id LIMIT 25"""


@query
def corpus_prefix(spark, sf_dir):
    """The first 100 documents by id; the limit is the operator's."""
    return corpus.first(documents(spark, sf_dir), 100).select(F.col("id").alias("doc_id"), "content")


SQL["corpus_prefix"] = "SELECT doc_id, text AS content FROM documents ORDER BY doc_id LIMIT 100"


# The index


@query
def term_frequencies(spark, sf_dir):
    return plain_index(spark, sf_dir).counts.select("term", "doc_id", "tf")


SQL["term_frequencies"] = _with() + " SELECT term, doc_id, tf FROM post"


@query
def doc_lengths(spark, sf_dir):
    return plain_index(spark, sf_dir).doc_stats


SQL["doc_lengths"] = _with() + " SELECT doc_id, len(t) AS dl FROM tok"


@query
def corpus_stats(spark, sf_dir):
    stats = full_index(spark, sf_dir).corpus_stats
    share = 1 - F.try_divide(F.col("nnz"), F.col("num_terms") * F.col("num_docs"))
    return stats.select("num_docs", "total_len", F.round("avgdl", 6).alias("avgdl"), "num_terms", "nnz", F.round(share, 9).alias("sparsity"))


SQL["corpus_stats"] = _with() + """ SELECT n AS num_docs, total_len::BIGINT AS total_len, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS num_terms,
    (SELECT count(*) FROM post) AS nnz, round(1 - (SELECT count(*) FROM post) / ((SELECT count(*) FROM df) * n), 9) AS sparsity FROM st"""


@query
def document_frequency(spark, sf_dir):
    return plain_index(spark, sf_dir).term_stats.select("term", "df")


SQL["document_frequency"] = _with() + " SELECT term, df FROM df"


@query
def inverse_document_frequency(spark, sf_dir):
    return plain_index(spark, sf_dir).term_stats.select("term", F.round("idf", 6).alias("idf"))


SQL["inverse_document_frequency"] = _with() + " SELECT term, round(idf, 6) AS idf FROM df"


@query
def length_norms(spark, sf_dir):
    stats = plain_index(spark, sf_dir).doc_stats
    joined = stats.crossJoin(F.broadcast(index.doc_totals(stats)))  # one row
    return joined.select("doc_id", F.round(index.length_norm(F.col("dl"), F.col("avgdl"), 0.75), 6).alias("norm"))


SQL["length_norms"] = _with() + " SELECT doc_id, round(1 - 0.75 + 0.75 * (len(t) / avgdl), 6) AS norm FROM tok, st"


@query
def impact_matrix(spark, sf_dir):
    return full_index(spark, sf_dir).postings.select("term", "doc_id", F.round("impact", 6).alias("impact"))


SQL["impact_matrix"] = _with() + " SELECT term, doc_id, round(impact, 6) AS impact FROM idx"


@query
def max_term_score(spark, sf_dir):
    return plain_index(spark, sf_dir).term_stats.select("term", F.round("max_impact", 6).alias("max_impact"))


SQL["max_term_score"] = _with() + " SELECT term, round(max(impact), 6) AS max_impact FROM idx GROUP BY term"


@query
def vocabulary_ids(spark, sf_dir):
    return full_index(spark, sf_dir).vocabulary_ids()


SQL["vocabulary_ids"] = _with() + " SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM df"


@query
def posting_lists(spark, sf_dir):
    """The posting lists of all terms that the benchmark's texts have."""
    return search.posting_list(full_index(spark, sf_dir), search.query_terms(asked(spark, sf_dir)))


SQL["posting_lists"] = _with() + " SELECT term, doc_id, tf FROM post WHERE term IN (SELECT term FROM q)"


@query
def term_lookup(spark, sf_dir):
    """Statistics of the benchmark's terms and of one that nobody knows."""
    wanted = search.query_terms(asked(spark, sf_dir)).select("term").unionByName(spark.createDataFrame([(UNKNOWN,)], "term string"))
    return search.term_lookup(full_index(spark, sf_dir), wanted).withColumn("idf", F.round("idf", 6))


SQL["term_lookup"] = _with() + f""" SELECT w.term, coalesce(df, 0) AS df, round(coalesce(idf, 0), 6) AS idf
    FROM (SELECT DISTINCT term FROM q UNION SELECT '{UNKNOWN}') w LEFT JOIN df ON w.term = df.term"""


@query
def frequency_lookup(spark, sf_dir):
    """Counts of two terms in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    pairs = docs.crossJoin(F.broadcast(spark.createDataFrame([(WORDS[1],), (UNKNOWN,)], "term string")))  # two rows
    return search.frequency_lookup(full_index(spark, sf_dir), pairs)


SQL["frequency_lookup"] = _with() + f""" SELECT w.term, w.doc_id, coalesce(tf, 0) AS tf
    FROM (SELECT doc_id, term FROM documents, (SELECT '{WORDS[1]}' AS term UNION ALL SELECT '{UNKNOWN}')) w LEFT JOIN post ON post.term = w.term AND post.doc_id = w.doc_id"""


@query
def doc_lookup(spark, sf_dir):
    """The labelled documents, by id."""
    return search.documents_by_id(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels"))


SQL["doc_lookup"] = "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


@query
def index_round_trip(spark, sf_dir):
    saved = plain_index(spark, sf_dir).save(new_folder(spark, "index"))
    return saved.postings.select("term", "doc_id", "tf", "dl", F.round("impact", 6).alias("impact"))


SQL["index_round_trip"] = _with() + " SELECT term, doc_id, tf, dl, round(impact, 6) AS impact FROM post JOIN idx USING (term, doc_id)"


# Search


@query
def candidate_docs(spark, sf_dir):
    return search.candidates(full_index(spark, sf_dir), search.query_terms(asked(spark, sf_dir)))


SQL["candidate_docs"] = _with() + " SELECT query_id, doc_id FROM sc"


@query
def search_top10(spark, sf_dir):
    return search.search(full_index(spark, sf_dir), FLAGSHIP)


SQL["search_top10"] = _with(queries=_single(FLAGSHIP)) + _ONE


@query
def search_pruned(spark, sf_dir):
    """By upper bounds: a rare term and frequent ones."""
    return search.search_pruned(full_index(spark, sf_dir), PRUNED)


SQL["search_pruned"] = _with(queries=_single(PRUNED)) + _ONE


@query
def search_batch_top10(spark, sf_dir):
    return search.search_batch(full_index(spark, sf_dir), asked(spark, sf_dir))


SQL["search_batch_top10"] = _with() + _TOP


@query
def search_saved_index(spark, sf_dir):
    """Stored impacts, read back by term."""
    saved = plain_index(spark, sf_dir).save(new_folder(spark, "index"))
    return search.search_batch(saved, asked(spark, sf_dir))


SQL["search_saved_index"] = SQL["search_batch_top10"]


@query
def search_other_params(spark, sf_dir):
    return search.search_batch(full_index(spark, sf_dir), asked(spark, sf_dir), params=OTHER)


SQL["search_other_params"] = _with(p=OTHER) + _TOP


@query
def search_repeated_terms(spark, sf_dir):
    twice = asked(spark, sf_dir).withColumn("query", F.concat_ws(" ", "query", F.substring_index("query", " ", 8), F.substring_index("query", " ", 8)))
    return search.search_batch(full_index(spark, sf_dir), twice)


_EIGHT = "array_to_string(string_split(text, ' ')[1:8], ' ')"
SQL["search_repeated_terms"] = _with(queries=f"SELECT item_id AS query_id, concat_ws(' ', text, {_EIGHT}, {_EIGHT}) AS query FROM benchmark") + _TOP


@query
def search_exclude_seen(spark, sf_dir):
    """The second page: what comes after the first is seen."""
    held, queries = full_index(spark, sf_dir), asked(spark, sf_dir)
    return search.search_batch(held, queries, exclude=search.search_batch(held, queries))


SQL["search_exclude_seen"] = _with() + " SELECT query_id, rank - 10 AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank BETWEEN 11 AND 20"


@query
def search_conversations(spark, sf_dir):
    """The turns as the corpus; their ids are conversation and turn."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    return search.search_batch(index.build(turns, title_col=None), asked(spark, sf_dir))


SQL["search_conversations"] = _with("SELECT conv_id || '-' || turn AS doc_id, text FROM conversations") + _TOP


@query
def rank_documents(spark, sf_dir):
    """All labelled documents, ranked for each text of the benchmark."""
    labels, queries = table(spark, sf_dir, "labels").select("doc_id"), asked(spark, sf_dir)
    labelled = labels.repartition(parts(spark, labels.count() * queries.count()), "doc_id").distinct()  # parts that are small with every query too
    return search.rank_documents(full_index(spark, sf_dir), queries, labelled.crossJoin(if_small(queries.select("query_id"))))


SQL["rank_documents"] = _with() + """ SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank, doc_id, round(s, 6) AS score
    FROM (SELECT w.query_id, w.doc_id, coalesce(score, 0.0) AS s FROM (SELECT query_id, doc_id FROM qs, (SELECT DISTINCT doc_id FROM labels)) w LEFT JOIN sc USING (query_id, doc_id))"""


@query
def explain(spark, sf_dir):
    """What each term adds to the scores of the ten best documents of each query."""
    held, queries = full_index(spark, sf_dir), asked(spark, sf_dir)
    return search.explain(held, queries, search.search_batch(held, queries))


SQL["explain"] = _with() + """ SELECT r.query_id, r.doc_id, q.term, round(coalesce(impact, 0.0), 6) AS term_score
    FROM ranked r JOIN q USING (query_id) LEFT JOIN idx ON idx.term = q.term AND idx.doc_id = r.doc_id WHERE rank <= 10"""


_TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_BODY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query
def search_with_titles(spark, sf_dir):
    """The pages as the corpus, results with their titles."""
    pages = corpus.from_pages(table(spark, sf_dir, "pages"))
    found = search.search_batch(index.build(pages), asked(spark, sf_dir))
    return search.with_documents(found, pages.select("id", "title")).select("query_id", "rank", F.col("doc_id").alias("page_id"), "title", "score")


SQL["search_with_titles"] = _with(f"SELECT page_id AS doc_id, {_TITLE} || ' ' || {_BODY} AS text FROM pages") + f"""
    SELECT query_id, rank, page_id, {_TITLE} AS title, round(score, 6) AS score FROM ranked JOIN pages ON page_id = doc_id WHERE rank <= 10"""


@query
def search_keep_stop_words(spark, sf_dir):
    """An index and queries that keep their stop words."""
    held = index.build(documents(spark, sf_dir), analyzer=T.Analyzer(stop=False))
    return search.search_batch(held, asked(spark, sf_dir))


SQL["search_keep_stop_words"] = _with(stop=False) + _TOP


@query
def search_stemmed(spark, sf_dir):
    """The first five letters of each word, in documents and queries; the index is saved and loaded."""
    held = index.build(documents(spark, sf_dir), analyzer=T.Analyzer(normalize="prefix5")).save(new_folder(spark, "index"))
    return search.search_batch(held, asked(spark, sf_dir))


SQL["search_stemmed"] = _with(each="x[1:5]") + _TOP


@query
def normalized_terms(spark, sf_dir):
    """Each document's words in their singular."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.Analyzer(normalize="singular").terms(F.col("text"))).alias("position", "term")).withColumn("position", F.col("position").cast("bigint"))


_SINGULAR = "CASE WHEN regexp_matches(x, '^.{2,}ies$') THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_matches(x, '^.*[a-rt-z0-9]{2}s$') THEN regexp_replace(x, 's$', '') ELSE x END"
SQL["normalized_terms"] = f"SELECT doc_id, unnest(range(len(t))) AS position, unnest(t) AS term FROM (SELECT doc_id, {_terms('text', True, _SINGULAR)} AS t FROM documents)"


@query
def search_cached_index(spark, sf_dir):
    """The index that is kept by the corpus's fingerprint: the second time it is the stored one."""
    folder = new_folder(spark, "indexes")
    for _ in range(2):
        held = index.cached(documents(spark, sf_dir), folder)
    return search.search_batch(held, asked(spark, sf_dir))


SQL["search_cached_index"] = SQL["search_batch_top10"]


@query
def search_cached_results(spark, sf_dir):
    """A query asked twice: the second time its results come from the cache."""
    engine = Engine(documents(spark, sf_dir))
    found = [engine.results(FLAGSHIP) for _ in range(2)][1]
    counts = engine.cache.stats()
    return spark.createDataFrame([(r.rank, r.doc_id, r.score, counts["hits"], counts["misses"]) for r in found], "rank bigint, doc_id bigint, score double, hits int, misses int")


SQL["search_cached_results"] = _with(queries=_single(FLAGSHIP)) + _ONE.replace(" FROM", ", 1::INTEGER AS hits, 1::INTEGER AS misses FROM")


@query
def search_streamed(spark, sf_dir):
    """The documents arrive as a stream, in two parts with a compaction between them."""
    folder = new_folder(spark, "stream")
    docs = documents(spark, sf_dir).select("id", "title", "content")
    source = spark.readStream.schema("id bigint, title string, content string")
    for k in (0, 1):
        docs.where(F.pmod("id", F.lit(2)) == k).write.mode("append").parquet(f"{folder}/in")
        ingest.ingest(source.parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
        if k == 0:
            ingest.compact(spark, f"{folder}/out")
    return search.search_batch(ingest.arrived(spark, f"{folder}/out"), asked(spark, sf_dir))


SQL["search_streamed"] = SQL["search_batch_top10"]


@query
def composed_steps(spark, sf_dir):
    """Three steps as one: terms, their number, those with at least ten."""
    steps = compose.chain(lambda d: d.select("doc_id", T.terms(F.col("text")).alias("t")), lambda d: d.select("doc_id", F.size("t").cast("bigint").alias("n")), lambda d: d.where("n >= 10"))
    return (steps >> compose.identity)(table(spark, sf_dir, "documents"))


SQL["composed_steps"] = f"SELECT doc_id, n FROM (SELECT doc_id, len({_terms('text')}) AS n FROM documents) WHERE n >= 10"


@query
def lifted_functions(spark, sf_dir):
    """A function over the elements of an array, and over values that may be missing."""
    docs = table(spark, sf_dir, "documents")
    lengths = compose.over_list(F.length)(F.array_distinct(T.terms(F.col("text"))))
    maybe = compose.over_optional(lambda v: F.coalesce(v + 1, F.lit(-1)))(F.nullif("n_chars", F.length(F.regexp_replace("text", "[0-9]", ""))))
    return docs.select("doc_id", F.aggregate(lengths, F.lit(0), lambda s, x: s + x).cast("bigint").alias("total"), maybe.cast("bigint").alias("maybe"))


SQL["lifted_functions"] = f"""
    SELECT doc_id, coalesce(list_sum(list_transform(list_distinct({_terms("text")}), lambda x: length(x))), 0)::BIGINT AS total,
           (CASE WHEN nullif(n_chars, length(regexp_replace(text, '[0-9]', '', 'g'))) IS NULL THEN NULL ELSE n_chars + 1 END)::BIGINT AS maybe FROM documents"""


@query
def lifted_over_tree(spark, sf_dir):
    """A function over the values of the tree of regions and nations, whose shape stays."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth"), F.col("r_name").alias("value"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("node"), F.col("n_regionkey").cast("bigint").alias("parent"), F.lit(1).alias("depth"), F.col("n_name").alias("value"))
    return compose.over_tree(region.unionByName(nation), F.lower)


SQL["lifted_over_tree"] = """
    SELECT r_regionkey::BIGINT AS node, NULL::BIGINT AS parent, 0::INTEGER AS depth, lower(r_name) AS value FROM region
    UNION ALL SELECT n_nationkey + 100, n_regionkey::BIGINT, 1, lower(n_name) FROM nation"""


# Maintenance


@query
def add_documents(spark, sf_dir):
    """The pages are added to the documents, under negative ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content"))
    pages = corpus.from_pages(table(spark, sf_dir, "pages")).select((-F.col("id") - 1).alias("id"), "title", "content")
    return search.search_batch(index.build(maintain.added(docs, pages)), asked(spark, sf_dir))


SQL["add_documents"] = _with(f"SELECT doc_id, text FROM documents UNION ALL SELECT -page_id - 1, {_TITLE} || ' ' || {_BODY} FROM pages") + _TOP


@query
def remove_documents(spark, sf_dir):
    """The documents labelled as toxic are removed."""
    docs = documents(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return search.search_batch(index.build(maintain.removed(docs, toxic.join(docs.select("id"), "id", "left_semi"))), asked(spark, sf_dir))


SQL["remove_documents"] = _with("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)") + _TOP


# Evaluation


@query
def verbatim_judgments(spark, sf_dir):
    return evaluate.verbatim_judgments(table(spark, sf_dir, "documents"), asked(spark, sf_dir))


SQL["verbatim_judgments"] = "SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON length(b.text) > 0 AND strpos(d.text, b.text) > 0"


@query
def recall_ndcg_mrr(spark, sf_dir):
    queries, held = asked(spark, sf_dir), full_index(spark, sf_dir)
    judged = evaluate.verbatim_judgments(table(spark, sf_dir, "documents"), queries, index=held)
    return evaluate.quality(search.search_batch(held, queries), judged, queries)


_QUALITY = _with() + f""", judged AS ({SQL["verbatim_judgments"]}),
     nrel AS (SELECT query_id, count(*) AS n FROM judged GROUP BY query_id),
     hits AS (SELECT query_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, max(1 / rank) AS mrr FROM ranked JOIN judged USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id),
     each AS (SELECT query_id, round(coalesce(hits / n, 0.0), 6) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0.0), 6) AS ndcg, round(coalesce(mrr, 0.0), 6) AS mrr
       FROM qs LEFT JOIN nrel USING (query_id) LEFT JOIN hits USING (query_id))"""
SQL["recall_ndcg_mrr"] = _QUALITY + " SELECT * FROM each"


@query
def mean_quality(spark, sf_dir):
    return evaluate.mean_quality(recall_ndcg_mrr(spark, sf_dir))


SQL["mean_quality"] = _QUALITY + " SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM each"


@query
def latency_summary(spark, sf_dir):
    """Over the events' values, as a sample of numbers."""
    return evaluate.latency_summary(table(spark, sf_dir, "events"), "value")


SQL["latency_summary"] = """
    WITH s AS (SELECT list_sort(list(value)) AS v, count(value) AS n, avg(value) AS mean, median(value) AS median FROM events)
    SELECT n, round(mean, 6) AS mean, round(median, 6) AS median, round(v[(n * 95) // 100 + 1], 6) AS p95, round(1000 / mean, 6) AS per_second FROM s"""


@query
def latency_percentiles(spark, sf_dir):
    return evaluate.interpolated_percentiles(table(spark, sf_dir, "events"), "value")


SQL["latency_percentiles"] = "SELECT " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM events"


@query
def topic_distribution(spark, sf_dir):
    return evaluate.topic_distribution(documents(spark, sf_dir), "$.source")


SQL["topic_distribution"] = "SELECT coalesce(source, 'unknown') AS topic, count(*) AS n FROM documents GROUP BY 1"


@query
def corpus_fingerprint(spark, sf_dir):
    return evaluate.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")


SQL["corpus_fingerprint"] = "SELECT count(*) AS n, bit_xor(('0x' || substring(md5(doc_id || '|' || coalesce(text, '')), 1, 15))::BIGINT) AS fingerprint FROM documents"


# Sources


@query
def jsonl_round_trip(spark, sf_dir):
    folder = new_folder(spark, "corpus")
    docs = documents(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    corpus.write_jsonl(docs, folder)
    back = corpus.read_jsonl(spark, folder)
    return back.select(F.col("id").cast("bigint").alias("doc_id"), "title", "content", F.variant_get("metadata", "$.lang", "string").alias("lang"), F.variant_get("metadata", "$.source", "string").alias("source"))


SQL["jsonl_round_trip"] = "SELECT doc_id, '' AS title, text AS content, lang, source FROM documents"


@query
def repeated_ids(spark, sf_dir):
    """Conversations that have more than one turn: their ids wouldn't do for documents."""
    return corpus.repeated_ids(table(spark, sf_dir, "conversations"), "conv_id").withColumnRenamed("count", "n")


SQL["repeated_ids"] = "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1 OR conv_id IS NULL"


@query
def retrieval_set(spark, sf_dir):
    """Documents, the benchmark's queries and graded judgments, written as a retrieval test set and read again: documents judged for a query."""
    folder = new_folder(spark, "retrieval")
    docs, queries = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    docs.select(F.col("doc_id").cast("string").alias("_id"), F.lit("").alias("title"), "text").write.json(f"{folder}/corpus.jsonl")
    queries.select(F.col("item_id").cast("string").alias("_id"), "text").write.json(f"{folder}/queries.jsonl")
    grades = table(spark, sf_dir, "labels").select((F.col("doc_id") % 7).cast("string").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.col("quality").alias("score"))
    grades.unionByName(grades.limit(0)).write.option("sep", "\t").option("header", True).csv(f"{folder}/qrels/test.tsv")
    held, asked_, judged = corpus.read_retrieval_set(spark, folder)
    return judged.join(held.select(F.col("id").alias("doc_id"), F.length("content").alias("length")), "doc_id").join(asked_, "query_id", "left").select("query_id", "doc_id", "length", "query")


SQL["retrieval_set"] = """
    SELECT (l.doc_id % 7)::VARCHAR AS query_id, l.doc_id::VARCHAR AS doc_id, length(d.text)::INTEGER AS length, b.text AS query
    FROM labels l JOIN documents d USING (doc_id) LEFT JOIN benchmark b ON b.item_id = l.doc_id % 7 WHERE l.quality > 0"""


@query
def query_file(spark, sf_dir):
    """The benchmark's queries, each with documents that hold its text, as a file of queries that is read again."""
    folder = new_folder(spark, "queries")
    queries = asked(spark, sf_dir)
    judged = evaluate.verbatim_judgments(table(spark, sf_dir, "documents"), queries).groupBy("query_id").agg(F.collect_list(F.col("doc_id").cast("string")).alias("relevant_docs"))
    rows = queries.join(judged, "query_id").select(F.col("query_id").cast("string").alias("id"), F.col("query").alias("text"), "relevant_docs")
    rows.write.json(folder)
    read, relevant = corpus.read_queries(spark, folder)
    return read.join(relevant, "query_id")


SQL["query_file"] = f"SELECT query_id::VARCHAR AS query_id, text AS query, doc_id::VARCHAR AS doc_id FROM ({SQL['verbatim_judgments']}) JOIN benchmark ON item_id = query_id"


@query
def article_dump(spark, sf_dir):
    """The pages as a dump of articles: the first 100 by id; the limit is the operator's."""
    folder = new_folder(spark, "dump")
    pages = table(spark, sf_dir, "pages")
    pages.select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("id"), F.col("url").alias("title"), F.col("html").alias("text")).write.json(folder)
    return corpus.read_dump(spark, folder, 100).select("id", "title", "content")


SQL["article_dump"] = "SELECT lpad(page_id::VARCHAR, 9, '0') AS id, url AS title, html AS content FROM pages ORDER BY id LIMIT 100"


@query
def results_file(spark, sf_dir):
    """Results as JSON lines, nulls too, read again."""
    folder = new_folder(spark, "results")
    found = search.search_batch(full_index(spark, sf_dir), asked(spark, sf_dir)).withColumn("note", F.when(F.col("rank") == 1, "best"))
    report.save_results(found, folder)
    return spark.read.schema("query_id bigint, rank bigint, doc_id bigint, score double, note string").json(folder)


SQL["results_file"] = _with() + " SELECT query_id, rank, doc_id, round(score, 6) AS score, CASE WHEN rank = 1 THEN 'best' END AS note FROM ranked WHERE rank <= 10"


@query
def generated_corpus(spark, sf_dir):
    """A generated document for each of the corpus's, and what all of them are made by: topic, number and length."""
    made = corpus.generated(spark, table(spark, sf_dir, "documents").count())
    words = F.split("content", " ")
    return made.select("id", F.col("title") == F.concat(F.lit("Notes on "), F.variant_get("metadata", "$.topic", "string"), F.lit(" "), F.substring("id", 5, 20)), F.size(words), F.variant_get("metadata", "$.generated", "boolean")).toDF("id", "titled", "n_words", "generated")


SQL["generated_corpus"] = "SELECT 'doc_' || (row_number() OVER () - 1) AS id, true AS titled, 40::INTEGER AS n_words, true AS generated FROM documents"


@query
def sample_documents(spark, sf_dir):
    """The sample corpus, through dictionaries in memory and back."""
    back = corpus.from_rows(spark, corpus.to_rows(corpus.sample_corpus(spark)))
    return back.select("id", "title", F.variant_get("metadata", "$.position", "int").alias("position"), F.variant_get("metadata", "$.topic", "string").alias("topic"))


SQL["sample_documents"] = """SELECT 'd' || position AS id, title, position::INTEGER AS position, topic FROM (VALUES (1, 'Inverted indexes', 'search'), (2, 'Ranking functions', 'search'), (3, 'Columnar files', 'engine'),
    (4, 'Shuffle joins', 'engine'), (5, 'Broadcast joins', 'engine'), (6, 'Stop words', 'search'), (7, 'Recall and precision', 'search'), (8, 'Streams of documents', 'search'), (9, 'Query planning', 'engine'), (10, 'Tokenization', 'search')) v(position, title, topic)"""


# Unfolding


@query
def unfold_tree(spark, sf_dir):
    """Each region's key as the root of a binary tree of four levels below it."""
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("value"))
    return compose.unfold(roots, lambda v: F.array(v * 2 + 1, v * 2 + 2), 4)


_UNFOLD = """
    WITH RECURSIVE t(root, depth, parent, value) AS (
      SELECT r_regionkey::BIGINT, 0::BIGINT, NULL::BIGINT, r_regionkey::BIGINT FROM region
      UNION ALL SELECT root, depth + 1, value, value * 2 + k FROM t, (VALUES (1), (2)) s(k) WHERE depth < 4{more})
    SELECT root, depth, parent, value FROM t"""
SQL["unfold_tree"] = _UNFOLD.format(more="")


@query
def conditional_unfold(spark, sf_dir):
    """The same, but multiples of three have no successors."""
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("value"))
    return compose.unfold(roots, lambda v: F.array(v * 2 + 1, v * 2 + 2), 4, lambda v: v % 3 == 0)


SQL["conditional_unfold"] = _UNFOLD.format(more=" AND value % 3 <> 0")


@query
def unfold_edges(spark, sf_dir):
    """Regions, their nations, those nations' customers."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("value"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("value"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("value"))
    return compose.unfold_edges(region, nations.unionByName(customers), 2)


SQL["unfold_edges"] = """
    SELECT 'r' || r_regionkey AS root, 0::BIGINT AS depth, NULL::VARCHAR AS parent, 'r' || r_regionkey AS value FROM region
    UNION ALL SELECT 'r' || n_regionkey, 1, 'r' || n_regionkey, 'n' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'r' || n_regionkey, 2, 'n' || n_nationkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query
def trajectory(spark, sf_dir):
    """Five steps of a map on the numbers, from every part's size."""
    states = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("value"))
    return compose.trajectory(states, lambda v: F.when(v % 2 == 0, (v / 2).cast("bigint")).otherwise(v * 3 + 1), 5)


SQL["trajectory"] = """
    WITH RECURSIVE t(start, n, value) AS (
      SELECT p_partkey::BIGINT, 0::BIGINT, p_partkey::BIGINT FROM part
      UNION ALL SELECT start, n + 1, CASE WHEN value % 2 = 0 THEN value // 2 ELSE value * 3 + 1 END FROM t WHERE n < 5)
    SELECT start, n, value FROM t"""
