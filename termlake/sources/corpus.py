"""Corpora: document tables, JSON lines, retrieval test sets.

A corpus is a DataFrame ``id string, title string, content string, metadata variant``, or any table from which
``from_table`` takes those parts. Metadata are kept but never indexed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id string, title string, content string, metadata variant"
FIELDS = ("id", "title", "content", "metadata")


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Documents from JSON lines. Blank lines are passed over; a malformed line is an error.

    With ``strict``, so is an object without an id, a title or contents, or with any other field. Files are split
    by Spark, and lines are parsed where they are read.
    """
    lines = spark.read.text(path).where(F.trim(F.translate("value", "\t\r", "  ")) != "")
    keys = F.json_object_keys("value")
    parsed = F.from_json("value", F.lit(DOCUMENT), {"mode": "FAILFAST"})
    if not strict:
        return lines.select(parsed.alias("d")).select("d.*")
    known = F.array(*map(F.lit, FIELDS))
    wrong = keys.isNull() | (F.size(F.array_except(keys, known)) > 0) | (F.size(F.array_except(F.array(*map(F.lit, FIELDS[:3])), keys)) > 0)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("a document needs id, title and content, and metadata at most: "), F.substring("value", 1, 200)))).otherwise(parsed)
    return lines.select(checked.alias("d")).select("d.*")


def write_jsonl(docs: DataFrame, path: str) -> None:
    """JSON lines with all four fields, nulls too, in a folder; a file for each partition."""
    docs.select(*FIELDS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A corpus from dictionaries in memory, with metadata of any JSON shape."""
    import json

    plain = [(r["id"], r["title"], r["content"], None if r.get("metadata") is None else json.dumps(r["metadata"])) for r in rows]
    held = spark.createDataFrame(plain, "id string, title string, content string, metadata string")
    return held.withColumn("metadata", F.parse_json("metadata"))


def to_rows(docs: DataFrame) -> list[dict]:
    """The documents as dictionaries, on the driver; for small corpora."""
    import json

    def plain(row: Row) -> dict:
        out = row.asDict(True)
        return out | {"metadata": None if out["metadata"] is None else json.loads(out["metadata"])}

    return [plain(r) for r in docs.withColumn("metadata", F.to_json("metadata")).toLocalIterator()]


def from_table(table: DataFrame, id_col: str = "doc_id", content_col: str = "text", title: Column | None = None, metadata: list[str] | None = None) -> DataFrame:
    """A corpus from a table: ``id`` (of the table's own type), title (empty by default), content, metadata columns."""
    extra = F.to_variant_object(F.struct(*metadata)) if metadata else F.lit(None).cast("variant")
    return table.select(F.col(id_col).alias("id"), (F.lit("") if title is None else title).alias("title"), F.col(content_col).alias("content"), extra.alias("metadata"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """Contents without tags, and without what scripts, styles and the head hold."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def from_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("id"), page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("content"), F.to_variant_object(F.struct("url")).alias("metadata"))


def repeated_ids(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """The id and ``count`` of ids that occur twice or more, or are null."""
    return docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1))


def distinct_ids(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """``docs``; an id that occurs twice, or null, is an error, raised here."""
    bad = repeated_ids(docs, id_col).first()
    if bad is not None:
        raise ValueError(f"document ids must be distinct and not null; {bad[0]!r} occurs {bad[1]} times")
    return docs


def read_retrieval_set(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries (query_id, query) and judgments (query_id, doc_id) of an unpacked retrieval test set.

    The folder holds ``corpus.jsonl`` and ``queries.jsonl`` with ``_id, title, text``, and ``qrels/<split>.tsv``. Judgments
    count if their grade is above 0 and the document is there; queries stay if they have one.
    """
    raw = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    corpus = from_table(raw, "_id", "text", F.coalesce("title", F.lit("")))
    grades = spark.read.options(sep="\t", header=True).schema("query_id string, doc_id string, grade int").csv(f"{folder}/qrels/{split}.tsv")
    judged = grades.where("grade > 0").join(raw.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi").select("query_id", "doc_id")
    asked = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    return corpus, asked.join(judged, "query_id", "left_semi"), judged


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, query) and judgments (query_id, doc_id) from JSON lines ``id, text, relevant_docs``."""
    raw = spark.read.option("mode", "FAILFAST").schema("id string, text string, relevant_docs array<string>").json(path)
    return raw.select(F.col("id").alias("query_id"), F.col("text").alias("query")), raw.select(F.col("id").alias("query_id"), F.explode("relevant_docs").alias("doc_id"))


def sampled_queries(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``query_id, query, doc_id``: the title, or a fragment from the middle, of ``n`` documents that a hash picks."""
    from termlake.functions.text import fragment

    titled = F.length(F.trim("title")) > 3
    query = F.when(titled, F.trim("title")).otherwise(fragment(F.col("content")))
    asked = docs.select(F.col("id").alias("doc_id"), query.alias("query")).where(F.size(F.split("query", r"\s+")) >= 3)
    place = F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")))
    return asked.orderBy(place, "doc_id").limit(n).select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"), "query", "doc_id")


def first(docs: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` documents in the order of a column."""
    return docs.orderBy(order).limit(n)


def read_dump(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """A dump of articles, JSON lines of ``id, title, text`` (or ``content``), from a local or shared path; the first ``max_docs`` by id."""
    raw = spark.read.schema("id string, title string, text string, content string").json(path)
    docs = raw.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", "text").alias("content"), F.lit(None).cast("variant").alias("metadata"))
    return docs if max_docs is None else first(docs, max_docs)


_TOPICS = {
    "storage": "disk page block cache shard replica segment compaction journal snapshot".split(),
    "weather": "storm front pressure cloud rainfall humidity breeze thunder frost drought".split(),
    "music": "chord rhythm melody tempo octave harmony violin chorus ballad quartet".split(),
    "garden": "soil seed compost pruning orchard mulch tulip hedge greenhouse harvest".split(),
}


def generated(spark: SparkSession, n: int, seed: int = 7, words: int = 40) -> DataFrame:
    """``n`` documents over four topics; the same for the same seed."""
    names = sorted(_TOPICS)
    topic = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(names))) + 1).cast("int"))
    words_of = F.element_at(F.create_map(*[x for t in names for x in (F.lit(t), F.array(*map(F.lit, _TOPICS[t])))]), F.col("topic"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.element_at(F.col("pool"), (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(10)) + 1).cast("int"))), " ")
    rows = spark.range(n).select("id", topic.alias("topic")).withColumn("pool", words_of)
    meta = F.to_variant_object(F.struct(F.col("topic"), F.lit(True).alias("generated")))
    return rows.select(F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("Notes on "), F.col("topic"), F.lit(" "), F.col("id").cast("string")).alias("title"), text.alias("content"), meta.alias("metadata"))


def sample_corpus(spark: SparkSession) -> DataFrame:
    """Ten short documents for examples."""
    texts = [
        ("d1", "Inverted indexes", "An inverted index maps each term to the documents that hold it, so a search touches few of them."),
        ("d2", "Ranking functions", "A ranking function weighs rare terms more, and damps the count of a term in a document."),
        ("d3", "Columnar files", "Columnar files keep the values of a column together; readers skip columns and row groups."),
        ("d4", "Shuffle joins", "Large tables are joined by a shuffle on their keys; skewed keys make slow partitions."),
        ("d5", "Broadcast joins", "A small table is sent to every executor, and the large table is joined where it lies."),
        ("d6", "Stop words", "Frequent words carry little meaning, and a search for them would touch every document."),
        ("d7", "Recall and precision", "Recall is the share of relevant documents found; precision the share of found ones that are relevant."),
        ("d8", "Streams of documents", "A stream appends documents to an index while searches go on over what has arrived."),
        ("d9", "Query planning", "A planner pushes filters to the scan, prunes columns and chooses how tables are joined."),
        ("d10", "Tokenization", "Text is cut into tokens in lower case before it is indexed or searched."),
    ]
    return from_rows(spark, [{"id": i, "title": t, "content": c, "metadata": {"topic": "search" if int(i[1:]) in (1, 2, 6, 7, 8, 10) else "engine", "position": int(i[1:])}} for i, t, c in texts])
