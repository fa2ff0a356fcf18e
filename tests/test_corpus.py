import json

import pytest
from pyspark.sql import functions as F

from termlake.sources import corpus

ROWS = [
    {"id": "1", "title": 'Quotes "here"', "content": "line\nbreak 日本語 🎉", "metadata": {"nested": {"key": "value"}, "flag": True}},
    {"id": "2", "title": "", "content": "", "metadata": None},
]


def test_round_trip(spark, tmp_path):
    docs = corpus.from_rows(spark, ROWS)
    corpus.write_jsonl(docs, str(tmp_path / "c"))
    assert sorted(corpus.to_rows(corpus.read_jsonl(spark, str(tmp_path / "c"))), key=lambda r: r["id"]) == ROWS


def test_blank_lines_and_strict_fields(spark, tmp_path):
    good = '{"id": "1", "title": "t", "content": "c"}'
    path = tmp_path / "x.jsonl"
    path.write_text(f"\n{good}\n   \n\t\n")
    assert corpus.to_rows(corpus.read_jsonl(spark, str(path))) == [{"id": "1", "title": "t", "content": "c", "metadata": None}]
    for bad in ('{"id": "1", "title": "t"}', '{"id": "1", "title": "t", "content": "c", "more": 1}', "{broken", "[1]"):
        path.write_text(f"{good}\n{bad}\n")
        with pytest.raises(Exception):
            corpus.read_jsonl(spark, str(path)).collect()
    path.write_text('{"id": "1", "title": "t"}\n')
    assert corpus.read_jsonl(spark, str(path), strict=False).first().content is None


def test_pages(spark):
    html = "<html><head><title> A Title </title><style>b{}</style></head><body><p>Text</p><script>x()</script></body></html>"
    row = corpus.from_pages(spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id bigint, url string, html string")).orderBy("id").collect()
    assert row[0].title == "A Title" and row[0].content.split() == ["Text"]
    assert row[1].content is None


def test_retrieval_set(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("".join(json.dumps(r) + "\n" for r in ({"_id": "a", "text": "one"}, {"_id": "b", "title": "T", "text": "two"})))
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps(r) + "\n" for r in ({"_id": "q1", "text": "x"}, {"_id": "q2", "text": "y"})))
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\ta\t1\nq1\tb\t0\nq2\tgone\t2\n")
    docs, asked, judged = corpus.read_retrieval_set(spark, str(tmp_path))
    assert {(r.id, r.title) for r in docs.collect()} == {("a", ""), ("b", "T")}
    assert [r.query_id for r in asked.collect()] == ["q1"] and [tuple(r) for r in judged.collect()] == [("q1", "a")]
    (tmp_path / "own.jsonl").write_text('{"id": "1", "text": "t", "relevant_docs": ["a", "b"]}\n{"id": "2", "text": "u"}\n')
    asked, judged = corpus.read_queries(spark, str(tmp_path / "own.jsonl"))
    assert asked.count() == 2 and judged.count() == 2


def test_topics_and_distinct_ids(spark):
    docs = corpus.sample_corpus(spark)
    assert docs.count() == 10 and docs.select(F.variant_get("metadata", "$.topic", "string").alias("t")).where("t IS NULL").count() == 0
    assert corpus.distinct_ids(docs) is docs
