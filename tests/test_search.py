"""Scores by hand and by brute force; algebra of searches; the engine; storage; streams."""

import math
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from termlake import BM25Params, Engine
from termlake.functions import text as T
from termlake.functions.text import STOP_WORDS
from termlake.operators import evaluate, index, maintain, search
from termlake.sources import corpus
from termlake.streaming.ingest import arrived, compact, ingest
from tests.test_text import plain_tokens

FOUR = [("d1", "red apple red", ""), ("d2", "green apple", "pie"), ("d3", "blue sky", "over a green hill and a red barn"), ("d4", "", "the of and")]


def docs(spark, rows=FOUR):
    return spark.createDataFrame([(i, t, c) for i, t, c in rows], "id string, title string, content string")


@pytest.fixture(scope="module")
def held(spark):
    return index.build(docs(spark))


def words(text):
    return [w for w in plain_tokens(text) if w not in STOP_WORDS]


def brute(rows, query, p=BM25Params()):
    """Scores of all documents that have a term of the query."""
    held = {i: words(f"{t or ''} {c or ''}") for i, t, c in rows}
    n, avg = len(held), sum(map(len, held.values())) / len(held)
    df = Counter(w for ws in held.values() for w in set(ws))
    out = {}
    for i, ws in held.items():
        parts = [(q, ws.count(q)) for q in words(query) if q in ws]
        if parts:
            out[i] = sum(math.log((n - df[q] + 0.5) / (df[q] + 0.5) + 1) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(ws) / avg)) for q, tf in parts)
    return out


def pairs(df):
    return [(r["rank"], r.doc_id, r.score) for r in df.orderBy("rank").collect()]


def expected(scores, k=10):
    order = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return [(n, i, round(s, 6)) for n, (i, s) in enumerate(order, 1)]


def test_a_score_by_hand(held):
    # N = 4, lengths 3 3 7 0, mean 3.25; "apple" is in two documents, once in each, both of length 3
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    score = round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 3.25)), 6)
    assert pairs(search.search(held, "apple")) == [(1, "d1", score), (2, "d2", score)]
    assert held.corpus_stats.first().asDict() == {"num_docs": 4, "total_len": 13, "avgdl": 3.25, "num_terms": 9, "nnz": 12}
    assert {r.doc_id: r.dl for r in held.doc_stats.collect()} == {"d1": 3, "d2": 3, "d3": 7, "d4": 0}


@pytest.mark.parametrize("p", [BM25Params(), BM25Params(2.0, 0.3), BM25Params(0.0, 0.0)])
def test_brute_force(spark, held, p):
    asked = ["red", "red red apple", "green sky barn", "the red", "zzz red", "Apple PIE!"]
    found = search.search_batch(held, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), params=p).collect()
    for i, q in enumerate(asked):
        assert sorted((r["rank"], r.doc_id, r.score) for r in found if r.query_id == i) == expected(brute(FOUR, q, p))


def test_stored_and_on_demand_scores_agree(spark, tmp_path):
    held = index.build(docs(spark), keep=False)
    saved = held.save(str(tmp_path / "i"))
    other = BM25Params(1.2, 0.4)
    for p in (None, other):
        assert pairs(search.search(saved, "red green apple", params=p)) == pairs(search.search(held, "red green apple", params=p)) == expected(brute(FOUR, "red green apple", p or BM25Params()))
    assert index.load(spark, str(tmp_path / "i")).params == BM25Params()
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "none"))


def test_no_terms_no_results(spark, held):
    for q in ("", "the and of", "xyzzy", None, "!!!"):
        assert search.search(held, q).count() == 0
    for k in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            search.search(held, "red", k)
    for bad in ((-1, 0.5), (1, 2), (1, -0.1)):
        with pytest.raises(ValueError):
            BM25Params(*bad)


def test_empty_corpus_and_nulls(spark):
    held = index.build(docs(spark, []))
    assert held.corpus_stats.first().asDict() == {"num_docs": 0, "total_len": 0, "avgdl": 0.0, "num_terms": 0, "nnz": 0}
    assert search.search(held, "red").count() == 0
    assert pairs(search.search(index.build(docs(spark, [("a", None, "red"), ("b", None, None)])), "red"))[0][1] == "a"
    assert search.search(index.build(docs(spark, [("a", "", "the"), ("b", "", "")])), "red").count() == 0
    for rows in ([("a", "x", "y"), ("a", "z", "")], [(None, "x", "y")]):
        with pytest.raises(ValueError):
            index.build(docs(spark, rows))


def test_ties_go_by_id_and_pages_follow(spark):
    rows = [(f"t{i}", "same words here", "") for i in range(9)]
    held = index.build(docs(spark, rows))
    first = search.search(held, "words", 4)
    assert [d for _, d, _ in pairs(first)] == ["t0", "t1", "t2", "t3"]
    assert [d for _, d, _ in pairs(search.search(held, "words", 4, exclude=first))] == ["t4", "t5", "t6", "t7"]


def test_a_batch_is_its_single_searches(spark, held):
    asked = ["red apple", "", "green", "red apple", "zzz"]
    rows = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    batch = search.search_batch(held, rows, 3)
    for i, q in enumerate(asked):
        assert pairs(batch.where(F.col("query_id") == i)) == pairs(search.search(held, q, 3))


def test_scores_add_up_over_queries(spark, held):
    score = lambda q: {d: s for _, d, s in pairs(search.search(held, q))}
    a, b, both = score("red sky"), score("red green"), score("red sky red green")
    assert both == pytest.approx({d: a.get(d, 0) + b.get(d, 0) for d in a.keys() | b.keys()}, abs=3e-6)


def test_explanations(spark, held):
    asked = spark.createDataFrame([(0, "red red apple zzz")], "query_id int, query string")
    wanted = spark.createDataFrame([(0, "d1"), (0, "d4"), (0, "none")], "query_id int, doc_id string")
    got = {(r.doc_id, r.term): r.term_score for r in search.explain(held, asked, wanted).collect()}
    assert len(got) == 9 and {v for (d, _), v in got.items() if d != "d1"} == {0.0} and got["d1", "zzz"] == 0
    once = brute(FOUR, "red apple")["d1"]
    assert sum(v for (d, _), v in got.items() if d == "d1") == pytest.approx(once, abs=2e-6)


def test_given_documents_are_all_ranked(spark, held):
    asked = spark.createDataFrame([(0, "red")], "query_id int, query string")
    wanted = spark.createDataFrame([(0, d) for d in ("d2", "d1", "d4")], "query_id int, doc_id string")
    assert [d for _, d, _ in pairs(search.rank_documents(held, asked, wanted))] == ["d1", "d2", "d4"]


def test_changes(spark):
    more = docs(spark, [("n1", "red red red", "")])
    grown = maintain.added(docs(spark), more)
    assert pairs(search.search(index.build(grown), "red")) == expected(brute([*FOUR, ("n1", "red red red", "")], "red"))
    back = maintain.removed(grown, spark.createDataFrame([("n1",)], "id string"))
    assert pairs(search.search(index.build(back), "red apple")) == expected(brute(FOUR, "red apple"))
    with pytest.raises(ValueError):
        maintain.added(docs(spark), docs(spark, FOUR[:1]))
    with pytest.raises(ValueError):
        maintain.added(docs(spark), docs(spark, [("x", "", ""), ("x", "", "")]))
    with pytest.raises(ValueError):
        maintain.removed(docs(spark), spark.createDataFrame([("none",)], "id string"))


def test_engine(spark, tmp_path):
    engine = Engine(docs(spark), cache_size=2)
    first = engine.results("red apple", 2)
    assert [r.doc_id for r in first] == [d for _, d, _ in expected(brute(FOUR, "red apple"), 2)]
    assert engine.results("red apple", 2) == first and engine.results("", 2) == []
    assert engine.cache.stats() == {"size": 1, "capacity": 2, "hits": 1, "misses": 2, "hit_rate": 1 / 3}
    engine.add(docs(spark, [("n1", "red red red", "")]))
    assert engine.results("red", 1)[0].doc_id == "n1"
    engine.remove(["n1"])
    assert engine.results("red", 1)[0].doc_id == "d1"
    engine.save(str(tmp_path / "e"))
    loaded = Engine.load(str(tmp_path / "e"), docs(spark))
    assert [r.score for r in loaded.results("red apple")] == [r.score for r in engine.results("red apple")]
    assert loaded.search_batch(["red", ""]).where("query_id = 0").count() == 2
    assert {r.term for r in loaded.explain("red apple", ["d1"]).collect()} == {"red", "apple"}
    assert "*red*" in loaded.snippets("barn red", mark="*").where("doc_id = 'd3'").first().snippet


def test_plans_push_terms_to_the_scan_and_prune_columns(spark, tmp_path):
    saved = index.build(docs(spark), keep=False).save(str(tmp_path / "p"))
    plan = search.search(saved, "red apple")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan or "PushedFilters: [In(term" in plan or "EqualTo(term" in plan
    assert "ReadSchema: struct<term:string,doc_id:string,weight:double>" in plan


def test_quality_metrics(spark):
    found = spark.createDataFrame([(1, r, d) for r, d in ((1, "a"), (2, "b"), (3, "c"), (11, "z"))] + [(3, 1, "q")], "query_id int, rank bigint, doc_id string")
    judged = spark.createDataFrame([(1, "b"), (1, "x"), (1, "z"), (2, "a")], "query_id int, doc_id string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r.query_id: r[1:] for r in evaluate.quality(found, judged, asked).collect()}
    ideal = sum(1 / math.log2(i + 2) for i in range(3))
    assert got[1] == pytest.approx((1 / 3, (1 / math.log2(3)) / ideal, 0.5), abs=1e-6)
    assert got[2] == got[3] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("n", [0, 1, 20, 21, 1000])
def test_latency(spark, n):
    sample = [((i * 7919) % 1000) / 7 for i in range(n)]
    row = evaluate.latency_summary(spark.createDataFrame([(v,) for v in [*sample, None]], "v double"), "v").first()
    assert row.n == n
    if n:
        ordered = sorted(sample)
        assert row.p95 == pytest.approx(ordered[int(n * 0.95)], abs=1e-6)
        assert row.median == pytest.approx((ordered[(n - 1) // 2] + ordered[n // 2]) / 2, abs=1e-6)


def test_stream(spark, tmp_path):
    rows = [(i, t, c) for i, t, c in FOUR]
    source, folder = tmp_path / "in", str(tmp_path / "index")
    for k, part in enumerate((rows[:2], rows[2:])):
        docs(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id string, title string, content string").parquet(str(source))
        ingest(stream, folder, str(tmp_path / "state")).awaitTermination()
    assert pairs(search.search(arrived(spark, folder), "red apple")) == expected(brute(FOUR, "red apple"))
    docs(spark, [("d1", "nothing", "")]).coalesce(1).write.mode("append").parquet(str(source))
    ingest(stream, folder, str(tmp_path / "state")).awaitTermination()
    assert "d1" not in [d for _, d, _ in pairs(search.search(arrived(spark, folder), "red apple"))]


def test_sampled_queries_and_generated(spark):
    made = corpus.generated(spark, 50)
    assert made.count() == 50 and made.select("id").distinct().count() == 50
    asked = corpus.sampled_queries(made, 7)
    assert asked.count() == 7 and asked.collect() == corpus.sampled_queries(made, 7).collect()
    assert evaluate.topic_distribution(made).agg(F.sum("n")).first()[0] == 50


def test_scores_do_not_depend_on_the_order_of_postings(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    rows = [(f"d{i:02}", "", " ".join(w for k, w in enumerate(words) if (i // 2 * 7 + k * k) % 5)) for i in range(30)]  # each text twice
    held = index.build(docs(spark, rows)).save(str(tmp_path / "order"))
    asked = search.query_terms(spark.createDataFrame([(1, " ".join(words))], "query_id int, query string"))
    found = []
    for n in (1, 3, 8):
        mixed = replace(held, weights=held.weights.repartition(n, F.rand(n)))
        found.append({r.doc_id: r.score for r in search.scores(mixed, asked).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 30
    assert all(found[0][f"d{i:02}"] == found[0][f"d{i + 1:02}"] for i in range(0, 30, 2))
    want = brute(rows, " ".join(words))
    assert all(abs(found[0][i] - s) < 1e-12 for i, s in want.items())


TALK = [("t1", "", "To be or not to be, that is the question"), ("t2", "", "Running and walking"), ("t3", "", "She runs; he walked to it")]


def test_one_analyzer_for_documents_and_queries(spark, tmp_path):
    keep = index.build(docs(spark, TALK), analyzer=T.Analyzer(stop=False))
    assert [d for _, d, _ in pairs(search.search(keep, "to be"))] == ["t1", "t3"]
    assert pairs(search.search(index.build(docs(spark, TALK)), "to be")) == []
    for held in (lambda i: i, lambda i: i.save(str(tmp_path / "stem"))):
        three = held(index.build(docs(spark, TALK), analyzer=T.Analyzer(normalize="prefix5")))
        assert [d for _, d, _ in pairs(search.search(three, "walking"))] == ["t2"] and three.analyzer == T.Analyzer(normalize="prefix5")
    own = index.build(docs(spark, TALK), analyzer=T.Analyzer(normalize=lambda w: F.substring(w, 1, 3)))
    assert {d for _, d, _ in pairs(search.search(own, "runner"))} == {"t2", "t3"}
    with pytest.raises(ValueError, match="NORMALIZERS"):
        own.save(str(tmp_path / "own"))
    with pytest.raises(ValueError, match="no normalizer"):
        T.Analyzer(normalize="nope")
    saved = keep.save(str(tmp_path / "keep"))
    assert saved.analyzer == T.Analyzer(stop=False) and [d for _, d, _ in pairs(search.search(saved, "to be"))] == ["t1", "t3"]
    engine = Engine(docs(spark, TALK), analyzer=T.Analyzer(stop=False))
    engine.remove(["t3"])
    assert [r.doc_id for r in engine.results("to be")] == ["t1"] and set(engine.phases.seconds) == {"build", "search"}


def test_saving_tokenizes_once_and_shuffles_postings_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    lazy = index.build(docs(spark), keep=False)
    scans, real = [], index.stored

    def stored(df, path=None):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, path)

    monkeypatch.setattr(index, "stored", stored)
    saved = lazy.save(str(tmp_path / "once"))
    assert sum("regexp_extract_all" in plan for plan in scans) == 2 and seen.value == 0  # counts, and lengths for documents without terms
    assert pairs(search.search(saved, "red apple")) == expected(brute(FOUR, "red apple"))


def test_cached_index_is_built_once_for_a_corpus(spark, tmp_path, monkeypatch):
    built, real = [], index.build
    monkeypatch.setattr(index, "build", lambda *a, **k: built.append(1) or real(*a, **k))
    for rows in (FOUR, FOUR, FOUR[:3]):
        held = index.cached(docs(spark, rows), str(tmp_path))
        assert pairs(search.search(held, "red apple")) == expected(brute(rows, "red apple"))
    assert len(built) == 2


def test_judgments_by_the_rarest_term_are_those_of_every_pair(spark):
    texts = [(i, t) for i, t in enumerate(["the red barn door", "a redbarn doors of it", "Red Barn", "red", "", None, "of the", "x red-barn. y", "café barn é", "say: the red barn doorway is"])]
    queries = [(i, q) for i, q in enumerate(["red barn door", "e red barn d", "red", "of the", "", None, "barn", "red-barn.", "é barn é", "absent words of mine", " red "])]
    got = evaluate.verbatim_judgments(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(queries, "query_id int, query string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((q, d) for q, w in queries if w for d, t in texts if t and w in t)


def test_stream_before_the_first_batch_and_compacted(spark, tmp_path):
    folder, source = str(tmp_path / "index"), tmp_path / "in"
    assert pairs(search.search(arrived(spark, folder), "red")) == [] and compact(spark, folder) == 0
    for k, part in enumerate((FOUR[:2], FOUR[2:], [("d1", "nothing", "")])):
        docs(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id string, title string, content string").parquet(str(source))
        ingest(stream, folder, str(tmp_path / "state")).awaitTermination()
        assert k == 1 or compact(spark, folder) > 0
        left = len(list((tmp_path / "index" / "runs").glob("batch=*")))
        assert left == (k == 1)
    assert "d1" not in [d for _, d, _ in pairs(search.search(arrived(spark, folder), "red apple"))]
    assert arrived(spark, folder).doc_stats.count() == 4


def test_pruning_by_upper_bounds_changes_no_result(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(f"d{i:03}", "", " ".join(rng.choice(["red", "green", "apple"]) for _ in range(rng.randrange(1, 9))) + (" rare" * rng.randrange(1, 3) if i % 9 == 0 else "")) for i in range(120)]
    held = index.build(docs(spark, rows))
    saved = held.save(str(tmp_path / "bounds"))
    for i in (held, saved):
        for query, k in (("rare red apple green", 5), ("red rare rare", 1), ("rare apple", 40), ("red", 3), ("absent", 3), ("", 2)):
            assert pairs(search.search_pruned(i, query, k)) == pairs(search.search(i, query, k)) == expected(brute(rows, query), k)
    plan = search.search_pruned(saved, "rare red apple green", 5)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan  # frequent terms' postings only for documents of the rare one


def test_scratch_folders_are_deleted(spark):
    from pathlib import Path

    from termlake import storage

    held = index.build(docs(spark))
    assert held.counts.count() and storage._made and storage.clean(spark) > 0
    assert not storage._made and not list(Path(storage.shared_folder(spark)).glob("index-*"))


def largest(df):
    """Rows of the largest partition."""
    return max(r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect())


def test_no_task_holds_all_candidates_or_a_whole_ranking(spark, tmp_path, monkeypatch):
    from termlake import storage

    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    rows = [(f"d{i:03}", "", "red " * (i % 7) + "apple " * (i % 3)) for i in range(200)]
    asked = spark.createDataFrame([(0, "red"), (1, "red apple"), (2, "none")], "query_id int, query string")
    held = index.build(docs(spark, rows))
    for i in (held, held.save(str(tmp_path / "parts"))):
        assert largest(search.scores(i, search.query_terms(asked))) < 60  # of 342 candidates, in 4 partitions otherwise
        wanted = asked.select("query_id").crossJoin(spark.createDataFrame([(r[0],) for r in rows] + [("other",)], "doc_id string"))
        found = search.rank_documents(i, asked, wanted.unionByName(wanted))
        got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect())
        for q, text in enumerate(("red", "red apple", "none")):
            scores = {d: 0.0 for d, *_ in [*rows, ("other",)]} | brute(rows, text)
            assert [r[1:] for r in got if r[0] == q] == expected(scores, len(scores))
    seen, real = [], search.stored
    monkeypatch.setattr(search, "stored", lambda df, path=None: seen.append(real(df, path)) or seen[-1])
    search.rank_documents(held, asked, wanted)
    placed = next(t for t in seen if "nth" in t.columns)
    assert placed.agg(F.max("nth")).first()[0] < 60 and placed.select("part").distinct().count() > 20  # 603 rows to be ordered


def test_rankings_have_queries_without_an_id_and_no_pairs(spark):
    held = index.build(docs(spark))
    asked = spark.createDataFrame([(None, "red"), (1, "red")], "query_id int, query string")
    wanted = spark.createDataFrame([(None, "d1"), (1, "d1"), (1, "d3")], "query_id int, doc_id string")
    got = search.rank_documents(held, asked, wanted).collect()
    assert {(r.query_id, r["rank"], r.doc_id, r.score > 0) for r in got} == {(None, 1, "d1", False), (1, 1, "d1", True), (1, 2, "d3", True)}
    assert search.rank_documents(held, asked, wanted.where("false")).collect() == []


def test_saved_postings_are_sorted_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    from termlake import storage

    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    rows = [(f"d{i:03}", "", f"same w{i} v{i % 7}") for i in range(200)]
    saved = index.build(docs(spark, rows), keep=False).save(str(tmp_path / "many"))
    files = saved.weights.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 20 and max(r["count"] for r in files) < 80  # of 600 postings, in 4 files otherwise
    again = saved.save(str(tmp_path / "again"))
    for i in (saved, again):
        assert sorted(map(tuple, i.weights.select("term", "doc_id", "tf", "dl").collect())) == sorted((w, d, 1, 3) for d, _, c in rows for w in c.split())
        assert i.corpus_stats.first().asDict() == {"num_docs": 200, "total_len": 600, "avgdl": 3.0, "num_terms": 208, "nnz": 600}
        assert pairs(search.search(i, "same v3")) == expected(brute(rows, "same v3"))


def test_a_stream_shuffles_only_documents_that_came_again(spark, tmp_path):
    folder, source = str(tmp_path / "index"), tmp_path / "in"
    plan = lambda: arrived(spark, folder).counts._jdf.queryExecution().optimizedPlan().toString()
    for part, again in ((FOUR[:2], False), (FOUR[2:], False), ([("d1", "nothing", ""), ("d5", "red", "")], True)):
        docs(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id string, title string, content string").parquet(str(source))
        ingest(stream, folder, str(tmp_path / "state")).awaitTermination()
        assert ("max_by" in plan()) == again
    now = [("d1", "nothing", ""), ("d5", "red", ""), *FOUR[1:]]
    assert pairs(search.search(arrived(spark, folder), "red apple")) == expected(brute(now, "red apple"))
    assert compact(spark, folder) == 3 and pairs(search.search(arrived(spark, folder), "red apple")) == expected(brute(now, "red apple"))


def test_postings_of_a_saved_index_get_their_idf_without_a_shuffle_of_frequent_terms(spark, tmp_path, monkeypatch):
    rows = [(f"d{i:02}", "", f"same w{i} v{i % 7}") for i in range(40)]
    want = {(t, d): s for t in ("same", "w7", "v2") for d, s in brute(rows, t).items()}
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for terms beyond it
    try:
        for limit, rare in ((100, 0), (8, 1), (3, 6)):
            monkeypatch.setattr(index, "BROADCAST_ROWS", limit)
            saved = index.build(docs(spark, rows), keep=False).save(str(tmp_path / f"at{limit}"))
            assert spark.read.parquet(str(tmp_path / f"at{limit}/params")).first().rare == rare
            got = {(r.term, r.doc_id): r.impact for r in saved.postings.collect()}
            assert len(got) == 120 and all(abs(got[k] - s) < 1e-12 for k, s in want.items())
            plan = saved.postings._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and ("REPARTITION_BY_NUM" in plan) == (rare > 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
