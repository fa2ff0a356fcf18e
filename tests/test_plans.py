import threading

import pytest
from pyspark.sql import functions as F

from termlake import cli
from termlake.engine import Engine
from termlake.plans import compose
from termlake.plans.cache import ResultCache, memoized
from termlake.sources.corpus import sample_corpus


def test_steps_compose():
    add, double = compose.Step(lambda x: x + 1), compose.Step(lambda x: x * 2)
    for x in range(5):
        assert ((add >> double) >> add)(x) == (add >> (double >> add))(x) == 2 * x + 3
        assert (compose.identity >> add)(x) == (add >> compose.identity)(x) == add(x)
    assert compose.chain(add, add, double)(1) == 6 and compose.chain()(3) == 3


def test_lifting(spark):
    df = spark.createDataFrame([([1, 2], 3), (None, None)], "a array<int>, n int")
    got = df.select(compose.over_list(lambda x: x + 1)(F.col("a")), compose.over_optional(lambda x: F.coalesce(x, F.lit(0)) * 2)(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [([2, 3], 6), (None, None)]
    tree = spark.createDataFrame([(1, None, 0, 5), (2, 1, 1, 6)], "node int, parent int, depth int, value int")
    assert [r.value for r in compose.over_tree(tree, lambda v: v * 10).orderBy("node").collect()] == [50, 60]


def test_unfolding(spark):
    roots = spark.createDataFrame([(0,)], "value bigint")
    grow = lambda v: F.array(v * 2 + 1, v * 2 + 2)
    assert compose.unfold(roots, grow, 2).count() == 7
    assert [tuple(r) for r in compose.unfold(roots, grow, 0).collect()] == [(0, 0, None, 0)]
    assert {r.value for r in compose.unfold(roots, grow, 3, lambda v: v >= 2).collect()} == {0, 1, 2, 3, 4} 
    edges = spark.createDataFrame([(0, 1), (1, 0)], "parent bigint, value bigint")
    assert [r.value for r in compose.unfold_edges(roots, edges, 4).orderBy("depth").collect()] == [0, 1, 0, 1, 0]
    assert [r.value for r in compose.trajectory(roots, lambda v: v + 2, 3).orderBy("n").collect()] == [0, 2, 4, 6]


def test_cache_keeps_what_was_used_last():
    cache = ResultCache(3)
    for k in "abc":
        cache.put(k, k.upper())
    assert cache.get("a") == "A" and cache.get("x") is None
    cache.put("d", "D")
    assert cache.get("b") is None and cache.get("a") == "A"
    assert cache.stats()["hits"] == 2 and cache.stats()["misses"] == 2
    cache.clear()
    assert cache.stats() == {"size": 0, "capacity": 3, "hits": 0, "misses": 0, "hit_rate": 0.0}
    none = ResultCache(0)
    none.put("a", 1)
    assert none.get("a") is None
    with pytest.raises(ValueError):
        ResultCache(-1)


def test_cache_is_safe_between_threads():
    cache = ResultCache(50)
    work = lambda: [(cache.put(i % 70, i), cache.get(i % 90)) for i in range(3000)]
    threads = [threading.Thread(target=work) for _ in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert cache.stats()["size"] <= 50 and cache.hits + cache.misses == 18_000


def test_memoized():
    calls = []
    f = memoized(lambda x, y=0: calls.append(x) or x + y)
    assert f(1, y=2) == f(1, y=2) == 3 and f(1) == 1 and len(calls) == 2
    assert f.info() == {"size": 2, "hits": 1}


def test_prompt(spark):
    said = []
    prompt = cli.Prompt(Engine(sample_corpus(spark)), 3, said.append)
    prompt.explain("d1")
    assert said == ["search first"]
    said.clear()
    assert prompt.line("inverted index terms") and said and said[0].startswith("1. Inverted indexes [d1]") and "*index*" in said[0].lower()
    said.clear()
    assert prompt.line(":explain d1") and any(s.startswith("inverted: ") for s in said)
    for text, word in ((":top 0", "at least 1"), (":k x", "at least 1"), (":explain", "needs"), (":nope", "unknown"), (":help", ":quit"), (":stats", "documents 10"), ("zzzz", "no results")):
        said.clear()
        assert prompt.line(text) and word in said[-1]
    assert prompt.line(":top 1") and prompt.k == 1 and prompt.line("  ")
    assert not prompt.line(":q") and not prompt.line(":exit")


def test_arguments(capsys):
    options = cli.arguments(["-q", "x", "-k", "3", "--stats", "-c", "f"])
    assert (options.query, options.top_k, options.stats, options.corpus, options.dataset) == ("x", 3, True, "f", None)
    with pytest.raises(SystemExit):
        cli.arguments(["--version"])


def test_exit_codes(spark, monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(cli.SparkSession.builder, "getOrCreate", lambda: spark, raising=False)
    assert cli.main(["-q", "index", "-k", "2"]) == 0 and "[d1]" in capsys.readouterr().out
    assert cli.main(["-k", "0", "-q", "x"]) == 1
    assert cli.main(["-c", str(tmp_path / "none.jsonl"), "--stats"]) == 1

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr("builtins.input", stop)
    assert cli.main([]) == 130


def test_lifts_keep_identity_and_composition(spark):
    f, g = (lambda v: v + 1), (lambda v: v * 2)
    rows = spark.createDataFrame([([1, 2, 3], 4), ([], None)], "many array<int>, one int")
    for lift, column in ((compose.ListLift(), "many"), (compose.OptionalLift(), "one")):
        assert isinstance(lift, compose.Lift)
        got = rows.select(lift(lambda v: v)(F.col(column)), lift(lambda v: g(f(v)))(F.col(column)), lift(g)(lift(f)(F.col(column)))).collect()
        assert [r[0] for r in got] == [r[0] for r in rows.select(column).collect()] and all(r[1] == r[2] for r in got)
    tree = spark.createDataFrame([(1, None, 0, 5), (2, 1, 1, 6)], "node int, parent int, depth int, value int")
    lift = compose.TreeLift()
    assert lift(lambda v: v)(tree).collect() == tree.collect()
    assert lift(g)(lift(f)(tree)).collect() == lift(lambda v: g(f(v)))(tree).collect()
    with pytest.raises(TypeError):
        compose.Lift()
