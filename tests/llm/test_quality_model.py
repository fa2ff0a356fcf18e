import math
import re
from urllib.parse import urlsplit

import numpy as np
import pytest

from termlake.llm import quality_model as q
from termlake.llm.textstats import MEASURES, SPACE
from tests.llm.test_quality_rules import measures


def brute_priors(rows):
    """rows: (site, path, p) -> {(site, path): prior}, by the formulas in plain Python."""
    clip = lambda x: min(max(x, q.FLOOR), 1 - q.FLOOR)

    def sums(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + r[2])
        return out

    def weight(groups, up):
        spread = sum(n * (s / n - up[g]) ** 2 / (up[g] * (1 - up[g])) for g, (n, s) in groups.items())
        rho = (spread - len(groups)) / max(1, sum(n - 1 for n, _ in groups.values()))
        return 1 / min(max(rho, 1e-5), 0.999) - 1

    sites, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    world = clip(sum(r[2] for r in rows) / len(rows))
    m = weight(sites, dict.fromkeys(sites, world))
    rate = {g: clip((s + m * world) / (n + m)) for g, (n, s) in sites.items()}
    up = {g: rate[g[0]] for g in paths}
    m = weight(paths, up)
    return {g: clip((s + m * up[g]) / (n + m)) for g, (n, s) in paths.items()}


def test_priors_equal_brute_force_and_shrink(spark):
    rng = np.random.default_rng(5)
    rows = []
    for site, n, rate in (("big", 800, 0.9), ("bad", 500, 0.2), ("tiny", 1, 0.5), (None, 60, 0.7)):
        rows += [(site, "en" if rng.random() < 0.7 else None, float(np.clip(rng.normal(rate, 0.1), 0.01, 0.99))) for _ in range(n)]
    df = spark.createDataFrame(rows, "site string, path string, p double")
    got = {(r.site, r.path): r.prior for r in q.priors(df).collect()}
    want = brute_priors(rows)
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)
    assert got[("big", "en")] > 0.85 and got[("bad", "en")] < 0.3
    world = sum(r[2] for r in rows) / len(rows)
    own = next(r[2] for r in rows if r[0] == "tiny")
    (tiny,) = [v for g, v in got.items() if g[0] == "tiny"]
    assert abs(tiny - world) < abs(tiny - own) or abs(own - world) < 0.05


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, q.train(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, _ = trained
    model = q.train(docs, labels.where("doc_id % 2 = 0"))
    held = q.score(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "good"), "doc_id").collect()
    right = sum((r.quality >= 0.5) == (r.good == 1) for r in held)
    clean = [r for r in held if r.good == 1]
    assert right >= 0.95 * len(held) and sum(r.quality >= 0.5 for r in clean) >= 0.98 * len(clean)


def test_posterior_is_bayes_rule(trained):
    docs, _, model = trained
    logit = lambda p: math.log(p / (1 - p))
    for r in q.score(docs, model).limit(50).collect():
        assert r.quality == pytest.approx(1 / (1 + math.exp(-(logit(r.evidence) - logit(model.rate) + logit(r.prior)))))


def test_keep_equals_score(trained):
    docs, _, model = trained
    want = {r.doc_id for r in q.score(docs, model).where("quality >= 0.5").collect()}
    kept = q.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()


def test_edges(spark, trained):
    _, _, model = trained
    schema = "doc_id bigint, text string, lang string, source string, quality int, p string, prior string, site string, n_words int, words int"
    empty = spark.createDataFrame([], schema)
    assert q.keep(empty, model).count() == 0
    good = "The thing was on the road to the other and it is here for them. " * 5
    rows = [(1, good, None, None, 1, "x", "y", "z", 3, 4), (1, good, None, None, 1, "x", "y", "z", 3, 4), (None, good, "en", None, 1, None, "y", "z", 3, 4), (2, None, "en", "s", 1, "x", "y", "z", 3, 4), (3, "", "en", "s", 1, "x", "y", "z", 3, 4), (4, good * 4000, "en", "s", 1, "x", "y", "z", 3, 4)]
    df = spark.createDataFrame(rows, schema)
    got = q.score(df, model, names=("e", "b", "q")).collect()
    assert len(got) == 6 and all(r.q == 0 for r in got if not r.text) and got[0].prior == "y"
    assert q.keep(df, model).columns == df.columns
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert q.keep(df, q.train(df, labels)).count() == 4
    assert q.train(empty, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).rate == pytest.approx(1, abs=1e-3)


def test_names_that_clash(spark, trained):
    _, _, model = trained
    df = spark.createDataFrame([(1, "some text", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, Quality int")
    with pytest.raises(ValueError, match="quality"):
        q.score(df, model)


def xxhash(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"cast(pmod(xxhash64(w), {q.HASHES}) as int) AS h")
    return {r.w: r.h for r in rows.collect()}


def brute_features(text, odds, number):
    words = re.findall(f"[^{SPACE}]+", text or "")
    if not words:
        return None
    m = measures(text)
    return [*(m[k] for k in MEASURES), math.log1p(len(words)), sum(odds[number[w]] for w in words) / len(words)]


def brute_fit(rows, good):
    """Logistic regression with a ridge by gradient descent: another way to the same minimum."""
    x = np.array(rows)
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    x = np.column_stack([np.ones(len(x)), np.clip((x - center) / scale, -8, 8)])
    y, w = np.array(good, float), np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], q.RIDGE)
    ridge[0] = 0
    step = 1 / (0.25 * np.linalg.eigvalsh(x.T @ x).max() + q.RIDGE)
    v, t = w.copy(), 1.0
    for _ in range(60_000):
        new = v - step * (x.T @ (1 / (1 + np.exp(-(x @ v))) - y) + ridge * v)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w, center, scale


def test_whole_score_on_pages_with_addresses_equals_brute_force(spark):
    """Labels for pages follow from their numbers here; text, host and path are the pages' own."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    rows = [(r.page_id, r.url, re.sub(r"<[^>]*>", " ", r.html)) for r in rows] + [(1000 + i, u, t) for i, (u, t) in enumerate([(None, "some words here"), ("not an address", "more words"), ("http://www.Ex.org", "x y z"), ("https://ex.org/a/b?c", ""), ("http://m.ex.org/a#d", None)])]
    labels = [(i, int(len(t or "") % 3 > 0)) for i, _, t in rows if i % 4]
    schema = "page_id bigint, url string, text string"
    docs = spark.createDataFrame(rows, schema)
    model = q.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), id_col="page_id")
    got = {r.page_id: r for r in q.score(docs, model, url_col="url").collect()}

    number = xxhash(spark, sorted({w for _, _, t in rows for w in re.findall(f"[^{SPACE}]+", t or "")}))
    halves = {r.i: r.h for r in spark.createDataFrame([(i,) for i, *_ in rows], "i bigint").selectExpr("i", "pmod(xxhash64(i, 1), 2) AS h").collect()}
    text, label = {i: t for i, _, t in rows}, {i: g for i, g in labels if dict((a, c) for a, _, c in rows)[i] is not None}

    def odds(ids):
        out = []
        for h in range(q.HASHES):
            out.append(0.0)
        n = [sum(label[i] == g for i in ids) for g in (0, 1)]
        has = [{}, {}]
        for i in ids:
            for h in {number[w] for w in re.findall(f"[^{SPACE}]+", text[i])}:
                has[label[i]][h] = has[label[i]].get(h, 0) + 1
        return [math.log((has[1].get(h, 0) + q.SMOOTH) / (n[1] + 2 * q.SMOOTH)) - math.log((has[0].get(h, 0) + q.SMOOTH) / (n[0] + 2 * q.SMOOTH)) for h in range(q.HASHES)]

    by_half = [odds([i for i in label if halves[i] == h]) for h in (0, 1)]
    none = [0.0] * len(q.FEATURES)
    ids = sorted(label)
    w, center, scale = brute_fit([brute_features(text[i], by_half[1 - halves[i]], number) or none for i in ids], [label[i] for i in ids])
    rate, every = sum(label.values()) / len(label), odds(list(label))
    own = {}
    for i, _, t in rows:
        f = brute_features(t, every, number)
        if f:
            z = w[0] + sum(np.clip((np.array(f) - center) / scale, -8, 8) * w[1:])
            own[i] = min(max(1 / (1 + math.exp(-z)), q.FLOOR), 1 - q.FLOOR)

    def place(url):
        parts = urlsplit(url or "")
        if not parts.hostname:
            return None, None if url is None or " " in url else ""
        return re.sub(r"^(www|m)\.", "", parts.hostname), parts.path.split("/")[1] if "/" in parts.path else ""

    prior = brute_priors([(*place(u), own[i]) for i, u, _ in rows if i in own])
    assert len(prior) > 100 and len({h for h, _ in prior}) > 50
    logit = lambda p: math.log(p / (1 - p))
    for i, u, _ in rows:
        if i in own:
            assert got[i].evidence == pytest.approx(own[i], abs=2e-3) and got[i].prior == pytest.approx(prior[place(u)], abs=2e-3)
            assert got[i].quality == pytest.approx(1 / (1 + math.exp(-(logit(own[i]) - logit(rate) + logit(prior[place(u)])))), abs=5e-3)
        else:
            assert got[i].quality == 0


def test_a_word_of_bad_documents_counts_against_a_text(spark):
    fine = "The thing was on the road to the other and it is here for them"
    rows = [(i, f"{fine} {'wrongword' if i % 3 == 0 else 'rightword'} {i}") for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    model = q.train(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id bigint, quality int"))
    got = q.score(docs, model).collect()
    assert all((r.evidence > 0.5) == (r.doc_id % 3 > 0) for r in got)
