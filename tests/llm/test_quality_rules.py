import functools
import math
import re
from collections import defaultdict

from termlake.llm import quality_rules as q
from termlake.llm.textstats import MEASURES, SPACE, SYMBOLS, measured
from pyspark.sql import functions as F


def measures(text):
    words = re.findall(f"[^{SPACE}]+", text or "")
    if not words:
        return None
    lines, n = text.split("\n"), len(text)
    share = lambda keep: len(re.findall(f"[{keep}]", text)) / n
    return dict(
        mean_word=sum(map(len, words)) / len(words), symbols=share(SYMBOLS), capitals=share("A-Z"), digits=share("0-9"),
        n_words=len(words), size_chars=n, size_lines=len(lines), variety=math.log1p(len(set(words))) / math.log1p(len(words)), repeated_lines=1 - len(set(lines)) / len(lines),
    )


def brute(rows):
    """rows: (id, text, lang, source) -> ids kept."""
    found = [(i, m, lang, src) for i, t, lang, src in rows if (m := measures(t))]
    groups, langs = defaultdict(list), defaultdict(list)
    for _, m, lang, src in found:
        groups[lang, src].append(m)
        langs[lang].append(m)
    world = [m for _, m, _, _ in found]

    def quartiles(pool, k, above=None):
        xs = sorted(x[k] for x in pool)
        own = [xs[math.ceil(p * len(xs)) - 1] for p in (0.25, 0.75)]
        return own if above is None else [(len(xs) * o + q.PRIOR * a) / (len(xs) + q.PRIOR) for o, a in zip(own, above)]

    @functools.cache
    def limits(lang, src, k):
        of_lang = quartiles(langs[lang], k, quartiles(world, k))
        of_source = quartiles(groups[lang, src], k, of_lang)
        span = q.REACH * (of_lang[1] - of_lang[0])
        return max(of_lang[0], of_source[0]) - span, min(of_lang[1], of_source[1]) + span

    def fits(m, lang, src):
        for k in MEASURES:
            low, high = limits(lang, src, k)
            more = q.ALLOW[k][0] / m[q.ALLOW[k][1]]
            if not low - more - 1e-12 <= m[k] <= high + more + 1e-12:
                return False
        return True

    return sorted(i for i, m, lang, src in found if fits(m, lang, src))


def test_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id >= 0")
    docs = docs.withColumn("source", F.when(F.col("source") < "src15", F.lit("one")).otherwise(F.col("source")))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    got = sorted(r.doc_id for r in q.keep(docs).collect())
    assert got == brute(rows) and 0.6 * len(rows) < len(got) < len(rows)


def test_junk_goes_and_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in q.keep(docs).select("doc_id").collect()}
    rows = labels.collect()
    good, junk = ([r.doc_id in kept for r in rows if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.05 * len(junk)


def test_a_source_of_mostly_junk_keeps_little_of_it(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    bad = [r.text for r in docs.join(labels.where("quality = 0"), "doc_id").collect()]
    docs = docs.select("doc_id", "text", "lang", "source")
    for share in (0.5, 0.8):
        good = [r for r in docs.where("lang = 'en' AND source = 'src5'").collect() if r.text not in bad]
        rows = [(10_000 + i, bad[i % len(bad)], "en", "junk yard") for i in range(round(len(good) * share / (1 - share)))] + [(r.doc_id, r.text, "en", "junk yard") for r in good]
        every = docs.where("source <> 'src5'").unionByName(spark.createDataFrame(rows, docs.schema))
        kept = {r.doc_id for r in q.keep(every).where("source = 'junk yard'").collect()}
        junk, fine = [i in kept for i, *_ in rows if i >= 10_000], [i in kept for i, *_ in rows if i < 10_000]
        assert len(junk) > 20 and sum(junk) < 0.12 * len(junk) and sum(fine) > 0.75 * len(fine)


def test_sketches_of_parts_merge(spark):
    rows = [(i, "word " * 20 + "x" * (i % 50), "en", "s") for i in range(5000)]
    one, many = (spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").repartition(n) for n in (1, 12))
    exact = sorted(measures(t)["mean_word"] for _, t, _, _ in rows)
    q1, q3 = exact[1249], exact[3749]
    for r in (q.ranges(d).first() for d in (one, many)):
        assert abs(r.mean_word_low - (q1 - q.REACH * (q3 - q1))) < 0.2 and abs(r.mean_word_high - (q3 + q.REACH * (q3 - q1))) < 0.2


def test_edges(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_words string, own int, symbols int, a int"
    assert q.keep(spark.createDataFrame([], schema)).count() == 0
    fine = "some plain words about this and that. " * 3
    rows = [(1, fine, None, None, "n", 1, 2, 3), (1, fine, None, None, "n", 1, 2, 3), (None, fine + "more", "en", None, "n", 1, 2, 3), (2, None, "en", "s", "n", 1, 2, 3), (3, " \n", "en", "s", "n", 1, 2, 3), (4, "$%& " * 50_000, "en", "s", "n", 1, 2, 3), (5, fine * 5000, "en", "s", None, 1, 2, 3)] + [(10 + i, fine + f"{i}", "en", "s", "n", 1, 2, 3) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    kept = q.keep(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and ids.count(1) == 2 and None in ids and not {2, 3, 4} & set(ids) and set(range(10, 50)) <= set(ids)
    assert measured(df.select("text"), F.col("text")).where("text IS NULL").first().n_words == 0
