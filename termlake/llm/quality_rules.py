"""Quality rules with adaptive thresholds.

For each measure of a text the range of a language and source follows from quartiles. Quartiles come from KLL sketches, one for
each group and measure, which are built on each partition, shuffled as a few kilobytes and merged; the sketches of a language's sources are
merged once more for the language, those of the languages for the world. A level's quartiles are averaged with those of the level above,
weighted by its documents and by PRIOR: a source with few documents goes by its language, one with many by itself, and there is no number
at which one rule gives way to another.

A range reaches from the source's quartiles by REACH times the distance of the language's; and no further than the language's own. So a source,
be it junk for the most part, can't widen its limits, only narrow them. Besides, each document may have a few units more, ALLOW divided by its size:
a phone number is a third of a short note and nothing in a long text. Then documents are joined with the ranges and filtered.

A sketch with the parameter SIZE is exact up to that number of documents, and off by about 0.2 % in rank beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import quoted, settled
from termlake.llm.textstats import MEASURES, measured

SIZE = 2048
REACH = 3.0
#: Documents of a group that count as much as the level above.
PRIOR = 100
#: For each measure the units that a document may have beyond the range, and what they are divided by.
ALLOW = {"mean_word": (20.0, "n_words"), "symbols": (24.0, "size_chars"), "capitals": (24.0, "size_chars"), "digits": (64.0, "size_chars"), "variety": (2.0, "n_words"), "repeated_lines": (2.0, "size_lines")}
#: Ranges are broadcast up to this number of groups, and joined by shuffle beyond it.
BROADCAST_ROWS = 200_000


def _shrunk(own: Column, n: Column, above: Column, prior: float) -> Column:
    return (own * n + above * prior) / (n + prior)


def ranges(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size: int = SIZE, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """``lang, source, n`` and for each measure m ``m_low, m_high``, for each language and source (nulls are groups too) with a text that has
    words. Repeated rows count each time, texts are measured to their ends, an empty table has no ranges. Other columns are ignored."""
    rows = docs.select(quoted(lang_col).alias("lang"), quoted(source_col).alias("source"), quoted(text_col).cast("string").alias("text"))
    found = measured(rows, F.col("text")).where("n_words > 0")
    sketch = [F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(size)).alias(m) for m in MEASURES]
    merged = lambda of, to: [F.sum("n").alias(f"{to}_n"), *[F.kll_merge_agg_double(F.col(f"{of}{m}"), F.lit(size)).alias(f"{to}_{m}") for m in MEASURES]]
    sources = settled(found.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *sketch))
    langs = settled(sources.groupBy(F.col("lang").alias("of")).agg(*merged("", "lang")))
    world = langs.withColumnRenamed("lang_n", "n").agg(*merged("lang_", "world"))
    each = sources.join(langs, F.col("lang").eqNullSafe(F.col("of"))).crossJoin(F.broadcast(world))  # one row
    quartiles = F.array(F.lit(0.25), F.lit(0.75))
    three = each.select("lang", "source", "n", "lang_n", *[F.kll_sketch_get_quantile_double(f"{level}{m}", quartiles).alias(f"{level}{m}") for level in ("", "lang_", "world_") for m in MEASURES])
    out = []
    for m in MEASURES:
        low, high = (_shrunk(F.col(f"lang_{m}")[k], F.col("lang_n"), F.col(f"world_{m}")[k], prior) for k in (0, 1))
        own_low, own_high = (_shrunk(F.col(m)[k], F.col("n"), above, prior) for k, above in ((0, low), (1, high)))
        span = (high - low) * reach
        out += [(F.greatest(low, own_low) - span).alias(f"{m}_low"), (F.least(high, own_high) + span).alias(f"{m}_high")]
    return settled(three.select("lang", "source", "n", *out))


def keep(docs: DataFrame, limits: DataFrame | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", measures: bool = False, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents of which a measure is out of its range.

    All columns stay, whatever their names; with ``measures`` the result has, in place of them, ``doc_id`` (from ``id_col``), ``n_words`` and
    the measures, for the documents kept. A text that is null or has no words is out. Null languages and sources are groups like any other.
    Repeated rows are judged alike; texts are measured to their ends. ``limits``: from ``ranges``, by default those of ``docs`` itself; a document of
    a group that isn't there stays. An empty table gives an empty result.
    """
    if limits is None:
        limits = ranges(docs, text_col, lang_col, source_col, **options)
    table = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[f"{m}_{side}" for m in MEASURES for side in ("low", "high")])
    if limits.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    own = F.struct(*[quoted(c) for c in docs.columns]).alias("own")
    each = measured(docs.select(own, quoted(lang_col).alias("a"), quoted(source_col).alias("b"), quoted(text_col).cast("string").alias("text")), F.col("text"))
    each = each.select("own", "a", "b", "n_words", "size_chars", "size_lines", *MEASURES)
    joined = each.join(table, F.col("a").eqNullSafe(F.col("__lang")) & F.col("b").eqNullSafe(F.col("__source")), "left")
    fits = F.col("n_words") > 0
    for m in MEASURES:
        more = F.lit(ALLOW[m][0]) / F.col(ALLOW[m][1])
        fits &= F.coalesce(F.col(m).between(F.col(f"{m}_low") - more, F.col(f"{m}_high") + more), F.lit(True))
    if measures:
        return joined.where(fits).select(F.col("own").getField(id_col).alias("doc_id"), "n_words", *[F.round(m, 6).alias(m) for m in MEASURES])
    return joined.where(fits).select("own.*")


def _sql() -> str:
    from termlake.llm.textstats import SPACE, SYMBOLS

    def share(keep: str) -> str:
        return f"length(regexp_replace(text, '[^{keep}]+', '', 'g')) / length(text)"

    raw = {
        "mean_word": f"length(regexp_replace(text, '[{SPACE}]+', '', 'g')) / n_words",
        "symbols": share(SYMBOLS),
        "capitals": share("A-Z"),
        "digits": share("0-9"),
        "variety": "ln(1.0 + len(list_distinct(words))) / ln(1.0 + n_words)",
        "repeated_lines": "1 - len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10)))",
    }
    measures = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in raw.items())
    def quart(level: str) -> str:
        return ", ".join(f"quantile_disc({m}, 0.25) AS {level}_{m}_1, quantile_disc({m}, 0.75) AS {level}_{m}_3" for m in MEASURES)

    shrunk = lambda own, n, above: f"({own} * {n} + {above} * {PRIOR}) / ({n} + {PRIOR})"
    above = ", ".join(shrunk(f"l_{m}_{q}", "l_n", f"w_{m}_{q}") + f" AS a_{m}_{q}" for m in MEASURES for q in (1, 3))
    ends = ", ".join(
        f"greatest(a_{m}_1, {shrunk(f's_{m}_1', 's_n', f'a_{m}_1')}) - {REACH} * (a_{m}_3 - a_{m}_1) AS {m}_low, least(a_{m}_3, {shrunk(f's_{m}_3', 's_n', f'a_{m}_3')}) + {REACH} * (a_{m}_3 - a_{m}_1) AS {m}_high" for m in MEASURES
    )
    fits = " AND ".join(f"{m} BETWEEN {m}_low - {ALLOW[m][0]} / {ALLOW[m][1]} AND {m}_high + {ALLOW[m][0]} / {ALLOW[m][1]}" for m in MEASURES)
    return f"""
        WITH w AS (SELECT doc_id, text, lang, source, regexp_extract_all(text, '[^{SPACE}]+') AS words FROM documents),
             c AS (SELECT *, len(words) AS n_words FROM w WHERE len(words) > 0),
             f AS (SELECT doc_id, lang, source, n_words, length(text) AS size_chars, len(string_split(text, chr(10))) AS size_lines, {measures} FROM c),
             s AS (SELECT lang, source, count(*) AS s_n, {quart("s")} FROM f GROUP BY lang, source),
             g AS (SELECT lang, count(*) AS l_n, {quart("l")} FROM f GROUP BY lang),
             o AS (SELECT {quart("w")} FROM f),
             a AS (SELECT s.*, {above} FROM s JOIN g ON s.lang IS NOT DISTINCT FROM g.lang, o),
             r AS (SELECT lang, source, {ends} FROM a)
        SELECT doc_id, n_words::INTEGER AS n_words, {", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)}
        FROM f JOIN r ON f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source
        WHERE {fits}"""


SQL = _sql()
