"""Quality classifier: hierarchical empirical Bayes over hosts and paths.

A document's own evidence: words are hashed, and each hash has the log odds of good against bad documents that hold it (naive Bayes); their
mean over a text is one feature beside the text's measures, and a logistic regression over all of them, fitted by Newton's method, says how
likely a document is good from its own text. Both are fitted on a bounded sample of labelled documents; for the regression, a document's
log odds come from the other half of the sample, so that it is fitted on what words say of texts that they weren't counted on.

These probabilities are summed by host and path over all documents. The rate of a host is shrunk towards the global rate, the rate of a
path towards that of its host, by a beta prior whose weight comes from the data (method of moments over all groups): a path
with few documents hardly moves from its host, a large one speaks for itself. Bayes' rule then takes the path's rate as the prior
of each of its documents, in place of the rate in the sample.

Where documents have an address, host and path come from it (``host_of``, ``path_of``). A table without addresses, such as
``documents``, has its source in place of the host, and the language within the source in place of the path.

Texts are read twice, first for the sums and then for the decisions, and never shuffled: what is shuffled are partial sums
of each path.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import fresh, quoted, settled
from termlake.llm.textstats import MEASURES, measured

#: The most labelled documents that the regression is fitted on: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Sites and paths are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_ROWS = 500_000
RIDGE, STEPS = 1.0, 30
FLOOR = 1e-4
#: Numbers that words are hashed to, and documents that count as having any word on either side.
HASHES, SMOOTH = 2048, 1.0


@dataclass(frozen=True)
class Evidence:
    """Weights on centred and scaled features, the intercept first, and the rate of good documents in the sample."""

    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    rate: float
    words: tuple[float, ...] = ()  #: log odds of each hash


FEATURES = (*MEASURES, "size", "lexical")


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without a leading ``www.`` or ``m.``; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(?:www|m)\.", "")


def path_of(url: Column) -> Column:
    """The first part of the path of an address, empty if there is none; null for what isn't an address."""
    return F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/([^/]*)", 1)


def hashed(words: Column) -> Column:
    """A number below HASHES for each word."""
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(HASHES)).cast("int"))


def _mean_odds(odds: Column) -> Callable[[Column], Column]:
    def mean(words: Column) -> Column:
        total = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.get(odds, F.pmod(F.xxhash64(w), F.lit(HASHES)).cast("int")))
        return F.when(F.size(words) > 0, total / F.size(words)).otherwise(0.0)

    return mean


def features(docs: DataFrame, text: Column, odds: Column | None = None) -> DataFrame:
    """``docs`` with what ``FEATURES`` names; ``odds``: array with the log odds of each hash, all 0 by default."""
    lexical = {"lexical": _mean_odds(odds)} if odds is not None else {}
    out = measured(docs, text, lexical).withColumn("size", F.log1p(F.col("n_words").cast("double")))
    return out if lexical else out.withColumn("lexical", F.lit(0.0))


def _odds(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log odds of each hash from how many bad and good documents have it, and how many there are."""
    share = (counts + SMOOTH) / (of[:, None] + 2 * SMOOTH)
    return np.log(share[1]) - np.log(share[0]) if of.min() > 0 else np.zeros(counts.shape[1])


def _literal(odds: np.ndarray) -> Column:
    return F.lit([float(x) for x in odds])


def fit(rows: np.ndarray, good: np.ndarray) -> Evidence:
    """Ridge logistic regression; without both kinds of labels, weights of 0 and the rate found (1 if none)."""
    if not len(good) or good.min() == good.max():
        rate = float(np.clip(good.mean() if len(good) else 1.0, FLOOR, 1 - FLOOR))
        k = rows.shape[1]
        return Evidence((math.log(rate / (1 - rate)), *[0.0] * k), (0.0,) * k, (1.0,) * k, rate)
    center, scale = rows.mean(0), np.maximum(rows.std(0), 1e-9)
    x = np.column_stack([np.ones(len(rows)), np.clip((rows - center) / scale, -8, 8)])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (good - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(tuple(map(float, w)), tuple(map(float, center)), tuple(map(float, scale)), float(np.clip(good.mean(), FLOOR, 1 - FLOOR)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Evidence:
    """Fit on at most ``sample`` labelled documents, whole texts. Labels that are null, or of no document, don't count; of several
    labels for an id the smallest does, and of several rows with the id the one with the smallest text. Without labels of both kinds only the
    rate is learned. Other columns are ignored, whatever their names."""
    known = labels.select(quoted(label_id).alias("id"), quoted(label_col).cast("double").alias("good")).dropna().groupBy("id").agg(F.min("good").alias("good"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))  # bounded by the parameter
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")
    held = settled(texts.join(chosen, "id").groupBy("id").agg(F.min("good").alias("good"), F.min("text").alias("text")).withColumn("half", half))
    good = (F.col("good") > 0).cast("int")
    has = measured(held.select("half", good.alias("good"), "text"), F.col("text"), {"h": lambda w: F.array_distinct(hashed(w))})
    totals, counts = np.zeros((2, 2)), np.zeros((2, 2, HASHES))  # by half, then label
    for r in has.groupBy("half", "good").count().collect():
        totals[r.half, r.good] = r["count"]
    for r in has.select("half", "good", F.explode("h").alias("h")).groupBy("half", "good", "h").count().collect():  # 4 x HASHES at most
        counts[r.half, r.good, r.h] = r["count"]
    other = F.when(F.col("half") == 0, _literal(_odds(counts[1], totals[1]))).otherwise(_literal(_odds(counts[0], totals[0])))
    found = features(held, F.col("text"), other).select("id", good.alias("good"), *FEATURES).toPandas().sort_values("id")
    model = fit(found[list(FEATURES)].to_numpy(float), found["good"].to_numpy(float))
    return replace(model, words=tuple(map(float, _odds(counts.sum(0), totals.sum(0)))))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(FLOOR)), F.lit(1 - FLOOR))


def evidence(model: Evidence) -> Column:
    """Probability that a document is good, from its features."""
    z = F.lit(model.weights[0])
    for name, w, c, s in zip(FEATURES, model.weights[1:], model.center, model.scale):
        z = z + F.least(F.greatest((F.col(name) - c) / s, F.lit(-8.0)), F.lit(8.0)) * w
    return _clipped(1 / (1 + F.exp(-z)))


def _weight(groups: DataFrame, up: str) -> Column:
    """Aggregate: the prior's weight in documents, from the spread of rates s / n around the rate ``up`` above.

    The rates of binomial groups of one rate spread by as much as Σ n (s/n - up)² / (up (1 - up)) = their number; what is more
    than this is spread of the rates themselves.
    """
    u = F.col(up)
    spread = F.sum(F.col("n") * (F.col("s") / F.col("n") - u) ** 2 / (u * (1 - u)))
    inner = (spread - F.count(F.lit(1))) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    rho = F.least(F.greatest(inner, F.lit(1e-5)), F.lit(0.999))
    return 1 / rho - 1


def priors(scored: DataFrame) -> DataFrame:
    """From documents with ``site, path, p``: for each site and path its number n, and ``prior``, its shrunk rate."""
    paths = settled(scored.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = sites.agg(_clipped(F.sum("s") / F.sum("n")).alias("world"))
    sites = sites.crossJoin(F.broadcast(total))  # one row
    weight = sites.agg(_weight(sites, "world").alias("m"))
    sites = sites.crossJoin(F.broadcast(weight)).select(F.col("site").alias("of"), _clipped((F.col("s") + F.col("m") * F.col("world")) / (F.col("n") + F.col("m"))).alias("site_rate"))
    paths = settled(paths.join(sites, F.col("site").eqNullSafe(F.col("of"))).drop("of"))
    weight = paths.agg(_weight(paths, "site_rate").alias("m"))
    return settled(paths.crossJoin(F.broadcast(weight)).select("site", "path", "n", _clipped((F.col("s") + F.col("m") * F.col("site_rate")) / (F.col("n") + F.col("m"))).alias("prior")))


def score(docs: DataFrame, model: Evidence, text_col: str = "text", site_col: str = "source", path_col: str = "lang", names: tuple[str, str, str] = ("evidence", "prior", "quality"), url_col: str | None = None) -> DataFrame:
    """``docs`` with the probability from the text, the path's rate, and both combined.

    With ``url_col``, host and path are those of the address there, and ``site_col`` and ``path_col`` don't count. Null hosts and paths are
    groups like any other. A text that is null or has no words has quality 0, and its host isn't judged by it. Texts are read to their
    ends. Repeated rows are judged alike, and count each. An empty table gives an empty result. All columns stay; if one has a name of
    ``names``, that is a ValueError.
    """
    clash = {n.lower() for n in names} & {c.lower() for c in docs.columns}
    if clash or len({n.lower() for n in names}) < 3:
        raise ValueError(f"names must be new and distinct: {', '.join(sorted(clash)) or names}")
    text = quoted(text_col).cast("string")
    site, path = (host_of(quoted(url_col)), path_of(quoted(url_col))) if url_col else (quoted(site_col), quoted(path_col))
    odds = _literal(np.array(model.words)) if any(model.words) else None
    bare = docs.select(site.alias("site"), path.alias("path"), text.alias("text"))
    rates = priors(features(bare, F.col("text"), odds).where("n_words > 0").select("site", "path", evidence(model).alias("p")))
    own = F.struct(*[quoted(c) for c in docs.columns]).alias("own")  # keeps names of the table apart from ours
    each = features(docs.select(own, site.alias("a"), path.alias("b"), text.alias("text")), F.col("text"), odds)
    each = each.select("own", "a", "b", F.when(F.col("n_words") > 0, evidence(model)).alias("p"))
    table = rates.select("site", "path", "prior")
    if rates.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    joined = each.join(table, F.col("a").eqNullSafe(F.col("site")) & F.col("b").eqNullSafe(F.col("path")), "left")
    z = _logit(F.col("p")) - _logit(F.lit(model.rate)) + _logit(F.col("prior"))
    quality = F.coalesce(1 / (1 + F.exp(-z)), F.lit(0.0))
    return joined.select("own.*", F.coalesce("p", F.lit(0.0)).alias(names[0]), F.col("prior").alias(names[1]), quality.alias(names[2]))


def keep(docs: DataFrame, model: Evidence, threshold: float = 0.5, text_col: str = "text", site_col: str = "source", path_col: str = "lang", url_col: str | None = None) -> DataFrame:
    """``docs``, all columns, without the documents whose quality is below the threshold: texts that are null or without words too. Repeated rows
    are judged alike, long texts by the whole; columns may have any names. An empty table gives an empty result."""
    names = fresh(docs, "evidence", "prior", "quality")
    return score(docs, model, text_col, site_col, path_col, tuple(names), url_col).where(quoted(names[2]) >= threshold).drop(*names)
