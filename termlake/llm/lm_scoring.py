"""LM scoring: a causal self-attention model in numpy on subword ids, with a memory of the corpus.

Documents are encoded once. Counts of all ids over the corpus order the vocabulary, of which every id is a symbol of its own
(``lm_model``).

Training covers the corpus: an epoch takes all windows of each document, so every token is a target once; those of a batch of
rows come in an order that ids and the epoch determine. A partition trains a replica of the model on its own documents; replicas are
averaged, weighted by tokens, FANIN at a time in as many rounds as it takes, and the driver gets one model. Of embeddings and leaves a
replica gives the blocks that it met, weighted by how often.

Scoring cuts a document into windows of CONTEXT + STRIDE places that overlap by CONTEXT: each scores its last STRIDE tokens, so each token is
scored once, and after at least CONTEXT others where the document has as many. Windows of all documents go through the model in
batches, with a mask for what is later and what is before the document's beginning.

A model of fixed size can't know what a growing corpus repeats, so there is also a memory, which grows with the corpus. The text itself
cuts a document into chunks of about CHUNK tokens: one ends where a hash of its last KEY ids says so. The memory counts how often each
chunk comes after the KEY ids before it, a document's own use left out. At each cut the next chunk is either recalled, with probability RECALL if
the place is known from elsewhere, or made token by token by the model: so the probability of a chunk is

    RECALL * (uses elsewhere after these ids) / (places elsewhere after these ids) + (1 - RECALL) * (the model's)

and the model's alone at a place that nothing else shares. What is shuffled is a row of a few numbers for each chunk; counts are summed
before they are shuffled, so a chunk that a third of all documents have is one row from each partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.llm import lm_model as M
from termlake.llm import tokens
from termlake.llm.common import settled
from termlake.llm.packing import _joined, encoded

#: Windows in a training step and in a scoring step.
BATCH, SCORE_BATCH = 128, 256
EPOCHS = 1
#: Replicas averaged at a time.
FANIN = 32
CHUNK, KEY, RECALL = 128, 8, 0.5
#: Tokens worked on at once in a worker.
PART = 1 << 19
_U = np.uint64


def counts(stream: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the whole corpus."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch)[0], minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    rows = stream.mapInArrow(task, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many as the vocabulary has
    out = np.zeros(vocabulary, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """As ``_joined``, about PART tokens at a time and never less than a document."""
    ids, lengths, docs = _joined(batch)
    ends = np.cumsum(lengths)
    at = first = 0
    while first < len(lengths):
        stop = max(first + 1, int(np.searchsorted(ends, at + PART, "right")))
        yield ids[at : ends[stop - 1]], lengths[first:stop], docs.slice(first, stop - first)
        first, at = stop, int(ends[stop - 1])


def symbols(found: np.ndarray) -> np.ndarray:
    """Symbol of each id: its rank by counts, ties by id."""
    out = np.empty(len(found), np.int64)
    out[np.lexsort((np.arange(len(found)), -found))] = np.arange(len(found))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def train(stream: DataFrame, found: np.ndarray, first: int = tokens.END, epochs: int = EPOCHS) -> M.Weights:
    """Weights after ``epochs`` passes over all documents; the same for the same partitions."""
    spark = stream.sparkSession.sparkContext
    symbol, size = symbols(found), len(found)
    weights = M.initial(-np.sort(-found))
    blocks = len(weights["emb"])
    partitions = stream.rdd.getNumPartitions()
    for epoch in range(epochs):
        shared = spark.broadcast((M.packed(weights), symbol))  # a few MB, whatever the corpus

        def task(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            data, symbol = shared.value
            model = M.Adam(M.unpacked(data, size))
            met = np.zeros((2, blocks), np.int64)  # of a block's symbols as inputs, as targets
            seen, held, n_held = 0, [], 0

            def learn() -> None:
                nonlocal n_held, seen
                inputs, before, targets, valid = (np.concatenate(c) for c in zip(*held))
                held.clear()
                if len(inputs) > BATCH:
                    held.append((inputs[BATCH:], before[BATCH:], targets[BATCH:], valid[BATCH:]))
                inputs, before, targets, valid = inputs[:BATCH], before[:BATCH], targets[:BATCH], valid[:BATCH]
                n_held -= len(inputs)
                seen += int(valid.sum())
                for k, of in ((0, inputs), (1, targets[valid])):
                    met[k] += np.bincount(M.block(of).reshape(-1) // M.SIZE, minlength=blocks)
                _, grad = M.loss_and_gradient(model.w, inputs, before, targets, valid)
                model.step(grad, M.RATE / (1 + 0.5 * epoch))

            for ids, lengths, doc_ids in (p for batch in batches for p in _parts(batch)):
                mapped = symbol[ids]
                starts = np.cumsum(lengths) - lengths
                key = np.array([0 if d is None else d for d in doc_ids.to_pylist()], np.int64).astype(_U)
                doc, number = M.windows(lengths)
                order = np.argsort(_mix(_mix(key[doc] * _U(4) + _U(epoch + 1)) + number.astype(_U)), kind="stable")
                for i in range(0, len(order), BATCH):
                    some = order[i : i + BATCH]
                    inputs, before, places, valid = M.cut(mapped, starts, lengths, doc[some], number[some], symbol[first])
                    held.append((inputs, before, mapped[places], valid))
                    n_held += len(some)
                    if n_held >= BATCH:
                        learn()
            if n_held:
                learn()
            if seen:
                part = TaskContext.get().partitionId()
                rows = [(part, -1, float(seen), 0.0, b"".join(model.w[k].tobytes() for k in M.CORE))]
                for b in np.flatnonzero(met.any(0)).tolist():
                    rows.append((part, b, float(met[0, b]), float(met[1, b]), b"".join(model.w[k][i].tobytes() for k, i in _at(b))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES.types)], schema=_PIECES)

        some = stream.mapInArrow(task, _pieces)
        for _ in range(max(1, math.ceil(math.log(max(2, partitions), FANIN)))):
            some = some.withColumn("part", F.floor(F.col("part") / FANIN).cast("int")).groupBy("piece", "part").applyInArrow(lambda table: _mean(table), _pieces)
        for r in some.collect():  # a row for each block of the vocabulary
            flat, at = np.frombuffer(r.weights, "<f4"), 0
            for k, i in _at(r.piece) if r.piece >= 0 else [(k, ...) for k in M.CORE]:
                to = weights[k][i]
                to[...] = flat[at : at + to.size].reshape(to.shape)
                at += to.size
    return weights


_pieces = "part int, piece int, inputs double, targets double, weights binary"
_PIECES = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("inputs", pa.float64()), ("targets", pa.float64()), ("weights", pa.binary())])


def _at(block: int) -> list[tuple[str, int]]:
    """What a block's piece has: its embeddings, and its leaves unless they are the head's."""
    return [("emb", block)] + ([("leaves", block - 1)] if block else [])


def _mean(table: pa.Table) -> pa.Table:
    """The average of at most FANIN replicas of a piece: of its first part by inputs (or tokens), of its second by targets."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["inputs"], r["targets"], r["weights"]))
    edge = len(np.frombuffer(rows[0]["weights"], "<f4")) if rows[0]["piece"] < 0 else M.SIZE * M.WIDTH
    out = []
    for weight, part in (("inputs", slice(0, edge)), ("targets", slice(edge, None))):
        n = sum(r[weight] for r in rows)
        each = [r[weight] / n if n else 1 / len(rows) for r in rows]
        out.append(sum(e * np.frombuffer(r["weights"], "<f4")[part].astype(float) for e, r in zip(each, rows)))
    return pa.Table.from_pylist([{"part": rows[0]["part"], "piece": rows[0]["piece"], "inputs": sum(r["inputs"] for r in rows), "targets": sum(r["targets"] for r in rows), "weights": np.concatenate(out).astype("<f4").tobytes()}], schema=_PIECES)


def token_scores(mapped: np.ndarray, lengths: np.ndarray, model: M.Scorer, first: int) -> np.ndarray:
    """Log probability of each token of documents in a row; ``first`` is the symbol before a document."""
    out = np.zeros(len(mapped), np.float32)
    starts = np.cumsum(lengths) - lengths
    doc, number = M.windows(lengths)
    for i in range(0, len(doc), SCORE_BATCH):
        inputs, before, places, valid = M.cut(mapped, starts, lengths, doc[i : i + SCORE_BATCH], number[i : i + SCORE_BATCH], first)
        out[places[valid]] = model(inputs, before, mapped[places])[valid]
    return out


_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def chunks(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents in a row: document, end, place hash and content hash of each chunk.

    The place hash is that of the KEY ids before the chunk, or of all there are, and how many those are; chunks don't cross documents.
    """
    n = len(ids)
    if len(_powers[0]) <= n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(2 * n + 1, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(ids.astype(_U) + _U(1)) * _powers[0][:n], dtype=_U)])
    of = lambda start, stop: _mix((total[stop] - total[start]) * _powers[1][start] + (stop - start).astype(_U))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    stop = np.arange(1, n + 1)
    begin = (ends - lengths)[doc]
    cut = of(np.maximum(begin, stop - KEY), stop) % _U(CHUNK) == 0
    cut[ends[lengths > 0] - 1] = True
    last = np.flatnonzero(cut) + 1
    doc = doc[last - 1]
    start = np.concatenate([[0], last[:-1]]) if len(last) else last
    return doc, last, of(np.maximum((ends - lengths)[doc], start - KEY), start), of(start, last)


def recalled(made: DataFrame, recall: float = RECALL) -> DataFrame:
    """``made`` (place, chunk, log_prob of the model, and any more) with ``log_prob`` as the memory of all of it makes it."""
    uses = made.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    places = uses.groupBy("place").agg(F.sum("uses").alias("places")).where("places > 1")
    known = uses.join(places, "place").where("places > 1").select(F.col("place").alias("p"), F.col("chunk").alias("c"), "uses", "places")
    joined = made.join(known, (F.col("place") == F.col("p")) & (F.col("chunk") == F.col("c")), "left")
    share = (F.col("uses") - 1) / (F.col("places") - 1) * recall
    own = F.col("log_prob") + math.log(1 - recall)
    high = F.greatest(own, F.log(share))  # null shares, of chunks used once, don't count
    mixed = F.when(F.col("places").isNull(), F.col("log_prob")).when(F.col("uses") < 2, own).otherwise(high + F.log(F.exp(own - high) + F.exp(F.log(share) - high)))
    return joined.select(*[c for c in made.columns if c != "log_prob"], mixed.alias("log_prob"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = tokens.VOCABULARY, end: int = tokens.END) -> DataFrame:
    """``doc_id, n_tokens, model_log_prob, log_prob, perplexity`` for each document with a text.

    ``n_tokens`` counts the end token, which is scored too; so an empty text has one. ``model_log_prob`` is the sum of natural
    logarithms over all tokens as the attention model alone has them, ``log_prob`` the same with the memory of the corpus, and
    ``perplexity`` the exponential of the negative mean of that. Null texts have no row. Repeated rows have a
    row, are trained on, and remember each other; null ids stay null. A long text is scored to its end, in windows like any other.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    stream = settled(encoded(docs, id_col, text_col, path, end, together=True))
    found = counts(stream, end + 1)
    size = len(found)
    shared = docs.sparkSession.sparkContext.broadcast((M.packed(train(stream, found, end)), symbols(found)))  # a few MB, whatever the corpus

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, symbol = shared.value
        model, row = M.Scorer(M.unpacked(data, size)), TaskContext.get().partitionId() << 33
        for ids, lengths, doc_ids in (p for batch in batches for p in _parts(batch)):
            each = np.concatenate([[0.0], np.cumsum(token_scores(symbol[ids], lengths, model, symbol[end]), dtype=np.float64)])
            doc, last, place, chunk = chunks(ids, lengths)
            first = np.concatenate([[0], last[:-1]])
            columns = [pa.array(row + doc), doc_ids.take(pa.array(doc)), pa.array((last - first).astype(np.int32)), pa.array(place.view(np.int64)), pa.array(chunk.view(np.int64)), pa.array(each[last] - each[first])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "place", "chunk", "log_prob"])
            row += len(lengths)

    made = settled(stream.mapInArrow(task, "row bigint, doc_id bigint, n int, place bigint, chunk bigint, log_prob double"))
    each = recalled(made.withColumn("own", F.col("log_prob"))).groupBy("row")
    summed = each.agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("own").alias("own"), F.sum("log_prob").alias("all"))
    return summed.select("doc_id", "n_tokens", F.round("own", 4).alias("model_log_prob"), F.round("all", 4).alias("log_prob"), F.round(F.exp(-F.col("all") / F.col("n_tokens")), 6).alias("perplexity"))
