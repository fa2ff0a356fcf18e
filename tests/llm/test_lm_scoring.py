import math
from collections import Counter

import numpy as np
import pytest

from termlake.llm import lm_model as M
from termlake.llm import lm_scoring as lm
from termlake.llm import tokens

RNG = np.random.default_rng(11)
N = 2 * M.HEAD + 2000  # symbols: several branches of the tree


def weights(kind=np.float32):
    w = M.initial(-np.sort(-RNG.integers(0, 90, N)))
    out = {k: v + (RNG.standard_normal(v.shape) * 0.3).astype(np.float32) * (v > -1e8) for k, v in w.items()}
    return {k: v.astype(kind) for k, v in out.items()}


W = weights()


def norm(x):
    return x / math.sqrt(float((x * x).mean()) + float(M.EPS))


def log_softmax(x):
    x = x - x.max()
    return x - math.log(np.exp(x).sum())


def brute_state(inputs, w, t):
    """The state at place t of a document, with loops over the places before it."""
    start = max(0, t // M.STRIDE * M.STRIDE - M.CONTEXT)
    x = [w["emb"].reshape(-1, M.WIDTH)[s if s < M.HEAD else s + M.SIZE - M.HEAD].astype(float) for s in inputs[start : t + 1]]
    a = [norm(v) for v in x]
    s = np.array([norm(x[-1]) @ w["wq"] @ (k @ w["wk"]) / math.sqrt(M.WIDTH) + w["far"][t - start - j] for j, k in enumerate(a)])
    p = np.exp(log_softmax(s))
    return np.append(norm(x[-1] + sum(pi * (v @ w["wv"]) for pi, v in zip(p, a))), 1.0)


def brute_log_prob(z, w, symbol):
    """Log probability of a symbol, down the tree."""
    head = log_softmax(w["head"] @ z)
    if symbol < M.HEAD:
        return head[symbol]
    group, place = divmod(symbol - M.HEAD, M.SIZE)
    top, turn = divmod(group, M.FAN)
    return head[M.HEAD] + log_softmax(w["tops"][0] @ z)[top] + log_softmax(w["groups"][top] @ z)[turn] + log_softmax(w["leaves"][group] @ z)[place]


def test_each_token_is_scored_once_like_one_by_one():
    lengths = np.array([1, 5, M.STRIDE, M.STRIDE + 1, 200, M.PLACES, 3 * M.STRIDE + 1])
    text = RNG.integers(0, N, lengths.sum())
    got = lm.token_scores(text, lengths, M.Scorer(W), first=3)
    at = 0
    for n in lengths:
        own = text[at : at + n].tolist()
        want = [brute_log_prob(brute_state([3, *own[:-1]], W, t), W, own[t]) for t in range(n)]
        assert got[at : at + n] == pytest.approx(want, rel=2e-3, abs=2e-3)
        at += n


def test_probabilities_of_all_ids_add_up_to_one():
    z = np.repeat(brute_state([5, 300, 70, 2000, 9], W, 4)[None], N, 0).astype(np.float32)
    assert np.exp(M.Tree(W, z, np.arange(N)).logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    first = np.repeat(np.zeros((1, M.WIDTH + 1), np.float32), N, 0)
    first[:, -1] = 1
    found = -np.sort(-RNG.integers(0, 90, N))
    start = np.exp(M.Tree(M.initial(found), first, np.arange(N)).logs.astype(float))
    assert start == pytest.approx((found + 1) / (found + 1).sum(), rel=1e-3)  # to begin with, those of the counts


def test_order_matters():
    a, b = [5, 300, 70, 131, 9, 11], [70, 5, 131, 300, 9, 11]
    x, y = (lm.token_scores(np.array(t), np.array([6]), M.Scorer(W), 3)[-1] for t in (a, b))
    assert abs(x - y) > 1e-3


def test_windows_cover_every_place_once():
    lengths = np.array([1, 31, 32, 33, 0, 1000])
    starts = np.cumsum(lengths) - lengths
    doc, number = M.windows(lengths)
    _, _, places, valid = M.cut(np.arange(lengths.sum()), starts, lengths, doc, number, 0)
    assert sorted(places[valid].tolist()) == list(range(lengths.sum()))


def batch(n=3):
    inputs, before = RNG.integers(0, N, (n, M.PLACES)), np.array([0, M.CONTEXT, 5][:n])
    return inputs, before, RNG.integers(0, N, (n, M.STRIDE)), RNG.random((n, M.STRIDE)) < 0.8


def test_gradient_is_that_of_the_loss():
    w = weights(np.float64)
    inputs, before, targets, valid = batch()
    loss, grad = M.loss_and_gradient(w, inputs, before, targets, valid)
    full = dict(grad)
    for k in ("emb", "leaves"):
        full[k] = np.zeros_like(w[k])
        flat = full[k].reshape(-1, M.WIDTH) if k == "emb" else full[k]
        flat[M.block(grad[k][0]) if k == "emb" else grad[k][0]] = grad[k][1]
    for k in w:
        some = np.argwhere(np.abs(full[k]) > 1e-7)
        for at in map(tuple, some[RNG.integers(0, len(some), 5)]):
            both = []
            for step in (1e-5, -1e-5):
                moved = {n: v.copy() for n, v in w.items()}
                moved[k][at] += step
                both.append(M.loss_and_gradient(moved, inputs, before, targets, valid)[0])
            assert full[k][at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=2e-3, abs=1e-7), k


def test_scores_are_those_training_sees():
    text = RNG.integers(0, N, 3 * M.STRIDE)
    got = lm.token_scores(text, np.array([len(text)]), M.Scorer(W), 3).mean()
    doc, number = M.windows(np.array([len(text)]))
    inputs, before, places, valid = M.cut(text, np.array([0]), np.array([len(text)]), doc, number, 3)
    assert got == pytest.approx(-M.loss_and_gradient(W, inputs, before, text[places], valid)[0], rel=1e-4)


def test_large_logits_are_in_range():
    big = {k: v * (20 if k in ("wq", "wk", "head", "leaves") else 1) for k, v in W.items()}
    inputs, before, targets, valid = batch()
    loss, grad = M.loss_and_gradient(big, inputs, before, targets, valid)
    assert math.isfinite(loss) and all(np.isfinite(g[1] if isinstance(g, tuple) else g).all() for g in grad.values())
    assert np.isfinite(M.Scorer(big)(inputs, before, targets)).all()


def test_weights_round_trip():
    assert all((M.unpacked(M.packed(W), N)[k] == v).all() for k, v in W.items())


def test_replicas_are_averaged_by_what_they_met():
    import pyarrow as pa

    rows = [{"part": p, "piece": 2, "inputs": i, "targets": t, "weights": np.full(M.SIZE * (2 * M.WIDTH + 1), v, "<f4").tobytes()} for p, i, t, v in ((0, 1.0, 0.0, 4.0), (1, 3.0, 2.0, 8.0))]
    (got,) = lm._mean(pa.Table.from_pylist(rows, schema=lm._PIECES)).to_pylist()
    flat = np.frombuffer(got["weights"], "<f4")
    assert set(flat[: M.SIZE * M.WIDTH]) == {7.0} and set(flat[M.SIZE * M.WIDTH :]) == {8.0} and got["inputs"] == 4


def brute_memory(texts, own):
    """Log probability of each document by loops over chunks: texts as ids, own: log probability of each token."""
    cut, places = [], Counter()
    for ids in texts:
        pieces, at = [], 0
        for stop in range(1, len(ids) + 1):
            tail = ids[max(0, stop - lm.KEY) : stop]
            _, last, _, _ = lm.chunks(np.array(tail), np.array([len(tail)]))
            ends = lm.chunks(np.array(ids), np.array([len(ids)]))[1]
            if stop in ends:
                pieces.append((tuple(ids[max(0, at - lm.KEY) : at]), tuple(ids[at:stop]), at, stop))
                at = stop
        cut.append(pieces)
    uses = Counter((p, c) for pieces in cut for p, c, *_ in pieces)
    for (p, _), n in uses.items():
        places[p] += n
    out = []
    for pieces, scores in zip(cut, own):
        total = 0.0
        for p, c, a, b in pieces:
            mine = float(np.sum(scores[a:b]))
            total += mine if places[p] < 2 else math.log(lm.RECALL * (uses[p, c] - 1) / (places[p] - 1) + (1 - lm.RECALL) * math.exp(mine))
        out.append(total)
    return out


def test_memory_is_that_of_brute_force(spark):
    texts = [RNG.integers(0, 6, n).tolist() for n in (1, 40, 700, 300, 300)]
    texts += [texts[2], texts[3] + texts[1], texts[1], [7]]
    own = [-RNG.random(len(t)) * 0.02 for t in texts]
    lengths = np.array(list(map(len, texts)))
    doc, last, place, chunk = lm.chunks(np.concatenate(texts), lengths)
    sums = np.concatenate([[0], np.cumsum(np.concatenate(own))])
    first = np.concatenate([[0], last[:-1]])
    rows = [(int(d), int(p), int(c), float(s)) for d, p, c, s in zip(doc, place.view(np.int64), chunk.view(np.int64), sums[last] - sums[first])]
    got = lm.recalled(spark.createDataFrame(rows, "row int, place bigint, chunk bigint, log_prob double")).groupBy("row").sum("log_prob").collect()
    want = brute_memory(texts, own)
    assert len(last) > 20 and [r[1] for r in sorted(got)] == pytest.approx(want, abs=1e-6)


def held_out(texts, start, trained, symbol):
    n = total = before = 0
    for t in texts:
        ids = symbol[np.append(np.frombuffer(tokens.encoder().encode(t), "<u2"), tokens.END)]
        before, total = (s + float(lm.token_scores(ids, np.array([len(ids)]), m, symbol[tokens.END]).sum()) for s, m in ((before, start), (total, trained)))
        n += len(ids)
    return before / n, total / n


def test_trained_on_a_table_it_beats_pairs_of_ids_on_held_out_text(spark):
    """Against counts of the single ids and against pairs of ids, smoothed by them as well as can be."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    seen, rest = docs.where("doc_id % 10 > 0").coalesce(1), docs.where("doc_id % 10 = 0")  # a held-out part, as a test
    stream = lm.settled(lm.encoded(seen))
    found = lm.counts(stream, tokens.END + 1)
    encode = tokens.encoder().encode
    every = np.concatenate([np.append(np.frombuffer(encode(r.text), "<u2"), tokens.END) for r in seen.collect()])
    assert (np.bincount(every, minlength=tokens.END + 1) == found).all()
    symbol = lm.symbols(found)
    texts = [r.text for r in rest.collect()]
    one, model = held_out(texts, M.Scorer(M.initial(-np.sort(-found))), M.Scorer(lm.train(stream, found)), symbol)
    pairs = Counter(zip([tokens.END, *every[:-1].tolist()], every.tolist()))
    before, p1 = np.bincount(every, minlength=tokens.END + 1), (found + 1) / (found + 1).sum()
    new = [np.append(np.frombuffer(encode(t), "<u2"), tokens.END).tolist() for t in texts]
    two = max(np.mean([math.log((pairs[a, b] + k * p1[b]) / (before[a] + k)) for ids in new for a, b in zip([tokens.END, *ids[:-1]], ids)]) for k in (10, 30, 100, 300))
    assert model > one + 1 and model > two, (one, two, model)


def test_documents_that_occur_twice_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    times = Counter(texts.values())
    mean = {i: r.log_prob / r.n_tokens for i, r in got.items()}
    twice = [mean[i] for i, t in texts.items() if times[t] > 1 and got[i].n_tokens > 20]
    once = [mean[i] for i, t in texts.items() if times[t] == 1]
    edge = np.quantile(once, 0.9)
    assert len(twice) > 20 and np.mean(np.array(twice) > edge) > 0.9
    for i, r in got.items():
        assert r.n_tokens == len(tokens.encoder().encode(texts[i])) // 2 + 1
        assert r.perplexity == pytest.approx(math.exp(-r.log_prob / r.n_tokens), rel=1e-3) and r.log_prob >= r.model_log_prob - 0.7 * r.n_tokens


def test_edges(spark):
    schema = "doc_id bigint, text string, ids string, n_tokens int, part int, row int, place int"
    assert lm.score(spark.createDataFrame([], schema)).count() == 0
    long = "words that come again and again " * 20_000
    more = ("x", 1, 1, 1, 1)
    rows = [(1, None, *more), (2, "", *more), (None, "some words", None, 1, 1, 1, 1), (3, long, *more), (3, long, *more)]
    got = lm.score(spark.createDataFrame(rows, schema).coalesce(2)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens > 1) for r in got if r.doc_id is not None) == [(False, 2, False), (False, 3, True), (False, 3, True)]
    assert len(got) == 4 and all(np.isfinite(r.log_prob) and r.log_prob < 0 for r in got)
    assert len({r.log_prob for r in got if r.doc_id == 3}) == 1


def test_all_of_a_long_text_is_trained_on(spark):
    text = "the model reads every part of a long text and not only one window of it " * 8000
    stream = lm.settled(lm.encoded(spark.createDataFrame([(1, text)], "doc_id bigint, text string")))
    found = lm.counts(stream, tokens.END + 1)
    start, trained = held_out([text], M.Scorer(M.initial(-np.sort(-found))), M.Scorer(lm.train(stream, found)), lm.symbols(found))
    assert trained > start + 1  # nats a token


def test_texts_encoded_together_are_those_encoded_alone():
    pick = np.random.default_rng(5)
    parts = np.array(["a", "ab", " ", " ", "\n", "'s", ".", "9", "é", " ", "字", "\U0001f642"])
    texts = ["", " ", "  ", " a ", "a  b", "a\n b", "\n x", "x \n", "it's 'tis"] + ["".join(pick.choice(parts, n)) for n in pick.integers(0, 30, 3000)]
    one = tokens.Encoder(tokens.VOCABULARY)
    for some in (texts, texts[:1], [], ["plain words", "and plain words"]):
        assert one.encode_all(some, b"zz").to_pylist() == [one.whole(t) + b"zz" for t in some]


def test_new_words_of_many_texts_are_encoded_as_one(monkeypatch):
    one, calls = tokens.Encoder(tokens.VOCABULARY), []
    whole = one.whole
    monkeypatch.setattr(one, "whole", lambda text: calls.append(text) or whole(text))
    texts = [" ".join(f"w{i * j}x" for j in range(50)) for i in range(40)]
    for cached in (False, True):
        assert one.encode_all(texts).to_pylist() == [whole(t) for t in texts]
        assert len(calls) == len(texts) + (not cached)  # the first word of each, which follows no space, and all new ones
        calls.clear()
    monkeypatch.setattr(tokens, "CACHE_PIECES", 0)
    more = [t.replace("x", "y") for t in texts]
    assert one.encode_all(more).to_pylist() == [whole(t) for t in more] and not any("y" in p for p in one.pieces)


def test_first_step_moves_each_shared_weight_by_the_rate():
    w = weights()
    model, grad = M.Adam({k: v.copy() for k, v in w.items()}), M.loss_and_gradient(w, *batch())[1]
    model.step(grad)
    for k in M.CORE:
        sure = np.abs(grad[k]) > 1e-5
        assert sure.any() and (w[k] - model.w[k])[sure] == pytest.approx(M.RATE * np.sign(grad[k][sure]), rel=0.02)
    assert M.packed(model.w) != M.packed(w) and all(model.w[k].base is model.core for k in M.CORE)
