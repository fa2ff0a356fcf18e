"""A small causal self-attention model over the whole vocabulary, in numpy: forward, gradient, scoring.

What stands for an id is its symbol, its rank by counts in the corpus. Each symbol has an embedding of its own. A place attends to itself
and to the places before it in its window; how far away a place is adds a learned number to the attention's logit. Nothing
else depends on the place, so query, key and value of a symbol are the same everywhere: they are computed once for each distinct symbol,
and looked up. There is one layer and no hidden one: a state is the symbol's own embedding and the values attended to.

Probabilities go down a tree, so they are exact, add up to one over the whole vocabulary, and cost about its cube root: the HEAD most
frequent symbols are leaves of the root, which has one more child for all others; below that are branches of FAN groups of SIZE
symbols, in the order of the symbols. Each node's children have weights of their own on the state that attention gives.
"""

from __future__ import annotations

import numpy as np

WIDTH = 16
CONTEXT, STRIDE = 16, 32
PLACES = CONTEXT + STRIDE
HEAD, FAN, SIZE = 63, 28, 64
RATE, ROW_RATE = 2e-2, 0.2
EPS = np.float32(1e-5)
Weights = dict[str, np.ndarray]
#: Weights that are one table each, and those with rows that only some batches meet.
CORE = ("wq", "wk", "wv", "far", "head", "tops", "groups")
ROWS = ("emb", "leaves")
_SEEN = np.arange(PLACES)[None, :] <= np.arange(CONTEXT, PLACES)[:, None]
_FAR = np.where(_SEEN, np.arange(CONTEXT, PLACES)[:, None] - np.arange(PLACES)[None, :], 0)
_FAR_SEEN = _FAR[_SEEN]


def shapes(symbols: int) -> dict[str, tuple[int, ...]]:
    """Of weights for this many symbols. The last column of head, tops, groups and leaves is a bias; embeddings are in blocks
    like the leaves, the head's in the first."""
    rest = max(1, symbols - HEAD)
    groups = -(-rest // SIZE)
    tops = -(-groups // FAN)
    d = WIDTH
    return {
        "wq": (d, d), "wk": (d, d), "wv": (d, d), "far": (PLACES,),
        "head": (HEAD + 1, d + 1), "tops": (1, tops, d + 1), "groups": (tops, FAN, d + 1),
        "emb": (groups + 1, SIZE, d), "leaves": (groups, SIZE, d + 1),
    }


def block(symbols: np.ndarray) -> np.ndarray:
    """Row of each symbol's embedding in the table of all blocks: the head's are the first SIZE rows."""
    return symbols + (symbols >= HEAD) * (SIZE - HEAD)


def initial(found: np.ndarray, seed: int = 7) -> Weights:
    """Weights to begin with; the probabilities are those of the symbols' counts, which fall."""
    rng = np.random.default_rng(seed)
    w = {k: np.zeros(s, np.float32) for k, s in shapes(len(found)).items()}
    for k, scale in (("wq", 1), ("wk", 1), ("wv", 0.5)):
        w[k] = (rng.standard_normal(w[k].shape) * scale / np.sqrt(len(w[k]))).astype(np.float32)
    w["far"] -= np.log1p(np.arange(PLACES)) * np.float32(0.5)
    w["emb"] += (rng.standard_normal(w["emb"].shape) * 0.5).astype(np.float32)
    n = np.zeros(HEAD + SIZE * len(w["leaves"]))
    n[: len(found)] = found + 1.0
    leaves = n[HEAD:].reshape(-1, SIZE)
    groups = np.zeros(w["groups"].shape[:2])
    groups.reshape(-1)[: len(leaves)] = leaves.sum(1)
    for k, counts in (("leaves", leaves), ("groups", groups), ("tops", groups.sum(1)[None]), ("head", np.append(n[:HEAD], max(1.0, leaves.sum())))):
        w[k][..., -1] = np.where(counts > 0, np.log(np.maximum(counts, 1e-9)), -1e9)
        w[k][..., -1] -= np.log(counts.sum(-1, keepdims=True), where=counts.sum(-1, keepdims=True) > 0, out=np.zeros_like(counts.sum(-1, keepdims=True)))
    return w


def packed(w: Weights) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in (*CORE, *ROWS))


def unpacked(data: bytes, symbols: int) -> Weights:
    out, at, flat = {}, 0, np.frombuffer(data, "<f4")
    known = shapes(symbols)
    for k in (*CORE, *ROWS):
        n = int(np.prod(known[k]))
        out[k], at = flat[at : at + n].reshape(known[k]).copy(), at + n
    return out


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = 1 / np.sqrt(np.einsum("ij,ij->i", x, x)[:, None] / x.dtype.type(WIDTH) + x.dtype.type(EPS))
    return x * r, r


def _norm_back(dy: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    return r * (dy - y * (np.einsum("ij,ij->i", dy, y)[:, None] / dy.dtype.type(WIDTH)))


def _ones(x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1] = x
    return out


class Tree:
    """The way down the tree from states ``z`` (with a column of ones) to the symbols, and the log probabilities there."""

    def __init__(self, w: Weights, z: np.ndarray, symbols: np.ndarray):
        self.w, self.z = w, z
        own = self._flat(np.minimum(symbols, HEAD), HEAD + 1)
        logits = z @ w["head"].T
        self.head = (own, *self._softmax(logits, own))
        self.logs = self.head[3]
        self.far = np.flatnonzero(symbols >= HEAD)
        self.levels = []
        if len(self.far):
            group, place = np.divmod(symbols[self.far] - HEAD, SIZE)
            order = np.argsort(group.astype(np.uint16 if len(w["leaves"]) <= 1 << 16 else np.int64), kind="stable")
            self.far, group, place = self.far[order], group[order], place[order]
            self.below = z[self.far]
            top, turn = np.divmod(group, FAN)
            for name, node, pick in (("tops", np.zeros_like(top), top), ("groups", top, turn), ("leaves", group, place)):
                firsts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                runs = list(zip(node[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(node)]))
                logits, pick = np.empty((len(node), w[name].shape[1]), z.dtype), self._flat(pick, w[name].shape[1])
                below, turned = self.below, w[name].transpose(0, 2, 1)
                for g, a, b in runs:
                    np.matmul(below[a:b], turned[g], out=logits[a:b])
                e, total, logs = self._softmax(logits, pick)
                self.logs[self.far] += logs
                self.levels.append((name, pick, e, total, node[firsts], runs))

    @staticmethod
    def _softmax(logits: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials (in place), their sums, log probabilities of the children picked."""
        if not len(logits):
            return logits, np.ones(0, logits.dtype), np.zeros(0, logits.dtype)
        flat = logits.reshape(-1)
        at = flat[pick]
        if logits.max() > 60 or at.min() < -60:  # else neither the sum nor a part of it leaves the range
            logits -= logits.max(-1, keepdims=True)
            at = flat[pick]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        return logits, total, at - np.log(total)

    @staticmethod
    def _flat(pick: np.ndarray, children: int) -> np.ndarray:
        """Where in logits of so many children, row by row, those picked are."""
        return np.arange(0, len(pick) * children, children) + pick

    def gradient(self, valid: np.ndarray, n: int) -> tuple[np.ndarray, Weights]:
        """Of the mean over ``n`` valid targets: by the states, and by the weights (of ``leaves`` as nodes met and what they have)."""
        scale = valid / self.z.dtype.type(n)

        def errors(e: np.ndarray, total: np.ndarray, pick: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Errors of the logits, and what each row of them is yet to be multiplied by: what they meet has fewer columns."""
            e.reshape(-1)[pick] -= total
            return e, (scale / total)[:, None]

        pick, e, total, _ = self.head
        d, size = errors(e, total, pick, scale)
        dz, grad = d @ self.w["head"][:, :-1], {"head": d.T @ (self.z * size)}
        dz *= size
        grad |= {"tops": np.zeros_like(self.w["tops"]), "groups": np.zeros_like(self.w["groups"]), "leaves": (np.zeros(0, np.int64), np.zeros((0, SIZE, WIDTH + 1), self.z.dtype))}
        if self.levels:
            scale = scale[self.far]
            more, part = np.zeros((2, len(self.far), WIDTH), self.z.dtype)
            for name, pick, e, total, nodes, runs in self.levels:
                (d, size), w = errors(e, total, pick, scale), self.w[name][..., :-1]
                rows, below = np.empty((len(runs), *self.w[name].shape[1:]), self.z.dtype), self.below * size
                for i, (g, a, b) in enumerate(runs):
                    own = d[a:b]
                    np.matmul(own.T, below[a:b], out=rows[i])
                    np.matmul(own, w[g], out=part[a:b])
                part *= size
                more += part
                if name == "leaves":
                    grad[name] = nodes, rows
                else:
                    grad[name][nodes] = rows
            dz[self.far] += more
        return dz, grad


def _attention(w: Weights) -> np.ndarray:
    """What distance does to each pair of places, and 0 for places that come later."""
    return np.exp(w["far"])[_FAR] * _SEEN.astype(w["far"].dtype)


def _looked_up(w: Weights, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of distinct symbols: embedding, its norm and factor, and the rows [query, embedding] and [key, value]."""
    x = w["emb"].reshape(-1, WIDTH)[block(symbols)]
    a, r = _norm(x)
    return x, a, r, np.concatenate([a @ w["wq"] * x.dtype.type(WIDTH**-0.5), x], 1), np.concatenate([a @ w["wk"], a @ w["wv"]], 1)


def _bounded(late: np.ndarray, every: np.ndarray) -> bool:
    """Whether no attention logit can leave the range of exponentials."""
    q, k = (np.einsum("ij,ij->i", t[:, :WIDTH], t[:, :WIDTH]).max(initial=0) for t in (late, every))
    return float(q) * float(k) < 50.0**2


def _weighed(q: np.ndarray, k: np.ndarray, mask: np.ndarray, before: np.ndarray, small: bool) -> np.ndarray:
    """Attention of each late place to each place, before it is divided by its sum."""
    e = q @ k.transpose(0, 2, 1)
    if not small:
        e += np.where(mask > 0, 0, -1e9).astype(e.dtype)
        e -= e.max(-1, keepdims=True)
    np.exp(e, out=e)
    e *= mask
    begun = np.flatnonzero(before)
    if len(begun):
        e[begun] *= np.arange(e.shape[2]) >= before[begun, None, None]
    return e


def loss_and_gradient(w: Weights, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[float, Weights]:
    """For windows of PLACES symbols, of which the first ``before`` don't exist: mean negative log probability of the valid targets, and its
    gradient; of ``emb`` and ``leaves`` as rows and what they have."""
    kind, n_windows = w["wq"].dtype.type, len(inputs)
    there = np.zeros(w["emb"].shape[0] * SIZE, bool)
    there[inputs] = True
    symbols = np.flatnonzero(there)
    number = np.empty(len(there), np.uint16 if len(symbols) < 1 << 16 else np.int64)
    number[symbols] = np.arange(len(symbols))
    at = number[inputs]
    x, a, r, of_late, of_every = _looked_up(w, symbols)
    late, every = np.take(of_late, at[:, CONTEXT:], 0), np.take(of_every, at, 0)
    q, own, k, v = late[..., :WIDTH], late[..., WIDTH:], every[..., :WIDTH], every[..., WIDTH:]
    mask = _attention(w)
    p = _weighed(q, k, mask, before, _bounded(of_late, of_every))
    total = (p.reshape(-1, PLACES) @ np.ones(PLACES, kind)).reshape(n_windows, STRIDE, 1)
    p /= np.maximum(total, kind(1e-30))
    m = p @ v
    h = (own + m).reshape(-1, WIDTH)
    z, rz = _norm(h)
    tree = Tree(w, _ones(z), targets.reshape(-1))
    good = valid.reshape(-1)
    n = max(1, int(good.sum()))
    loss = -float((tree.logs * good).sum()) / n

    dz, grad = tree.gradient(good, n)
    dm = _norm_back(dz, z, rz).reshape(n_windows, STRIDE, WIDTH)
    ds = dm @ v.transpose(0, 2, 1)
    ds -= np.einsum("nij,nij->ni", dm, m)[..., None]
    ds *= p
    grad["far"] = np.bincount(_FAR_SEEN, ds.sum(0)[_SEEN], PLACES).astype(kind)
    for_late, for_every = np.empty_like(late), np.empty_like(every)
    np.matmul(ds, k, out=for_late[..., :WIDTH])
    for_late[..., WIDTH:] = dm
    np.matmul(ds.transpose(0, 2, 1), q, out=for_every[..., :WIDTH])
    np.matmul(p.transpose(0, 2, 1), dm, out=for_every[..., WIDTH:])
    dqx, dkv = _summed(at[:, CONTEXT:], for_late, len(symbols)), _summed(at, for_every, len(symbols))
    dq, dx, dk, dv = dqx[:, :WIDTH] * kind(WIDTH**-0.5), dqx[:, WIDTH:], dkv[:, :WIDTH], dkv[:, WIDTH:]
    grad["wq"], grad["wk"], grad["wv"] = a.T @ dq, a.T @ dk, a.T @ dv
    dx += _norm_back(dq @ w["wq"].T + dk @ w["wk"].T + dv @ w["wv"].T, a, r)
    grad["emb"] = symbols, dx
    return loss, grad


def _summed(number: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each number below ``n``."""
    flat, rows = number.reshape(-1), rows.reshape(-1, rows.shape[-1])
    order = np.argsort(flat, kind="stable")
    of = flat[order]
    firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    pairs = np.complex64 if rows.dtype == np.float32 else np.complex128  # two numbers are added at once
    out[of[firsts]] = np.add.reduceat(np.take(rows, order, 0).view(pairs), firsts, axis=0).view(rows.dtype)
    return out


class Adam:
    """For what all batches have; embeddings and leaves go by Adagrad, one size for each row."""

    def __init__(self, w: Weights):
        self.rows = {k: np.zeros(w[k].shape[:2], np.float32) for k in ROWS}
        self.core, self.w, self.t = np.concatenate([w[k].reshape(-1) for k in CORE]), dict(w), 0
        at = 0
        for k in CORE:
            self.w[k], at = self.core[at : at + w[k].size].reshape(w[k].shape), at + w[k].size
        self.m, self.v = np.zeros((2, at), np.float32)

    def step(self, grad: Weights, rate: float = RATE) -> None:
        self.t += 1
        symbols, g = grad["emb"]
        at = block(symbols)
        w, v = self.w["emb"].reshape(-1, WIDTH), self.rows["emb"].reshape(-1)
        v[at] += np.einsum("ij,ij->i", g, g) / np.float32(WIDTH)
        w[at] -= np.float32(ROW_RATE) * g / (np.sqrt(v[at]) + np.float32(1e-8))[:, None]
        at, g = grad["leaves"]
        v = self.rows["leaves"]
        v[at] += np.einsum("ijk,ijk->ij", g, g) / np.float32(WIDTH + 1)
        self.w["leaves"][at] -= np.float32(ROW_RATE) * g / (np.sqrt(v[at]) + np.float32(1e-8))[..., None]
        g = np.concatenate([grad[k].reshape(-1) for k in CORE])
        g *= np.float32(min(1.0, 1 / max(float(np.sqrt(g @ g)), 1e-9)))
        self.m += np.float32(0.1) * (g - self.m)
        self.v += np.float32(0.01) * (g * g - self.v)
        self.core -= np.float32(rate / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.v / np.float32(1 - 0.99**self.t)) + np.float32(1e-8))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and number of each window of documents with these lengths."""
    each = -(-lengths // STRIDE)
    doc = np.repeat(np.arange(len(lengths)), each)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)


def cut(stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, number: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """Inputs, places before the document, places of the targets in the stream, and which of those there are.

    The input at a place is the token before the target there; at a document's beginning, ``first``.
    """
    at = (number * STRIDE - CONTEXT)[:, None] + np.arange(PLACES)
    inputs = stream[np.clip(starts[doc][:, None] + at - 1, 0, len(stream) - 1)]
    inputs[at == 0] = first
    places = at[:, CONTEXT:]
    return inputs, np.maximum(0, -at[:, 0]), np.minimum(starts[doc][:, None] + places, len(stream) - 1), places < lengths[doc][:, None]


class Scorer:
    """The model for scoring, with the rows of all symbols looked up."""

    def __init__(self, w: Weights):
        self.w = w
        symbols = np.arange(HEAD + SIZE * len(w["leaves"]))
        _, _, _, self.late, self.every = _looked_up(w, symbols)
        self.every = _ones(self.every)
        mask, half = _attention(w), STRIDE // 2
        self.parts = [(slice(0, half), CONTEXT + half), (slice(half, STRIDE), PLACES)]  # early places see fewer
        self.masks = [mask[rows, :seen] for rows, seen in self.parts]
        self.small = _bounded(self.late, self.every)

    def __call__(self, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log probabilities of the targets."""
        late, every = np.take(self.late, inputs[:, CONTEXT:], 0), np.take(self.every, inputs, 0)
        h = late[..., WIDTH:].copy()
        for (rows, seen), mask in zip(self.parts, self.masks):
            e = _weighed(late[:, rows, :WIDTH], every[:, :seen, :WIDTH], mask, before, self.small)
            m = e @ every[:, :seen, WIDTH:]
            h[:, rows] += m[..., :WIDTH] / np.maximum(m[..., WIDTH:], np.float32(1e-30))
        return Tree(self.w, _ones(_norm(h.reshape(-1, WIDTH))[0]), targets.reshape(-1)).logs.reshape(targets.shape)
