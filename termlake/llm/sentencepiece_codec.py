"""SentencePiece models on the tokenizers library.

The model file is parsed here, as the protobuf it is, and rebuilt: the normalizer (character map, white space, the marker
that stands for a space), the pieces with their scores as a unigram model, or with merges in order of the scores as a BPE
model, and bytes for what no piece covers. A worker splits texts at spaces, encodes the words that it hasn't seen yet as one
batch on several threads (of a BPE model many words as one text, whose ids are cut again at the words' ends), and puts documents together from a cache of numbered words, all texts of a batch at once. Where a model has a
piece that goes across a space, and for texts with runs of spaces, whole texts are encoded instead; the ids are the same either way.

Parity: SentencePiece itself encodes every document as a whole, and the ids must be the same. (Of a unigram model it adds scores in single
precision, the library in double: where two ways to cut a word are equally good they may choose differently, and parity says so.) Round trip: the ids of a whole document are
decoded and compared with its text, byte by byte, in one pass over the batch: each id stands for the bytes of its piece, with a space for
the marker.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termlake.llm.common import quoted

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
THREADS = 2
#: Bounds on a worker's memory only: characters worked on at once, and pieces remembered.
CHUNK, CACHE_PIECES = 1 << 21, 300_000
#: New words that are encoded as one text, where that gives the same ids.
JOINED = 1000
_codecs: dict[str, "Codec"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in the model file")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """What the file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                out.kind, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.collapse, out.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        return out


def rebuilt(model: Model):
    """The model for the tokenizers library, without a normalizer, and the normalizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocab = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        least = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0)
        # Control pieces and bytes are never found in a text: their scores keep them out.
        scored = [(p, s if k in (NORMAL, USER) else least - 1e6) for p, s, k in model.pieces]
        core = models.Unigram(scored, unknown, model.byte_fallback)
    else:
        usable = {p: (-s, i) for i, (p, s, k) in enumerate(model.pieces) if k in (NORMAL, USER)}
        merges = []
        for piece, (rank, i) in usable.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    merges.append((rank, i, vocab[left], vocab[right], left, right))
        merges.sort()
        core = models.BPE(vocab, [m[4:] for m in merges], byte_fallback=model.byte_fallback, fuse_unk=True, unk_token=model.pieces[unknown][0] if unknown is not None else None)
    tokenizer = Tokenizer(core)
    users = [AddedToken(p, normalized=False, special=False) for p, _, k in model.pieces if k == USER]
    if users:
        tokenizer.add_tokens(users)
    space = MARK if model.escape else " "
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.collapse:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer, normalizers.Sequence(steps), space


class _Numbers(dict):
    """Numbers words as they come; new ones wait in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as file:
            self.model = Model.parse(file.read())
        self.tokenizer, self.normalizer, self.space = rebuilt(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = self.model
        self.plain = not plain.charsmap and not plain.collapse and plain.dummy_prefix and plain.escape
        self.splits = plain.escape and plain.dummy_prefix and not any(MARK in p.lstrip(MARK) for p, _, k in plain.pieces if k in (NORMAL, USER))
        self.unknown = next((i for i, p in enumerate(plain.pieces) if p[2] == UNKNOWN), -1)
        self.joins = self.splits and plain.kind == BPE and plain.byte_fallback and not any(k == USER for _, _, k in plain.pieces)
        self._forget()
        # What each id gives when it is decoded; control pieces as they are written.
        texts = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in plain.pieces]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(texts) or b" ", np.uint8)

    def _forget(self) -> None:
        """An empty cache: the number of each word, and by number its ids, one after the other."""
        self.number = _Numbers()
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _parts(self, text: str) -> list[str] | None:
        """Words that each stand for the marker and themselves, or None where the text can't be split so."""
        if not self.splits or not text:
            return None
        if self.plain:
            return None if text[0] == " " or "  " in text or MARK in text else text.split(" ")
        done = self.normalizer.normalize_str(text)
        return None if not done.startswith(MARK) or MARK * 2 in done else done[1:].split(MARK)

    def _encode(self, normalized: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(normalized, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each behind the marker, in a row, and how many each has.

        Where no merge crosses a marker, words of a BPE model are encoded JOINED at a time, as a text is; the ids are cut where the bytes
        that they stand for reach the end of a word.
        """
        if self.joins and all(words):
            texts = ["".join(MARK + w for w in words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            given = np.cumsum([len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in words])
            reached = np.cumsum(self.sizes[ids])
            last = np.searchsorted(reached, given)
            if not (ids == self.unknown).any() and reached[-1] == given[-1] and (reached[last] == given).all():
                return ids, np.diff(last, prepend=-1)
        each = [e.ids for e in self.tokenizer.encode_batch_fast([MARK + w for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, int(size.sum())), size

    def _learn(self, words: list[str]) -> None:
        ids, size = self._encode_words(words)
        at, end = len(self.number) - len(words), self.n_ids + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.number) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.ids[self.n_ids : end] = ids
        self.first[at : at + len(words)] = self.n_ids + np.cumsum(size) - size
        self.size[at : at + len(words)] = size
        self.n_ids = end

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, how many each has, and whether SentencePiece has the same."""
        split = [self._parts(t) for t in texts]
        if len(self.number) > CACHE_PIECES:
            self._forget()
        n_words = np.array([0 if p is None else len(p) for p in split], np.int64)
        words = np.fromiter(map(self.number.__getitem__, chain.from_iterable(p for p in split if p is not None)), np.int64, int(n_words.sum()))
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        whole = [i for i, p in enumerate(split) if p is None]
        alone: dict[int, np.ndarray] = {}
        if whole:
            own = self._encode([self.normalizer.normalize_str(texts[i]) if texts[i] else "" for i in whole])
            alone = {i: np.frombuffer(ids, "<i4") for i, ids in zip(whole, own)}
        ids = _ragged(self.ids, self.first[words], self.size[words])
        of = np.repeat(np.arange(len(texts)), n_words)
        sizes = np.bincount(of, self.size[words], len(texts)).astype(np.int64)
        if alone:
            edges, parts, at = np.cumsum(sizes), [], 0
            for i, own in alone.items():
                parts += [ids[at : edges[i]], own]
                at, sizes[i] = edges[i], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, sizes, self._agrees(texts, ids, sizes)

    def _agrees(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether SentencePiece has the same ids for each text."""
        want = self.peer.encode(texts, num_threads=1, return_type="numpy")
        n = np.array([len(w) for w in want], np.int64)
        flat = np.concatenate(want) if want else np.zeros(0, np.int32)
        same = n == sizes
        if same.all():
            same[np.searchsorted(np.cumsum(sizes), np.flatnonzero(flat != ids), "right")] = False
            return same
        a, b = np.cumsum(sizes), np.cumsum(n)
        for i in np.flatnonzero(same):
            same[i] = (ids[a[i] - n[i] : a[i]] == flat[b[i] - n[i] : b[i]]).all()
        return same

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of each text, as 32-bit numbers, and whether SentencePiece has the same."""
        ids, sizes, same = self.encode_all(texts)
        ends = np.cumsum(sizes)
        return [(ids[e - n : e].astype("<i4").tobytes(), bool(k)) for e, n, k in zip(ends, sizes, same)]

    def come_back(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts are what their ids (all in a row, ``sizes`` for each) give when they are decoded."""
        coded = [t.encode() for t in texts]
        given, lengths = np.frombuffer(b"".join(coded), np.uint8), np.array([len(t) for t in coded], np.int64)
        out = _ragged(self.bytes, self.starts[ids], self.sizes[ids])
        of = np.repeat(np.arange(len(texts)), sizes)
        n = np.bincount(of, self.sizes[ids], len(texts)).astype(np.int64)
        lead = ((n > 0) & self.model.dummy_prefix).astype(np.int64)  # the marker before the text
        fits = n - lead == lengths
        ends = np.cumsum(n)
        if fits.all() and self.model.dummy_prefix:
            firsts = (ends - n)[n > 0]
            body = np.delete(out, firsts) if len(firsts) else out
            wrong = np.flatnonzero(body != given)
            fits[np.searchsorted(np.cumsum(lengths), wrong, "right")] = False
            fits[n > 0] &= out[firsts] == 32
            return fits
        begin = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(fits):
            own = out[ends[i] - n[i] : ends[i]]
            fits[i] = bool((own[lead[i] :] == given[begin[i] : begin[i] + lengths[i]]).all()) and (not lead[i] or own[0] == 32)
        return fits

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each place ``size`` values from ``first`` on, all in a row."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    step = np.ones(total, np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return values[:0]
    first, size = first[full], size[full]
    step[0] = first[0]
    step[np.cumsum(size)[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
    return values[np.cumsum(step, out=step)]


def codec(path: str = MODEL, threads: int = THREADS) -> Codec:
    """The codec of a file, once for each worker. How many threads encode is the same for all files of a worker: the first codec's."""
    if path not in _codecs:
        _codecs[path] = Codec(path, threads)
    return _codecs[path]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``doc_id, ids, parity, round_trip``: the ids of each text; whether SentencePiece gives the same; whether decoding the ids
    gives the text again (as it can't where the model's normalizer changes texts).

    An empty text has no ids. A null text has null in all three. Repeated rows are encoded each time, null ids stay null, and
    other columns are ignored. Texts are encoded to their ends. An empty table gives an empty result.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, threads)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for start, stop in _chunks([len(t or "") for t in every]):
                texts = every[start:stop]
                some = [t or "" for t in texts]
                flat, sizes, same = one.encode_all(some)
                back = one.come_back(some, flat, sizes)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                missing = np.array([t is None for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(missing)),
                        pa.array(same, mask=missing),
                        pa.array(back, mask=missing),
                    ],
                    ["doc_id", "ids", "parity", "round_trip"],
                )

    rows = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, ids array<int>, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``doc_id, text`` from arrays of ids. Null arrays give null texts, empty ones empty texts; null elements, and ids that the
    model doesn't have, are passed over. Other columns are ignored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, threads)
        most = len(one.model.pieces)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for start, stop in _chunks([len(x or ()) for x in every]):
                lists = every[start:stop]
                back = one.decode([[i for i in x or () if i is not None and 0 <= i < most] for x in lists])
                texts = pa.array([None if x is None else b for x, b in zip(lists, back)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), texts], ["doc_id", "text"])

    rows = encoded.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(task, "doc_id bigint, text string")
