"""Packing: concatenate all documents, cut into windows of a fixed number of tokens.

First pass: each partition encodes its documents, with an end token after each, and finds its token total. The
prefix sums over these totals (one number a partition) give each partition its global offset. Second pass: each
partition, on its own, cuts the windows that lie in it as a whole. What is left at its two ends, less than a window
each, goes into boundary records; those of the same window are joined. Nothing else is shuffled, whatever the size
of the corpus, and a long document or a hot source is no special case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.llm import tokens
from termlake.llm.common import quoted, settled

WINDOW = 2048
ROWS = 1024
#: Characters of the texts that are encoded together, but for the last text.
TOGETHER = 1 << 22


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ROWS at a time: what a worker holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = tokens.VOCABULARY, end: int | None = tokens.END, together: bool = False) -> DataFrame:
    """``doc_id, ids`` (16-bit numbers) in the order of ``docs``; documents without text (null) are left out. ``together``: words are
    looked up for many texts at once, which is faster and takes more memory."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, every = tokens.encoder(path).encode, tokens.encoder(path).encode_all
        tail = b"" if end is None else np.array([end], "<u2").tobytes()
        for batch in _small(batches):
            if together:
                texts, first, size = batch.column(1).to_pylist(), 0, 0
                for i, text in enumerate(texts):
                    size += len(text)
                    if size >= TOGETHER or i + 1 == len(texts):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), every(texts[first : i + 1], tail)], ["doc_id", "ids"])
                        first, size = i + 1, 0
                continue
            ids = pa.array((one(text) + tail for text in batch.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    found = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return found.where("text IS NOT NULL").mapInArrow(encode, "doc_id bigint, ids binary")


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
    """All ids of a batch in a row, the number in each document, and the documents."""
    binary = batch.column(1).cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    ids = np.frombuffer(data, "<u2")[offsets[0] // 2 : offsets[-1] // 2] if data is not None else np.zeros(0, "<u2")
    return ids, np.diff(offsets) // 2, batch.column(0)


def _segments(lengths: np.ndarray, window: int, lead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut documents of these lengths, put in a row, at every window's start (the first is cut after ``lead``):
    document, window and length of each piece."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.concatenate([ends, np.arange(lead or window, total, window)]))
    starts = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
    if total == 0:
        return starts[:0], starts[:0], starts[:0]
    keep = cuts > starts
    starts, cuts = starts[keep], cuts[keep]
    return np.searchsorted(ends, starts, "right"), (starts + (window - lead if lead else 0)) // window, cuts - starts


def _rows(first: int, ids: np.ndarray, docs: pa.Array, lengths: np.ndarray, window: int) -> pa.RecordBatch:
    """Windows first, first + 1, ... from ids, whose number is a multiple of the window."""
    n = len(ids) // window
    doc, at, length = _segments(lengths, window)
    bounds = np.searchsorted(at, np.arange(n + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(first, first + n)),
            pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * window), pa.array(ids.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(bounds), docs.take(pa.array(doc))),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(length.astype(np.int32))),
        ],
        ["seq_id", "tokens", "doc_ids", "doc_lens"],
    )


ROW = "tokens array<int>, doc_ids array<bigint>, doc_lens array<int>"


def pack(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", path: str = tokens.VOCABULARY, end: int = tokens.END) -> DataFrame:
    """``seq_id, tokens, doc_ids, doc_lens``: window number ``seq_id`` of the concatenated corpus, the documents it
    has pieces of, in order, and the number of tokens in each piece.

    Each window has ``window`` tokens, the last what is left. Documents come in the order of ``docs`` (that of its
    partitions, and of rows in them), each followed by the end token. An empty text is the end token alone; a null
    text has no place in the sequence. Repeated rows are packed as often as they occur; null ids stay null; other
    columns are ignored. No documents: no windows.
    """
    stream = settled(encoded(docs, id_col, text_col, path, end))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's total, and the tokens and documents within less than a window of its start and its end."""
        total, head, tail = 0, [], []
        have = 0
        for batch in _small(batches):
            ids, lengths, doc = _joined(batch)
            piece = (ids, lengths, doc)
            total += len(ids)
            if have < window:
                head.append(piece)
                have += len(ids)
            tail.append(piece)
            while sum(len(x[0]) for x in tail[1:]) >= window:
                tail.pop(0)
        if total:
            start, last = _some(head, window, True), _some(tail, window, False)
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "total": total} | {f"head_{k}": v for k, v in start.items()} | {f"tail_{k}": v for k, v in last.items()}], schema=_ENDS)

    edge = settled(stream.mapInArrow(ends, f"part int, total bigint, {', '.join(f'{p}_{c.strip()}' for p in ('head', 'tail') for c in ROW.split(','))}"))
    totals = np.array(sorted((r.part, r.total) for r in edge.select("part", "total").collect()), np.int64).reshape(-1, 2)
    if not len(totals):
        return edge.sparkSession.createDataFrame([], f"seq_id bigint, {ROW}")
    offset = edge.sparkSession.sparkContext.broadcast((totals[:, 0], np.concatenate([[0], np.cumsum(totals[:, 1])])))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows that start and end in this partition."""
        base = _before(*offset.value, TaskContext.get().partitionId())
        skip, seq = -base % window, -(-base // window)
        ids, lengths, doc = np.zeros(0, "<u2"), np.zeros(0, np.int64), pa.array([], pa.int64())
        for batch in _small(batches):
            more, n, d = _joined(batch)
            ids, lengths, doc = np.concatenate([ids, more]), np.concatenate([lengths, n]), pa.concat_arrays([doc, d])
            if skip:
                cut = min(skip, len(ids))
                ids, lengths, doc = _after(ids, lengths, doc, cut)
                skip -= cut
            if full := len(ids) // window * window:
                head = np.minimum(lengths, np.maximum(0, full - np.concatenate([[0], np.cumsum(lengths)[:-1]])))
                yield _rows(seq, ids[:full], doc, head, window)
                seq += full // window
                ids, lengths, doc = _after(ids, lengths, doc, full)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundary records: what a partition has of a window that it shares with others."""
        for batch in batches:
            for row in batch.to_pylist():
                base, total = _before(*offset.value, row["part"]), row["total"]
                stop = base + total
                lead = min(-base % window, total)
                rest = stop % window if stop // window * window >= base + lead and stop // window >= -(-base // window) else 0
                out = []
                if lead:
                    out.append((base // window, base, *_slice(row, "head", lead, True)))
                if rest:
                    out.append((stop // window, stop - rest, *_slice(row, "tail", rest, False)))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(_FRAGMENT.names, x)) for x in out], schema=_FRAGMENT)

    inner = stream.mapInArrow(whole, f"seq_id bigint, {ROW}")
    parts = edge.mapInArrow(fragments, f"seq_id bigint, start bigint, {ROW}")
    in_order = F.array_sort(F.collect_list(F.struct("start", "tokens", "doc_ids", "doc_lens")))
    merged = parts.groupBy("seq_id").agg(in_order.alias("x")).select("seq_id", F.flatten("x.tokens").alias("tokens"), F.flatten("x.doc_ids").alias("doc_ids"), F.flatten("x.doc_lens").alias("doc_lens"))
    return inner.unionByName(merged)


_LISTS = [("tokens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32()))]
_ENDS = pa.schema([("part", pa.int32()), ("total", pa.int64()), *((f"{p}_{n}", t) for p in ("head", "tail") for n, t in _LISTS)])
_FRAGMENT = pa.schema([("seq_id", pa.int64()), ("start", pa.int64()), *_LISTS])


def _before(parts: np.ndarray, sums: np.ndarray, part: int) -> int:
    """Tokens of all partitions before ``part``, whether or not that one, or any, has tokens."""
    return int(sums[np.searchsorted(parts, part)])


def _after(ids: np.ndarray, lengths: np.ndarray, doc: pa.Array, cut: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What follows the first ``cut`` ids."""
    ends = np.cumsum(lengths)
    first = int(np.searchsorted(ends, cut, "right"))
    lengths = lengths[first:].copy()
    if first < len(ends):
        lengths[0] = ends[first] - cut
    return ids[cut:], lengths, doc.slice(first)


def _some(pieces: list, window: int, start: bool) -> dict:
    """The first or the last ids of the pieces, up to a window, as lists."""
    ids, lengths, doc = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), pa.concat_arrays([p[2] for p in pieces])
    if start:
        n = min(window, len(ids))
        ends = np.cumsum(lengths)
        last = int(np.searchsorted(ends, n, "left")) + 1
        lengths, doc = lengths[:last].copy(), doc.slice(0, last)
        lengths[-1] -= ends[last - 1] - n
        ids = ids[:n]
    elif len(ids) > window:
        ids, lengths, doc = _after(ids, lengths, doc, len(ids) - window)
    return {"tokens": ids.tolist(), "doc_ids": doc.to_pylist(), "doc_lens": lengths.tolist()}


def _slice(row: dict, side: str, n: int, start: bool) -> tuple[list, list, list]:
    ids, docs, lens = (row[f"{side}_{k}"] for k in ("tokens", "doc_ids", "doc_lens"))
    if not start:
        ids, docs, lens = ids[::-1], docs[::-1], lens[::-1]
    kept, left = [], n
    for d, k in zip(docs, lens):
        if left <= 0:
            break
        kept.append((d, min(k, left)))
        left -= k
    ids = ids[:n]
    if not start:
        ids, kept = ids[::-1], kept[::-1]
    return ids, [d for d, _ in kept], [k for _, k in kept]
