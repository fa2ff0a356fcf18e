"""Near-dedup: fast similarity sketching, banding, exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017). A document is the set of its adjacent
word pairs. In round i every element is hashed to one of T coordinates and leaves there the value (i, hash); the
smallest value stays. Rounds go on until each coordinate is filled; from round T on, round T + j puts all elements
at coordinate j, so 2 T rounds always do, and the share of equal coordinates is concentrated around the Jaccard
similarity as for T independent hash functions, in time O(n + T log T) rather than O(n T).

Banding: documents that agree in all coordinates of one of the bands meet in a bucket. Each candidate is compared,
on the whole sets, with the first document of the bucket that it shares most buckets with. Documents found similar form
groups, and every pair of a bucket that isn't in one group by then is still to be settled:

* where these pairs are at most HOT times the bucket's documents, they are compared, each of them;
* elsewhere all pairs that can be similar are found by their rarest elements (prefix filter): of sets of n elements, in one order from
  rare to frequent, two that are similar by the threshold t share one of the first n - ceil(t n) + 1 of each. Only elements that different
  groups have are joined. A passage that a third of all documents share is frequent, so it joins nothing.

Either way no similar pair of a bucket is left out, a group of m copies costs m comparisons, and no bucket is gathered in one place.
Groups are the components of the pairs found similar.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlake.llm.common import fresh, numbered, quoted, settled, steady
from termlake.storage import if_small

WORDS = 2
COORDINATES = 128
BANDS = 32
THRESHOLD = 0.6
#: Bytes of text worked on at once in a Python worker. A longer document is taken in pieces, and the set is the union.
CHUNK = 1 << 19
#: Candidates are broadcast to filter the documents up to this number of rows, and joined by shuffle beyond it.
BROADCAST_ROWS = 2_000_000
#: Pairs to be compared for each document of a bucket up to which a bucket's pairs are all compared; beyond, by rare elements.
HOT = 32

_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word of texts in UTF-8, with a byte that is no word after each.

    A word is a run of letters, digits and marks; punctuation and spaces of Unicode's common blocks end it, like those of ASCII. In scripts
    that don't part words by spaces (Han, kana, Thai and its neighbours) each character is one.
    """
    word = _IS_WORD[data]
    alone = None
    if len(data) > 2 and (data >= 0xC2).any():
        at = np.flatnonzero(data == 0xC2)  # U+0080 to U+00BF, of which three are letters
        at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
        for off in (at, at + 1):
            word[off] = False
        three = np.flatnonzero(data >= 0xE0)
        three = three[data[three] < 0xF0]
        lead, second = data[three], data[three + 1]
        last = data[three + 2]
        full = (lead == 0xEF) & ((second == 0xBC) & ((last < 0x90) | (last > 0x99)) & ((last < 0xA1) | (last > 0xBA)) | (second == 0xBD) & ((last < 0x81) | (last > 0x9A)) & (last < 0xA6))
        mark = (lead == 0xE2) & (second <= 0xAF) & ~np.isin(second, (0x84, 0x85, 0x86, 0xB0, 0xB1)) | (lead == 0xE3) & (second == 0x80) | full
        for k in range(3):
            word[three[mark] + k] = False
        own = ~mark & ((lead == 0xE3) & (second >= 0x81) | (lead >= 0xE4) & (lead <= 0xE9) | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & (second >= 0x80) & (second <= 0x82) | (lead == 0xE1) & (second >= 0x9E) & (second <= 0x9F))
        alone = three[own]
    if alone is None or not len(alone):
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([[0], edge])
        return edge[::2], edge[1::2]
    begin = word & ~np.concatenate([[False], word[:-1]])
    begin[alone] = True
    after = alone + 3
    begin[after] |= word[after]
    end = ~word & np.concatenate([[False], word[:-1]])
    edge = np.flatnonzero(begin | end)
    is_start = begin[edge]
    start = np.flatnonzero(is_start)
    return edge[start], edge[start + 1]


def _pieces(data: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """A long text in pieces that overlap by words - 1 words, so that no run of words is lost."""
    if len(data) <= CHUNK:
        yield data
        return
    starts, _ = _bounds(np.concatenate([data, np.zeros(3, np.uint8)]))
    at = 0
    while at < len(starts):
        stop = max(int(np.searchsorted(starts, starts[at] + CHUNK)), at + words)
        yield data[starts[at] : starts[stop] if stop < len(starts) else len(data)]
        if stop >= len(starts):
            return
        at = stop - words + 1


def shingles(texts: list[np.ndarray], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For lower-case texts as bytes: number of the text and hash of each run of ``words`` words, in order.

    Words are those of ``_bounds``. A text of fewer words is one run.
    """
    owner, parts = [], []
    for i, text in enumerate(texts):
        for piece in _pieces(text, words):
            owner.append(i)
            parts.append(piece)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    sizes = np.array([len(p) + 1 for p in parts])
    data = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint8))])
    start, stop = _bounds(np.concatenate([data, np.zeros(2, np.uint8)]))  # every part ends in a byte that is no word
    power, inverse = _power(len(data))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(data * power[: len(data)], dtype=_U)])
    each = _mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(_U))
    part = np.searchsorted(np.cumsum(sizes), start, "right")
    count = np.bincount(part, minlength=len(parts))
    first = np.cumsum(count) - count
    runs = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    total_runs = int(runs.sum())
    of = np.repeat(np.arange(len(parts)), runs)
    at = first[of] + np.arange(total_runs) - np.repeat(np.cumsum(runs) - runs, runs)
    last = first[of] + count[of] - 1
    out = np.zeros(total_runs, _U)
    for k in range(words):
        here = at + k
        out = _mix(out * _U(3) + np.where(here <= last, each[np.minimum(here, len(each) - 1)], _U(k)))
    return np.asarray(owner)[of], out


def sketches(owner: np.ndarray, hashes: np.ndarray, n: int, t: int = COORDINATES) -> np.ndarray:
    """n x t coordinates; rows without elements hold the largest number throughout. t: a power of two up to 128."""
    out = np.full(n * t, _MAX, _U)
    bits = _U(64 - int(t).bit_length() + 1)
    has = np.zeros(n, bool)
    has[owner] = True
    for i in range(2 * t):
        if not len(owner):
            break
        x = _mix(hashes ^ _mix(np.array([i + 1], _U)))
        at = (x >> bits).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out, owner * t + at, (x & _U((1 << 56) - 1)) | (_U(i) << _U(56)))
        open_ = (out.reshape(n, t) == _MAX).any(1) & has
        if i == 0 or not open_.all():
            keep = open_[owner]
            owner, hashes = owner[keep], hashes[keep]
    return out.reshape(n, t)


def _lower(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts in lower case as bytes, about CHUNK bytes at a time, with the number of the first."""
    step = max(1, int(len(texts) * CHUNK / max(1, texts.nbytes)))
    for at in range(0, len(texts), step):
        low = pc.utf8_lower(texts.slice(at, step).cast(pa.large_string()))
        offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
        yield at, [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _signatures(docs: DataFrame, words: int, coordinates: int, bands: int) -> DataFrame:
    """row, doc, digest (of the text as it is, 256 bits of a cryptographic hash), and a hash for each band; documents without words are left out."""
    per = coordinates // bands

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        salt = _mix(np.arange(1, bands + 1).astype(_U) * _U(0xD6E8FEB86659FD93))
        for batch in batches:
            texts = batch.column(2)
            for at, held in _lower(texts):
                owner, hashes = shingles(held, words)
                sketch = sketches(owner, hashes, len(held), coordinates).reshape(len(held), bands, per)
                key = np.broadcast_to(salt, (len(held), bands)).copy()
                for k in range(per):
                    key = _mix(key * _U(5) + sketch[:, :, k])
                full = np.flatnonzero(np.bincount(owner, minlength=len(held)))
                digest = [blake2b(texts[at + i].as_buffer(), digest_size=32).digest() for i in full.tolist()]
                rows = batch.slice(at, len(held)).take(pa.array(full))
                flat = pa.array(key[full].reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(digest, pa.binary()), lists], ["row", "doc", "digest", "bands"])

    rows = numbered(docs.select("doc", "text"), "row").select("row", "doc", "text").where("text IS NOT NULL")
    return rows.mapInArrow(sign, "row bigint, doc bigint, digest binary, bands array<bigint>")


def similarity(left: list[np.ndarray], right: list[np.ndarray], words: int = WORDS) -> np.ndarray:
    """Jaccard similarity of the sets of each pair of lower-case texts; 0 where both are empty."""
    n, size, keys = len(left), [], []
    for side in (left, right):
        owner, hashes = shingles(side, words)
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[new], hashes[new]
        size.append(np.bincount(owner, minlength=n))
        keys.append((owner, hashes))
    owner, hashes = (np.concatenate([a, b]) for a, b in zip(*keys))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    both = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    common = np.bincount(owner[1:][both], minlength=n)
    return common / np.maximum(1, size[0] + size[1] - common)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * CHUNK / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sides = [[x for _, held in _lower(part.column(k)) for x in held] for k in (2, 3)]
                yield part.select([0, 1]).filter(pa.array(similarity(*sides, words) >= threshold))

    a, b = (texts.select(F.col("row").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of the edges (a, b): the smallest node that it is connected to.

    Alternates the two steps of Kiveris et al., "Connected Components in MapReduce and Beyond": every node links its
    larger, then its smaller neighbours to the smallest, until nothing changes.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while was != (state := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()):
        was = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", low.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        linked = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = settled(linked.where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _elements(texts: DataFrame, words: int) -> DataFrame:
    """row, size and element: the distinct elements of each text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in _lower(batch.column(1)):
                owner, hashes = shingles(held, words)
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                owner, hashes = owner[new], hashes[new]
                size = np.bincount(owner, minlength=len(held)).astype(np.int32)
                rows = batch.column(0).slice(at, len(held)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([rows, pa.array(size[owner]), pa.array(hashes.view(np.int64))], ["row", "size", "element"])

    return texts.select("row", "text").mapInArrow(split, "row bigint, size int, element bigint")


def by_rare_elements(member: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """All pairs (a, b) of rows of different groups (row, root) that can be as similar as the threshold."""
    each = settled(_elements(texts.join(member.select("row").distinct(), "row", "left_semi"), words))
    often = each.groupBy("element").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("often", "element"))
    rare = each.join(often, "element").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    known = settled(rare.join(member.distinct(), "row").select("element", "row", "root", "size"))
    mixed = known.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("element")
    x = known.join(mixed, "element")
    y = x.select("element", F.col("row").alias("row2"), F.col("root").alias("root2"), F.col("size").alias("size2"))
    alike = (F.least("size", "size2") >= F.greatest("size", "size2") * threshold - 1e-9) & (F.col("root") != F.col("root2")) & (F.col("row") > F.col("row2"))
    return x.join(y, "element").where(alike).select(F.col("row").alias("a"), F.col("row2").alias("b")).distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int, coordinates: int, bands: int, threshold: float) -> DataFrame:
    """row, doc and first (the group's smallest id), for each document in a group but the first."""
    named = docs.select(quoted(id_col).cast("bigint").alias("doc"), quoted(text_col).cast("string").alias("text"))
    signed = settled(_signatures(named, words, coordinates, bands))
    kinds = settled(signed.groupBy("digest").agg(F.min("row").alias("row"), F.min_by("bands", "row").alias("bands")))
    every = kinds.select("row", F.explode("bands").alias("h"))
    shared = every.groupBy("h").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("h", "low")
    meet = settled(every.join(shared, "h").select("h", "row", "low"))

    wanted = meet.select("row").distinct()
    texts = settled(numbered(named, "row").select("row", "text").join(if_small(wanted, BROADCAST_ROWS), "row", "left_semi"))

    star = meet.where("row > low").groupBy(F.col("row").alias("a"), F.col("low").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    closest = star.groupBy("a").agg(F.max(F.struct("times", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    tried = settled(closest)
    links = settled(_verified(tried, texts, words, threshold))

    root = settled(components(links))
    member = meet.select("h", "row").join(root.withColumnRenamed("node", "row"), "row", "left").select("h", "row", F.coalesce("root", "row").alias("root"))
    sizes = member.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"))
    buckets = sizes.groupBy("h").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("most")).where("roots > 1")
    pairs = (F.col("n") * F.col("n") - F.col("squares")) / 2
    open_ = settled(member.join(buckets.select("h", F.col("most.root").alias("most"), (pairs > HOT * F.col("n")).alias("hot")), "h"))
    cool = open_.where(~F.col("hot"))
    few = cool.where("root <> most").select("h", F.col("row").alias("row2"), F.col("root").alias("root2"))  # one side of each pair isn't of the largest group
    rest = cool.join(few, "h").where("root <> root2").select(F.greatest("row", "row2").alias("a"), F.least("row", "row2").alias("b"))
    hot = open_.where("hot").select("row", "root")
    if not hot.isEmpty():
        rest = rest.unionByName(by_rare_elements(hot, texts, words, threshold))
    more = settled(_verified(rest.distinct().join(tried, ["a", "b"], "left_anti"), texts, words, threshold))
    root = settled(components(links.unionByName(more))) if not more.isEmpty() else root

    kind = kinds.select("digest", "row").join(root.select(F.col("node").alias("row"), "root"), "row", "left").select("digest", F.coalesce("root", "row").alias("root"))
    grouped = settled(signed.select("row", "doc", "digest").join(kind, "digest").select("row", "doc", "root"))
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "row")
    firsts = grouped.groupBy("root").agg(F.min(place).alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1")
    joined = grouped.join(firsts.select("root", F.col("x.doc").alias("first"), F.col("x.row").alias("first_row")), "root")
    return joined.where("row <> first_row").select("row", "doc", "first")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, coordinates: int = COORDINATES, bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, duplicate_of``: each document that is, directly or by a chain of others, similar to an earlier one.

    ``duplicate_of`` is the smallest id of the group; null ids come last, and rows that agree go by their place in
    the table. Equal texts (of one digest) are similar whatever they hold, unless they have no words: such texts (empty ones too), and
    null texts, are in no group. A row repeated as a whole is a copy. Similarity is that of the whole texts, in lower
    case, punctuation aside. Other columns are ignored. An empty table gives an empty result.
    """
    found = _groups(steady(docs), id_col, text_col, words, coordinates, bands, threshold)
    return found.select(F.col("doc").alias("doc_id"), F.col("first").alias("duplicate_of"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, coordinates: int = COORDINATES, bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with one document of each group: without the rows that ``near_copies`` lists.

    Rows are told apart by their places, so ``docs`` is stored first unless it is read as it lies (``common.steady``).
    """
    docs = steady(docs)
    (row,) = fresh(docs, "row")
    drop = settled(_groups(docs, id_col, text_col, words, coordinates, bands, threshold).select(F.col("row").alias(row)))
    return numbered(docs, row).join(if_small(drop, BROADCAST_ROWS), row, "left_anti").drop(row)
