"""WARC archives compressed by Zstandard: one frame for each record, the dictionary in a skippable frame in front.

A reader task takes one file, reads it in pieces, finds where each frame ends from the block headers, and decodes frames one
by one, so memory holds a record and not the archive. Records are validated: version line, the four mandatory fields, the
block's length, the two line ends after it, and a SHA-1 digest if there is one. What is wrong is told in ``error``, and the
reader goes on with the next frame where it can.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm.common import quoted

MAGIC = 0xFD2FB528
SKIPPABLE = 0x184D2A50
DICTIONARY = 0x184D2A5D
PIECE = 1 << 20
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
OUT = "file string, offset bigint, warc_type string, record_id string, warc_date string, target_uri string, content_type string, headers map<string,string>, content binary, error string"
#: The dictionary is trained on pages that their hashes choose, this many at most.
SAMPLE, DICTIONARY_BYTES = 2_000, 64 << 10
#: Characters of each of these pages that train it, at most: it bounds what reaches the driver. Archives hold whole pages.
PREFIX = 1 << 16


class Broken(ValueError):
    """The file can't be read on from here."""


def frame_size(data: bytes, at: int = 0) -> int | None:
    """Length of the frame at this place (RFC 8878), or None if the data end before it does."""
    if len(data) - at < 8:
        return None
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        (size,) = struct.unpack_from("<I", data, at + 4)
        return 8 + size if len(data) - at >= 8 + size else None
    if magic != MAGIC:
        raise Broken("no frame here")
    flags = data[at + 4]
    single = flags >> 5 & 1
    here = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if len(data) < here + 3:
            return None
        block = int.from_bytes(data[here : here + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise Broken("reserved block type")
        here += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            here += 4 * (flags >> 2 & 1)
            return here - at if len(data) >= here else None


def frames(file) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each frame of an open file."""
    data, base, at = b"", 0, 0
    while True:
        size = frame_size(data, at) if at < len(data) else None
        if size is None:
            more = file.read(max(PIECE, len(data) - at))  # a long record is read in pieces that double
            if not more:
                if at < len(data):
                    raise Broken(f"the file ends within a frame, at {base + at}")
                return
            data, base, at = data[at:] + more, base + at, 0
            continue
        yield base + at, data[at : at + size]
        at += size


def dictionary_of(frame: bytes) -> bytes | None:
    """The dictionary that a leading frame carries, itself compressed or not; None if it isn't such a frame."""
    import zstandard

    if struct.unpack_from("<I", frame)[0] != DICTIONARY:
        return None
    held = frame[8:]
    if held[:4] == struct.pack("<I", MAGIC):
        return zstandard.ZstdDecompressor().decompressobj().decompress(held)
    return held


def parsed(record: bytes) -> dict:
    """A record's fields and content, and what is wrong with it."""
    out = dict.fromkeys(("warc_type", "record_id", "warc_date", "target_uri", "content_type", "headers", "content", "error"))
    head, gap, block = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return out | {"error": "no version line" if gap else "no end of headers"}
    fields: dict[str, str] = {}
    key = None
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and key:  # a folded line
            fields[key] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            return out | {"error": "a header line without a name"}
        key = name.strip().lower()
        fields.setdefault(key, value.strip())
    out |= {"headers": fields, "warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "warc_date": fields.get("warc-date"), "target_uri": fields.get("warc-target-uri"), "content_type": fields.get("content-type")}
    if missing := [m for m in MANDATORY if not fields.get(m)]:
        return out | {"error": "missing " + ", ".join(missing)}
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()) or len(block) != int(length) + 4:
        return out | {"error": f"content-length {length}, found {len(block) - 4}"}
    if block[-4:] != b"\r\n\r\n":
        return out | {"error": "no line ends after the block"}
    content = block[:-4]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and base64.b32encode(hashlib.sha1(content).digest()).decode() != digest.upper():
        return out | {"error": "block digest differs"}
    return out | {"content": content}


def records(file) -> Iterator[dict]:
    """The records of an open archive, with their places."""
    import zstandard

    decoder, at = zstandard.ZstdDecompressor(), 0
    try:
        for k, (at, frame) in enumerate(frames(file)):
            if frame[:4] != struct.pack("<I", MAGIC):
                if k == 0 and (held := dictionary_of(frame)) is not None:
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
                continue
            try:
                yield {"offset": at} | parsed(decoder.decompressobj().decompress(frame))
            except zstandard.ZstdError as e:
                yield {"offset": at, "error": f"frame: {e}"}
    except (Broken, zstandard.ZstdError) as e:
        yield {"offset": at, "error": str(e)}


def encoded(kind: str, uri: str | None, record_id: str, date: str, content: bytes, content_type: str, **more: str) -> bytes:
    """A record with its headers, before compression."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode(), "Content-Type": content_type, "Content-Length": str(len(content))} | more
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + content + b"\r\n\r\n"


def write_archive(file, items: Iterator[bytes], dictionary: bytes | None = None, level: int = 6) -> int:
    """Records, as ``encoded`` gives them, to an open file; their number."""
    import zstandard

    options = {}
    if dictionary:
        packed = zstandard.ZstdCompressor(level=12).compress(dictionary)
        file.write(struct.pack("<II", DICTIONARY, len(packed)) + packed)
        options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, **options)
    n = 0
    for item in items:
        file.write(compressor.compress(item))
        n += 1
    return n


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, size: int = DICTIONARY_BYTES, prefix: int = PREFIX) -> bytes | None:
    """A dictionary from the first ``prefix`` characters of at most ``sample`` pages; None if they are too few for one.

    A count sets the share of hashes that gives about as many pages, so each partition sends only its part of the sample.
    """
    import zstandard

    text = quoted(html_col).cast("string").alias("html")
    share = min(1.0, 1.2 * sample / max(1, pages.count()))
    texts = pages.select(F.substring(text, 1, prefix).alias("html")).where("html IS NOT NULL")
    chosen = texts.where(F.pmod(F.xxhash64("html"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).orderBy(F.xxhash64("html"), "html").limit(sample)
    samples = [r.html.encode() for r in chosen.collect()]
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:
        return None


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> int:
    """An archive in ``folder`` (shared by all executors) for each partition of ``pages``; the number of records.

    Each row becomes a resource record, with its id in the header X-Page-ID; a null text is an empty block, like an empty one, a null url or id
    leaves its header out. A page of any length is one record. Repeated rows give a record each. Other columns are ignored, whatever their
    names. An empty table gives no records. A file gets its name when it is whole, and a task that runs twice
    puts the same content under the same name.
    """
    dictionary = train(pages, html_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        final, own = f"{root}/part-{part:06d}.warc.zst", f"{root}/_part-{part:06d}-{uuid.uuid4().hex}"

        def items() -> Iterator[bytes]:
            n = 0
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{part}/{n}/{page}/{url}")
                    n += 1
                    yield encoded("resource", url, f"<urn:uuid:{name}>", date, (html or "").encode(), "text/html; charset=utf-8", **({} if page is None else {"X-Page-ID": str(page)}))

        with system.open_output_stream(own, compression=None) as file:
            n = write_archive(file, items(), dictionary)
        system.move(own, final)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    rows = pages.select(quoted(id_col).cast("bigint"), quoted(url_col).cast("string"), quoted(html_col).cast("string"))
    return sum(r.n for r in rows.mapInArrow(task, "n bigint").collect())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all ``*.warc.zst`` files in a folder, a task for each few files; see ``OUT``.

    ``headers`` has lower-case names; of several headers of a name the first counts. A record may be as long as memory allows; records that
    agree are all there. A folder without such files gives an empty result. A record that isn't valid has an ``error`` and no content. An empty file has no records.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = {"headers": pa.map_(pa.string(), pa.string()), "content": pa.binary(), "offset": pa.int64()}
        names = [c.split()[0] for c in OUT.split(", ")]
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

        def flushed(rows: list[dict]) -> pa.RecordBatch:
            columns = [[r.get(n) for r in rows] for n in names]
            columns[names.index("headers")] = [h and list(h.items()) for h in columns[names.index("headers")]]
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, columns)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with system.open_input_stream(place, compression=None) as file:
                    for record in records(file):
                        held.append({"file": path.rpartition("/")[2]} | record)
                        size += len(record.get("content") or b"") + 500
                        if size > 1 << 22:
                            yield flushed(held)
                            held, size = [], 0
                if held:
                    yield flushed(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path").where(F.length("path") > 0)
    each = max(1, min(4096, files.count()))
    return files.repartition(each).mapInArrow(task, OUT)
