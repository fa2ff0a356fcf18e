import io
import os
import struct

import pytest
import zstandard

from termlake.llm import warc

ITEMS = [warc.encoded("resource", f"http://a.example/{i}", f"<urn:uuid:{i}>", "2024-01-01T00:00:00Z", (f"<html>page {i} " * (i % 7)).encode(), "text/html") for i in range(60)]
DICTIONARY = zstandard.train_dictionary(2048, [(f"<html>page {i} some common text here {i % 5} " * 6).encode() for i in range(500)]).as_bytes()


def archive(items=ITEMS, dictionary=DICTIONARY):
    file = io.BytesIO()
    assert warc.write_archive(file, iter(items), dictionary) == len(items)
    return file.getvalue()


@pytest.mark.parametrize("dictionary", [None, DICTIONARY])
@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_round_trip(dictionary, piece, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", piece)
    got = list(warc.records(io.BytesIO(archive(dictionary=dictionary))))
    assert [r["content"] for r in got] == [(f"<html>page {i} " * (i % 7)).encode() for i in range(60)]
    assert not any(r["error"] for r in got) and got[3]["target_uri"] == "http://a.example/3"


def test_dictionary_is_in_the_leading_frame():
    data = archive()
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    raw = struct.pack("<II", 0x184D2A5D, len(DICTIONARY)) + DICTIONARY
    plain = raw + data[warc.frame_size(data) :]
    assert [r["content"] for r in warc.records(io.BytesIO(plain))] == [r["content"] for r in warc.records(io.BytesIO(data))]
    without = data[warc.frame_size(data) :]
    assert all(r["error"] for r in warc.records(io.BytesIO(without)) if r.get("content") is None) and any(r.get("error") for r in warc.records(io.BytesIO(without)))


def test_frame_sizes_equal_the_library():
    for size in (0, 1, 300, 70_000, 400_000):
        for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
            frame = zstandard.ZstdCompressor(**options).compress(os.urandom(size))
            assert warc.frame_size(frame + b"rest") == len(frame)
            assert warc.frame_size(frame[:-1]) is None


def test_what_is_wrong_is_told():
    good = ITEMS[5]
    cases = {
        good.replace(b"WARC/1.1", b"HTTP/1.1"): "version",
        good.replace(b"Content-Length: ", b"Content-Length: 1"): "content-length",
        good[:-2] + b"xx": "line ends",
        good.replace(b"WARC-Date", b"X-Date"): "warc-date",
        good.replace(b"<html>page 5", b"<html>page 6"): "digest",
        b"": "headers",
        b"WARC/1.1\r\nnonsense\r\n\r\n\r\n\r\n": "name",
    }
    got = list(warc.records(io.BytesIO(archive([*cases, good]))))
    for r, word in zip(got, cases.values()):
        assert word in r["error"] and r["content"] is None
    assert got[-1]["error"] is None
    folded = good.replace(b"WARC-Type: resource", b"X-Long: a\r\n\tb\r\nWARC-Type: resource")
    assert warc.parsed(folded)["headers"]["x-long"] == "a b"


def test_damaged_files():
    data = bytearray(archive())
    assert list(warc.records(io.BytesIO(b""))) == []
    cut = list(warc.records(io.BytesIO(data[:-3])))
    assert len(cut) == 60 and "ends" in cut[-1]["error"] and not cut[-2]["error"]
    at = [p for p, _ in warc.frames(io.BytesIO(data))][20]
    data[at + 25] ^= 0xFF
    got = list(warc.records(io.BytesIO(data)))
    assert sum(bool(r["error"]) for r in got) >= 1 and not got[0]["error"]
    assert "no frame" in list(warc.records(io.BytesIO(b"garbage here")))[0]["error"]


def test_pages_come_back(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert warc.write(pages.repartition(3), f"file://{tmp_path}/a") == pages.count()
    got = warc.read(spark, f"file://{tmp_path}/a")
    assert got.where("error IS NOT NULL").count() == 0
    rows = {(int(r.headers["x-page-id"]), r.target_uri, bytes(r.content).decode()) for r in got.collect()}
    assert rows == {(r.page_id, r.url, r.html) for r in pages.collect()}
    assert len(os.listdir(tmp_path / "a")) == 3


def test_edges(spark, tmp_path):
    schema = "page_id bigint, url string, html string, offset int, content string"
    assert warc.write(spark.createDataFrame([], schema).coalesce(1), f"file://{tmp_path}/e") == 0
    long = "<p>é</p>" * 500_000
    rows = [(1, None, None, 1, "c"), (None, "http://x/\r\ny", "", 1, "c"), (2, "u", long, 1, "c"), (2, "u", long, 1, "c")]
    assert warc.write(spark.createDataFrame(rows, schema).coalesce(1), f"file://{tmp_path}/b") == 4
    got = warc.read(spark, f"file://{tmp_path}/b").orderBy("offset").collect()
    assert [r.error for r in got] == [None] * 4 and [r.target_uri for r in got] == [None, "http://x/ y", "u", "u"]
    assert got[3].content.decode() == long and "x-page-id" not in got[1].headers
    open(tmp_path / "b" / "zero.warc.zst", "wb").close()
    assert warc.read(spark, f"file://{tmp_path}/b").count() == 4


def test_prefix_of_the_sample_is_a_parameter(spark):
    pages = spark.createDataFrame([(f"<p>{i}</p>" * 50 + f"<footer class='marker-of-the-end-{i % 3}'>" * 40,) for i in range(200)], "html string")
    whole, start = (warc.train(pages, prefix=n) for n in (warc.PREFIX, 300))
    assert b"marker-of-the-end" in whole and b"marker-of-the-end" not in (start or b"")
