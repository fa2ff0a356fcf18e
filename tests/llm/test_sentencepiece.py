import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from termlake.llm import sentencepiece_codec as sp

PEER = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def ids(found):
    return [np.frombuffer(b, "<i4").tolist() for b, _ in found]


def test_file_is_parsed():
    model = sp.codec().model
    assert [p for p, _, _ in model.pieces] == [PEER.id_to_piece(i) for i in range(PEER.get_piece_size())]
    assert [s for _, s, _ in model.pieces] == pytest.approx([PEER.get_score(i) for i in range(PEER.get_piece_size())])
    assert model.kind == sp.BPE and model.byte_fallback and model.dummy_prefix and not model.collapse


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
@example("")
@example(" a  b ")
@example("▁x ▁")
@example("<s> <0x0A> </s> <unk>")
@example("a\nb\t c\u0000 é é 🙂 अ")
def test_parity_on_any_text(text):
    text = text.replace("\x00", "")  # the peer's texts end there
    found = sp.codec().encode([text])
    assert ids(found) == [PEER.encode(text)] and found[0][1]
    assert sp.codec().decode(ids(found)) == [PEER.decode(PEER.encode(text))]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sp.encode(docs)
    want = {r.doc_id: PEER.encode(r.text) for r in docs.collect()}
    rows = out.collect()
    assert {r.doc_id: list(r.ids) for r in rows} == want and all(r.parity and r.round_trip for r in rows)
    assert sp.decode(out).exceptAll(docs.select("doc_id", "text")).count() == 0


def unigram(path, collapse, prefix=True, byte=False):
    """A small unigram model, written field by field."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def put(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte:
        pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "a", "b", "c", "d", "ab", "▁ab", "cd", "▁c", "bc", "abc", "▁abcd", "d▁"[:1] + "a", "▁▁", "e"]
    pieces += [(w, -1.5 - 0.37 * ((7 * i) % 11) / len(w), 1) for i, w in enumerate(words)]
    data = b"".join(put(1, put(1, p.encode()) + put(2, s) + put(3, k)) for p, s, k in pieces)
    data += put(2, put(3, 1) + put(4, len(pieces)) + (put(35, 1) if byte else b"")) + put(3, put(1, b"identity") + put(2, b"") + put(3, int(prefix)) + put(4, int(collapse)))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("collapse", [True, False])
@pytest.mark.parametrize("byte", [True, False])
def test_unigram_models(tmp_path, collapse, byte):
    path = unigram(tmp_path / "m.model", collapse, byte=byte)
    own, peer = sp.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(2)
    texts = ["", "abcd", " ab  cd ", "zz é a"] + ["".join(rng.choice(list("aabbccdde  x"), rng.integers(1, 25))) for _ in range(400)]
    found = own.encode(texts)
    assert ids(found) == peer.encode(texts) and all(same for _, same in found)


def full_unigram(path):
    """A unigram model of full size with SentencePiece's own character map (NFKC): the pieces of the public vocabulary, scored by their rank.
    Scores are multiples of 1/64, so that their sums are exact in single precision too, which SentencePiece uses."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    put = lambda number, value: varint(number << 3 | 2) + varint(len(value)) + value
    model = sp.codec().model
    data = b"".join(put(1, put(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", -round(64 * np.log(i + 10.0)) / 64 if k == sp.NORMAL else 0.0) + varint(3 << 3) + varint(k)) for i, (p, _, k) in enumerate(model.pieces))
    trainer = varint(3 << 3) + varint(sp.UNIGRAM) + varint(35 << 3) + varint(1)
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = dict(sp._fields(dict(sp._fields(normalizer))[3]))[2]
    assert len(charsmap) > 100_000
    data += put(2, trainer) + put(3, put(1, b"nmt_nfkc") + put(2, charsmap) + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1))
    path.write_bytes(data)
    return str(path)


def test_unigram_with_character_map_on_whole_table(spark, sf_dir, tmp_path):
    path = full_unigram(tmp_path / "u.model")
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(-1, "ﬁne ① Ｗｉｄｅ  spaces\u3000here\u00a0too"), (-2, "e\u0301 \u00bd \u2460"), (-3, " lead and trail "), (-4, "\t tab\n\nline \u200b zero"), (-5, "日本語 🙂 ｶﾅ")]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = sp.encode(every, path=path).collect()
    want = {r.doc_id: peer.encode(r.text) for r in every.collect()}
    assert {r.doc_id: list(r.ids) for r in rows} == want and all(r.parity for r in rows)
    texts = {r.doc_id: r.text for r in every.collect()}
    assert all(r.round_trip == (peer.decode(want[r.doc_id]) == texts[r.doc_id]) for r in rows)


def test_what_disagrees_is_told(monkeypatch):
    one = sp.Codec(sp.MODEL)
    texts = ["some words", "", "other words here", "  spaces"]
    ids, sizes, same = one.encode_all(texts)
    assert same.all() and one.come_back(texts, ids, sizes).all()
    wrong = ids.copy()
    wrong[int(sizes[0])] += 1
    assert one._agrees(texts, wrong, sizes).tolist() == [True, True, False, True] == one.come_back(texts, wrong, sizes).tolist()
    assert one._agrees(texts, ids[:-1], sizes - [0, 0, 0, 1]).tolist() == [True, True, True, False]
    assert one.come_back(["some wordz", "", "other words here!", "  spaces"], ids, sizes).tolist() == [False, True, False, True]


def test_edges(spark):
    schema = "doc_id bigint, text string, ids string, parity int"
    assert sp.encode(spark.createDataFrame([], schema)).count() == 0
    long = "some words of a long text " * 60_000
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "a", None, 1), (3, long, "x", 1), (3, long, "x", 1)]
    got = sp.encode(spark.createDataFrame(rows, schema)).collect()
    assert [r.doc_id for r in got] == [1, 2, None, 3, 3] and got[0].ids is None and got[0].parity is None and got[1].ids == []
    assert got[3].ids == PEER.encode(long) and all(r.parity and r.round_trip for r in got[1:])
    back = sp.decode(spark.createDataFrame([(1, None), (2, []), (3, [None, 10**6, -1, 263])], "doc_id int, ids array<int>")).collect()
    assert [r.text for r in back][:2] == [None, ""] and back[2].text == PEER.decode([263])


def test_new_words_are_encoded_in_few_texts():
    """One call of the library for each word took most of an executor's time next to the parity check."""
    one, sent = sp.Codec(sp.MODEL), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            sent.append(len(texts))
            return self.tokenizer.encode_batch_fast(texts, **options)

    one.tokenizer = Counted(one.tokenizer)
    odd = ["<s>", "<0x0A>", "</s>", "<unk>", "a\nb\tc", "é", "é", "🙂🙂", "अ", "日本語", "x" * 3000, " ", "﻿", "'", "a"]
    texts = [" ".join(f"{w}{i * 7919 % 1000}{w}" for i in range(k, k + 300)) for k, w in enumerate(odd)] + odd
    found = one.encode(texts)
    assert ids(found) == [PEER.encode(t) for t in texts] and all(k for _, k in found)
    assert sum(sent) < 10
    again = ["some words and one space at the end ", "", "other new words"]  # the empty word goes alone
    assert ids(one.encode(again)) == [PEER.encode(t) for t in again]
