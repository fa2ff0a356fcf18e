import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termlake.llm import packing, tokens


def brute(docs, window):
    """docs: (id, text) in order."""
    encode = tokens.Encoder(tokens.VOCABULARY).whole
    flat = [(i, t) for i, text in docs if text is not None for t in [*np.frombuffer(encode(text), "<u2").tolist(), tokens.END]]
    out = []
    for k in range(0, len(flat), window):
        part, spans = flat[k : k + window], []
        out.append((k // window, [t for _, t in part], [i for i, _ in part]))
    return out


def spread(rows):
    return sorted((r.seq_id, list(r.tokens), [d for d, n in zip(r.doc_ids, r.doc_lens) for _ in range(n)]) for r in rows)


TEXTS = ["", None, "one two three", "ein Text über Öl", " lead", "trail ", "a  b", "x\n \n y", "word " * 300, "long" * 2000, "é", "1 2 3 4", "don't it's"]


@pytest.mark.parametrize("window", [1, 7, 64, 2048])
@pytest.mark.parametrize("parts", [1, 3, 9])
def test_equals_brute_force(spark, window, parts):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    df = df.checkpoint()
    order = [(r.doc_id, r.text) for r in df.collect()]
    assert spread(packing.pack(df, window).collect()) == brute(order, window)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = [(r.doc_id, r.text) for r in df.collect()]
    got = packing.pack(df).collect()
    assert spread(got) == brute(order, packing.WINDOW)
    assert all(sum(r.doc_lens) == len(r.tokens) for r in got)


def test_empty_null_repeated_and_clashing(spark):
    schema = "doc_id bigint, text string, tokens string, seq_id int, ids int"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None, "", 0, 0)], schema)).count() == 0
    df = spark.createDataFrame([(1, "", "x", 3, 0), (None, "a", None, None, 0), (1, "", "x", 3, 0)], schema).coalesce(1)
    (row,) = packing.pack(df).collect()
    assert row.doc_ids == [1, None, 1] and row.doc_lens == [1, 2, 1] and row.tokens[0] == tokens.END


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab'sé1. 　\x1c\x85"), max_size=24))
@example("a \n b")
@example("a\n ")
@example("x  　 y")
def test_pieces_give_the_same_ids(text):
    e = tokens.encoder()
    assert e.encode(text) == e.whole(text)


PATTERNS = [(4, tuple(p for p in range(4) if bits >> p & 1)) for bits in range(16)] + [(1, (0,)), (8, (0, 1)), (8, (7,)), (8, (3, 4)), (8, (0, 7)), (8, (0, 2, 5))]


@pytest.mark.parametrize("parts,full", PATTERNS)
def test_partitions_without_tokens(spark, parts, full):
    """Leading, middle and trailing partitions without any text."""
    text = F.expr("CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'one two three' ELSE repeat('word ', 30) END")
    rows = spark.range(0, 3 * parts, 1, parts).where(F.floor(F.col("id") / 3).isin(*full) if full else F.lit(False))
    docs = rows.select(F.col("id").alias("doc_id")).withColumn("text", text)
    assert docs.rdd.getNumPartitions() == parts or not full
    order = [(r.doc_id, r.text) for r in docs.collect()]
    assert spread(packing.pack(docs, 16).collect()) == brute(order, 16)
