"""Packing: whole-text token ids, exact pieces, gapless sequences, few of them."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entityflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB's.,!? \n\t\x1c  ΣςİéÉ́<|>endoftx01٣"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_word_by_word_is_the_whole_text(texts):
    encoder = packing.Encoder(PATH)
    assert encoder.encode(texts) == [whole(t) for t in texts]
    assert encoder.encode(texts) == [whole(t) for t in texts]


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|> x<|startoftext|>.", "It's THE end.", "x" * 500, "a... b!? 12,3.", "ΌΣΟΣ. ΌΣΟΣ"])
def test_special_texts(text):
    assert packing.Encoder(PATH).encode([text]) == [whole(text)]


def test_an_encoder_keeps_few_words():
    """A worker's encoder lives as long as the worker, beside the JVM of later stages; it kept a million words before."""
    encoder = packing.Encoder(PATH)
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{i}" for i in range(lo, lo + 60_000)) for lo in range(0, 240_000, 60_000)]
    for text in texts:
        assert encoder.encode([text, "known words"])[1] == whole("known words")
        assert len(encoder.known) <= 200_000 and len(encoder.length) == len(encoder.begin) == len(encoder.known)
    assert encoder.encode([texts[-1], texts[0]]) == [whole(texts[-1]), whole(texts[0])]


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def check(texts, got, p):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = whole(text or "") + np.array([p.end_id], "<u4").tobytes()
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == [p.capacity * k for k in range(len(parts))]
        assert sum(r.length for r in parts) == len(ids) // 4 and all(0 < r.length <= p.capacity for r in parts)
        assert all(r.length == p.capacity for r in parts[:-1])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= p.capacity
    return len(by_sequence)


def test_pack_whole_documents(spark):
    p = packing.PackParams(capacity=64, bins=16)
    rng = np.random.default_rng(3)
    texts = [None, "", " ", *(" ".join(["word"] * int(n)) for n in rng.integers(0, 200, 300)), "same same", "same same"]
    got = packing.packed(rows(spark, texts), F.col("text"), F.col("doc_id"), PATH, p).collect()
    n = check(texts, got, p)
    assert n <= -(-sum(r.length for r in got) // 64) * 1.02 + 2


def test_blocks_and_sequences(spark):
    p = packing.PackParams(capacity=64, bins=16, block=40)
    texts = [" ".join(["word"] * (i % 50)) for i in range(400)]
    n = check(texts, packing.packed(rows(spark, texts), F.col("text"), F.col("doc_id"), PATH, p).collect(), p)
    made = packing.sequences(rows(spark, texts), F.col("text"), F.col("doc_id"), PATH, p).collect()
    assert abs(len(made) - n) <= 10 and sum(len(r.doc_ids) for r in made) == 400
    assert sum(len(r.ids) for r in made) == sum(len(whole(t)) // 4 + 1 for t in texts)


def test_empty_table_and_clashing_names(spark):
    assert packing.packed(rows(spark, []), F.col("text"), F.col("doc_id"), PATH).count() == 0
    extra = rows(spark, ["a b"]).withColumn("piece", F.lit("x")).withColumn("sequence_id", F.lit(1)).withColumn("length", F.lit(None))
    assert packing.packed(extra, F.col("text"), F.col("doc_id"), PATH).first().length == 3


def test_patterns_and_fit():
    made = packing.patterns(12, 3)
    assert len({tuple(r) for r in made}) == len(made) == 19  # partitions of 12 into at most 3 parts
    assert all(r @ np.arange(1, 13) == 12 for r in made)
    rng = np.random.default_rng(0)
    a, x = rng.random((8, 30)), np.zeros(30)
    x[[3, 17]] = (2.0, 5.0)
    fitted = packing.nonnegative_fit(a, a @ x)
    assert (fitted >= 0).all() and np.abs(a @ fitted - a @ x).max() < 1e-6
    b = rng.normal(size=8)
    fitted = packing.nonnegative_fit(a, b)
    gain = a.T @ (b - a @ fitted)
    assert (gain < 1e-6).all() and np.abs(gain[fitted > 0]).max(initial=0) < 1e-6  # optimality conditions
