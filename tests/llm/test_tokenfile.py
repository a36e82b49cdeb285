"""Token folders: exact round trips, order and starts against a plain pass, blocks against any numbers."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, nothing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entityflow.llm import tokenfile, tokens
from entityflow.llm.tokenfile import PforParams, pack_ids, unpack_ids
from entityflow.sources.storage import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(PATH)
LETTERS = st.one_of(st.sampled_from("aB's.,!? \n\t\x0b\x0c\r\x1c\x85  ΣςİÉé̱́HhKÅ<|>endoftxENDOFTX01٣"), st.characters(exclude_categories=["Cs"]))


def whole(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=60), max_size=5))
def test_words_give_the_ids_of_the_whole_text(texts):
    ENCODER.forget()
    assert ENCODER.encode(texts) == [whole(t) for t in texts]
    assert ENCODER.encode(texts) == [whole(t) for t in texts]


@pytest.mark.parametrize("text", ["İ.", "İstanbul, İ. İ,", "<|ENDOFTEXT|> <|endoftext|>. a<|startoftext|>b", "H̱. ẖ,", "ΌΣΟΣ. ΌΣΟΣ", "K. Å,"])
def test_words_that_lower_case_oddly(text):
    assert tokens.Encoder(PATH).encode([text]) == [whole(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=200), st.integers(1, 40), st.sampled_from([0.01, 0.5, 0.9, 1.0]), st.data())
def test_blocks(values, block, share, data):
    ids, p = np.array(values, np.uint32), PforParams(block=block, share=share)
    packed = pack_ids(ids, p)
    assert unpack_ids(packed).tolist() == values
    start = data.draw(st.integers(0, len(values)))
    n = data.draw(st.integers(0, len(values)))
    assert unpack_ids(packed, start, n).tolist() == values[start : start + n]


def test_blocks_are_patched():
    """One huge value in a block of small ones is an exception and does not widen the block."""
    ids = np.tile(np.arange(8, dtype=np.uint32), 512)
    plain = len(pack_ids(ids))
    ids[1000] = 2**31
    assert len(pack_ids(ids)) == plain + 8
    assert plain < len(ids) * 3 // 8 + 200
    assert unpack_ids(pack_ids(ids))[1000] == 2**31


def expected(spark, rows, end=2):
    """(id, start, n, crc, ids) in the order of id (NULL last) and, within one id, of the texts' hashes."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    out, start = [], 0
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h)):
        ids = np.frombuffer(whole(r.text or "") + np.array([end], "<u4").tobytes(), "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [1, 500, 1 << 18])
def test_folder(spark, segment):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"w{k}" for k in rng.integers(0, 999, rng.integers(0, 90)))) for i in rng.permutation(400)]
    rows += [(None, "no id"), (None, None), (7, "again"), (7, "again"), (13, ""), (500, "long " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = scratch(spark, "tokens")
    tokenfile.write_tokens(df, F.col("text"), F.col("doc_id"), PATH, path, PforParams(segment=segment))
    got = tokenfile.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    want = expected(spark, rows)
    assert [tuple(r) for r in got] == want
    stream = [x for r in want for x in r[4]]
    for start, n in ((0, 1), (1234, 5000), (len(stream) - 3, 10), (len(stream), 5)):
        pieces = tokenfile.read_range(spark, path, start, n).orderBy("start").collect()
        assert [x for r in pieces for x in r.ids] == stream[start : start + n]


def test_one_id_is_written_by_many_tasks(spark):
    df = spark.range(4000).select(F.lit(5).alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    path = scratch(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfile.write_tokens(df, F.col("text"), F.col("doc_id"), PATH, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(f"{path}/segments").select("part").distinct().count()
    assert parts > 4 and tokenfile.read_documents(spark, path).count() == 4000


def test_awkward_tables(spark):
    df = awkward(spark)
    path = scratch(spark, "tokens")
    tokenfile.write_tokens(df, F.col("text"), F.col("doc_id"), PATH, path)
    got = tokenfile.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    path = scratch(spark, "tokens")
    tokenfile.write_tokens(nothing(spark), F.col("text"), F.col("doc_id"), PATH, path)
    assert tokenfile.read_documents(spark, path).count() == 0
