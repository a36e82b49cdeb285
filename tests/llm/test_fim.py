"""Fill-in-middle: plain token lists against the learned index, exact restoring, awkward tables."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, nothing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entityflow.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
TEXT = st.text(alphabet=st.one_of(st.sampled_from("aB <P>SM\n\t.éß€𝄞İ"), st.characters(exclude_categories=["Cs"])), max_size=80)


def plainly(text, seed):
    """(n, form, prefix_chars, middle_chars, output) from the token list."""
    text = text or ""
    t = TOKEN.findall(text)
    n, h = len(t), hashlib.sha256((seed or "").encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (t[:a], t[a:b], t[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | st.none(), max_size=8))
def test_boundaries(texts):
    data, ends, starts = fim.boundaries(pa.array([None, "xx", *texts, "y"], pa.string()).slice(2, len(texts)))
    want, at = [], 0
    for t in texts:
        for token in TOKEN.findall(t or ""):
            want.append(at)
            at += len(token.encode())
    assert starts.tolist() == want and ends[-1] == at and bytes(data) == "".join(t or "" for t in texts).encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 6), st.integers(0, 5000)), min_size=1, max_size=300), st.sampled_from([0, 1, 7, 126]), st.sampled_from([1, 3, 4096]))
def test_index_is_exact_within_its_error(steps, error, window):
    offsets = np.cumsum(np.array(steps, np.int64)) - steps[0]
    index = fim.RankIndex.fit(offsets, error, window)
    rank = np.arange(len(offsets))
    assert index.cut(rank).tolist() == offsets.tolist()
    assert np.abs(offsets - index.predict(rank)).max() <= error + 1
    assert [index.cut(np.array([r]))[0] for r in rank[:20]] == offsets[:20].tolist()


def test_few_segments_serve_a_long_text():
    rng = np.random.default_rng(1)
    offsets = np.cumsum(rng.integers(1, 9, 200_000))
    index = fim.RankIndex.fit(offsets)
    assert np.array_equal(index.cut(np.arange(len(offsets))), offsets)
    assert len(index.first) < len(offsets) / 200


def test_forms(spark):
    rng = np.random.default_rng(2)
    letters = list("abc XY.,\né€𝄞")
    rows = [(i, "".join(rng.choice(letters, rng.integers(0, 120)))) for i in range(600)]
    rows += [(600, "a <P> b"), (601, "x<M>"), (602, None), (603, ""), (604, "long text. " * 40_000), (605, "<P" * 50 + ">"[:0]), (606, "S><M")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seed = F.concat(F.lit("1:"), F.col("doc_id").cast("string"))
    done = fim.fill_in_middle(df, F.col("text"), seed, doc_id=F.col("doc_id")).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    texts, seen = dict(rows), set()
    for r in done.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(texts[r.doc_id], f"1:{r.doc_id}")
        assert r.back == (texts[r.doc_id] or "")
        seen.add(r.form)
    assert seen == {"plain", "psm", "spm"} and done.count() == len(rows)


def test_stored_index(spark):
    rows = [(0, "one two  three é four. " * 700), (1, ""), (2, None), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = fim.rank_index(df, F.col("text"), fim.FimParams(error=9), doc_id=F.col("doc_id"))
    ranks = index.withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("n"))))
    got = ranks.select("doc_id", "rank", fim.cut_at(*[F.col(c) for c in ("first", "at", "slope", "residual", "rank")]).alias("cut"))
    for i, text in rows:
        tokens = TOKEN.findall(text or "")
        want = np.cumsum([0, *[len(t.encode()) for t in tokens]]).tolist()
        assert [r.cut for r in got.where(F.col("doc_id") == i).orderBy("rank").collect()] == want


def test_awkward_tables(spark):
    df = awkward(spark)
    done = fim.fill_in_middle(df, F.col("text"), F.col("doc_id").cast("string"), n_chars=F.col("n_chars"), doc_id=F.col("doc_id"))
    got = sorted((tuple(r) for r in done.select("n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str)
    assert got == sorted((plainly(r.text, None if r.doc_id is None else str(r.doc_id)) for r in df.select("doc_id", "text").collect()), key=str)
    assert done.columns == ["n_chars", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(nothing(spark), F.col("text"), F.col("doc_id").cast("string"), doc_id=F.col("doc_id")).count() == 0


@pytest.mark.parametrize("text", ["<P><S>", "a<S>b"])
def test_markers_in_texts_stay_plain(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = fim.fill_in_middle(df, F.col("text"), F.lit("1:1")).first()
    assert r.form == "plain" and r.output == text
