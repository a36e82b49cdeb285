"""Statistics against plain Python, tails against exact sums, cutoffs on planted labels."""

import math
import random
import re

import pytest
from helpers import DOCS, awkward, nothing
from pyspark.sql import functions as F

from entityflow.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else {w for w, n in _count(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def _count(windows):
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    return seen


def test_statistics(spark):
    rng = random.Random(2)
    few = ["a", "b", "c", "D#", "é|", "<x>"]
    texts = [
        None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \n \nx", "\U0001f600 é #*$%&|<>",
        *(" ".join(rng.choices(few, k=rng.randint(0, 60))) for _ in range(80)),
        *("\n".join(" ".join(rng.choices([f"w{i}" for i in range(40)], k=rng.randint(0, 200))) for _ in range(5)) for _ in range(30)),
        " ".join(f"w{i % 977}" for i in range(3000)),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality.statistics(df).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got.collect():
        assert tuple(r)[1:] == brute(texts[r.doc_id]), texts[r.doc_id]


@pytest.mark.parametrize("n, k, p", [(1, 0, 0.1), (50, 0, 0.05), (500, 2, 0.0125), (3000, 20, 0.0125), (40_000, 450, 0.0125), (10, 9, 0.5), (0, 0, 0.1)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), p).alias("x")).first().x
    if k >= n * p:
        assert got == 1.0
        return
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    assert got == pytest.approx(sum(map(math.exp, logs)), rel=1e-8)


def corpus(spark, junk_good):
    """Clean texts, and junk with a third of symbols; ``junk_good`` junk texts are labelled good."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        junk = i % 5 == 0
        rows.append((i, " ".join(w + ("***" if junk else "") for w in words), "en", "a", 1))
        labels.append((i, int(not junk or i < 5 * junk_good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_texts_stay(spark):
    docs, labels = corpus(spark, 0)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i in range(1500) if i % 5}


def test_no_cutoff_without_evidence(spark):
    docs, labels = corpus(spark, 100)  # a third of the junk is good by its labels
    assert quality.keep_good(docs, labels).count() == 1500
    docs, labels = corpus(spark, 0)
    assert quality.keep_good(docs, labels.where("doc_id < 300")).count() == 1500
    assert quality.keep_good(docs, labels.where("false")).count() == 1500


def test_awkward_tables(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, 0), (4, None, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    docs = awkward(spark)
    judged = quality.judge(docs, labels).collect()
    assert len(judged) == docs.count() and {r.row.doc_id for r in judged if not r.base_failed} == {3} - {3}  # it repeats itself
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(nothing(spark), labels).count() == 0
