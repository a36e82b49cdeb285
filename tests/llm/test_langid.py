"""Viterbi against brute force, spans of mixed texts, accuracy on held-out documents."""

import itertools

import numpy as np
import pytest
from helpers import nothing
from pyspark.sql import functions as F

from entityflow.llm import langid, queries


def path_score(scores, path, switch):
    return sum(scores[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        scores = rng.normal(size=(n, 3)).round(3) * 3
        got = langid.viterbi(scores, np.array([0]), np.array([n]), 2.0)
        best = max(path_score(scores, p, 2.0) for p in itertools.product(range(3), repeat=n))
        assert path_score(scores, got, 2.0) == pytest.approx(best)


def test_texts_together_are_as_alone_and_plain_ones_skip_nothing():
    rng = np.random.default_rng(4)
    length = rng.integers(1, 40, 50)
    scores = rng.normal(size=(int(length.sum()), 3))
    scores[:, 0] += 0.3
    start = np.cumsum(length) - length
    together = langid.viterbi(scores, start, length, 4.0)
    best, plain = langid._plain(scores.astype(np.float32), np.repeat(np.arange(50), length), 50, 4.0)
    assert plain.any() and not plain.all()
    for i, (s, n) in enumerate(zip(start, length)):
        alone = langid.viterbi(scores[s : s + n], np.array([0]), np.array([n]), 4.0)
        assert (together[s : s + n] == alone).all()
        if plain[i]:
            assert (alone == best[i]).all()


def train(spark):
    de = "der schnelle braune fuchs springt über den faulen hund und die katze schläft heute nicht im großen haus"
    en = "the quick brown fox jumps over the lazy dog and the cat does not sleep today in that large house with them"
    ru = "быстрая коричневая лиса прыгает через ленивую собаку и кошка сегодня не спит в большом доме"
    rows = [(en, "en"), (de, "de"), (ru, "ru"), (None, "en"), (en, None)] + [(en, "en")] * 3
    return spark.createDataFrame(rows, "text string, lang string"), en, de, ru


def test_spans_of_a_mixed_text(spark):
    table, en, de, ru = train(spark)
    model = langid.fit(table, F.col("text"), F.col("lang"))
    assert model.languages == ["de", "en", "ru"]
    mixed = f"{en}. {de}! {ru}"
    texts = [mixed, None, "", "123 ... 4", "γειά", ru, "x" * (1 << 21), f"{en} " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("zz")).withColumn("score", F.lit(2))
    got = {r.doc_id: r for r in langid.identify(df, F.col("text"), model, doc_id=F.col("doc_id")).collect()}
    assert [(mixed[a:b].strip(" .!"), lang) for a, b, lang in got[0].spans] == [(en, "en"), (de, "de"), (ru, "ru")]
    assert all((got[i].lang, got[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert got[5].lang == "ru" and got[7].lang == "en" and got[6].score == 1.0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    model = langid.fit(nothing(spark), F.col("text"), F.col("lang"))
    df = spark.createDataFrame([("a b",)], "text string")
    assert langid.identify(df, F.col("text"), model).first().lang == "und"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_language"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
