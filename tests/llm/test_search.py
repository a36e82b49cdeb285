"""Top-k against a full product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityflow.llm import search


def brute(ids, x, k):
    out = set()
    for i, q in zip(ids, x):
        if i % 50 == 0:
            best = sorted((-int(q @ y), j) for j, y in zip(ids, x) if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def found(spark, rows, **p):
    df = spark.createDataFrame([(i, [float(v) for v in x] if x is not None else None) for i, x in rows], "vec_id long, embedding array<double>")
    got = search.top_k(df.withColumn("v", F.lit(1)), F.col("vec_id"), search.scaled(F.col("embedding"), 1.0), F.col("vec_id") % 50 == 0, search.SearchParams(**p))
    return {tuple(r) for r in got.collect()}


@pytest.mark.parametrize("kind", ["random", "copies", "clusters"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.integers(-40, 40, (600, 8))
    if kind == "copies":
        x[100:500] = x[0]
    if kind == "clusters":
        x = x[rng.integers(0, 12, 600)] * 10 + rng.integers(-1, 2, (600, 8))
    rows = list(enumerate(x))
    assert found(spark, rows, shard=100, block=4, leaf=16) == brute(range(600), x, 5)


def test_large_components_and_few_rows(spark):
    x = np.array([[2**40, 1], [2**21, -3], [-(2**20), 5]])
    assert found(spark, list(enumerate(x))) == brute(range(3), x, 5)
    assert found(spark, []) == set()


def test_unsound_vectors_take_no_part(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
                                (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    got = search.top_k(df, F.col("vec_id"), search.scaled(F.col("embedding")), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 256 * 128 + 512 * 128)]


def test_bounds_drop_nodes(monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 4)) * 5 + c for c in (0, 300, -300)]).astype(np.int64)
    looked = []
    real = search.ball_tree
    monkeypatch.setattr(search, "ball_tree", lambda a, leaf: looked.append(real(a, leaf)) or looked[-1])
    r, ids, _ = search.search_shard(np.arange(600), x, np.array([-1]), np.array([[1, 1, 1, 1]]), np.array([1100]), search.SearchParams())
    assert set(ids) <= set(range(200, 400)) and len(r) == 5
