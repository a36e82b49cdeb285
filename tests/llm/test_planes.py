"""Bit planes against plain integer arithmetic, clustering against a plain pass."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entityflow.llm import planes
from entityflow.llm.planes import KMeansParams


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 27), st.integers(0, 2**32 - 1))
def test_products_and_squares(bits, seed):
    rng = np.random.default_rng(seed)
    x, c = (rng.integers(-(1 << bits), 1 << bits, (n, 64)) for n in (5, 3))
    x[0], x[1] = -(1 << bits), (1 << bits) - 1
    px, pc = planes.to_planes(x, bits + 1), planes.to_planes(c, bits + 1)
    assert np.array_equal(planes.from_planes(px), x)
    assert np.array_equal(planes.products(px, pc), x @ c.T)
    assert np.array_equal(planes.squares(px), (x * x).sum(axis=1))
    best, far = planes.nearest(px, pc)
    want = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert np.array_equal(best, want.argmin(axis=1)) and np.array_equal(far, want.min(axis=1))


def plainly(rows, p):
    """(id, cluster, distance, cluster inertia, inertia, centroid) with Python's whole numbers."""
    kept = [(i, tuple(math.floor(p.scale * x) for x in v)) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    draw = sorted(kept, key=lambda r: (hashlib.sha256(f"{p.prefix}{'' if r[0] is None else r[0]}".encode()).hexdigest()))
    centroids = [list(v) for _, v in draw[: p.k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(p.rounds):
        placed = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (k, _) in zip(kept, placed) if k == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own)]
    placed = assign()
    per = [sum(d for k, d in placed if k == c) for c in range(len(centroids))]
    return sorted(((i, c, d, per[c], sum(per), centroids[c]) for (i, _), (c, d) in zip(kept, placed)), key=str)


def found(spark, rows, p):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))
    return sorted((tuple(r) for r in planes.kmeans(df.repartition(4), F.col("vec_id"), F.col("embedding"), p).collect()), key=str)


def single(x):
    return [float(np.float32(v)) for v in x]


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    if kind == "clusters":
        x = x[rng.integers(0, 12, 300)] + rng.normal(size=(300, 64)) / 50
    if kind == "copies":
        x[:200] = x[0]
    rows = [(i, single(v)) for i, v in enumerate(x)]
    p = KMeansParams(k=8, rounds=4)
    assert found(spark, rows, p) == plainly(rows, p)


def test_unsound_vectors_ties_and_few_rows(spark):
    v = single(np.linspace(-1, 1, 64))
    rows = [(1, v), (1, v), (None, single(np.ones(64))), (2, None), (3, v[:63]), (4, [*v[:63], None]), (5, [*v[:63], float("nan")]),
            (6, [*v[:63], float("inf")]), (7, [0.0] * 64), (8, [*v, 0.0])]
    p = KMeansParams()
    got = found(spark, rows, p)
    assert [r[0] for r in got] == [1, 1, 7, None] and len(got) == 4
    assert sorted(r[2] for r in got) == [0, 0, 0, 0]
    assert {r[:3] for r in got} == {r[:3] for r in plainly(rows, p)}
    assert found(spark, [], p) == [] and found(spark, [(1, None)], p) == []


def test_empty_clusters_stay(spark):
    v = single(np.ones(64))
    rows = [(i, v) for i in range(20)] + [(99, single(-np.ones(64)))]
    p = KMeansParams(k=8, rounds=3)
    assert found(spark, rows, p) == plainly(rows, p)


def test_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, single(v)) for i, v in enumerate(rng.uniform(-100_000, 100_000, (40, 64)))]
    p = KMeansParams(rounds=3)
    assert found(spark, rows, p) == plainly(rows, p)
    with pytest.raises(ValueError):
        found(spark, [(1, [1e6] * 64)], p)
