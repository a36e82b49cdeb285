"""Fingerprints and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward, nothing
from pyspark.sql import functions as F

from entityflow.llm import graph, simhash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(list(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


@pytest.mark.parametrize("text", [None, "", " ", "A", "B c d", "B c d e", "Ünï CÖDE\x0bx\x1cy z\u00a0q w", "a b c d " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair(radius):
    made = simhash.masks(list(range(64)), radius)
    assert len(made) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(20_000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(diff & m == 0 for m in made)


def clusters(rng, n):
    fps = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(base)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                base ^= 1 << b  # chains longer than the radius
    return sorted(set(fps))


@pytest.mark.parametrize("bucket", [1 << 16, 3])  # 3: nearly every shared bucket is masked a second time
def test_components_are_those_of_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "_BUCKET", bucket)
    fps = clusters(random.Random(5), 60)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.near_links(df, 4)
    assert links.where("bit_count(a ^ b) > 4").count() >= 0
    roots = {r.node % 2**64: r.root for r in graph.components(links).collect()}
    want, groups, found = brute_components(fps, 4), {}, {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
        found.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_forest_of_a_dense_bucket():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**10, 900).astype(np.uint64))
    a, _ = simhash.forest(fps, 4)
    assert len(a) == len(fps) - 1


def test_documents(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs, F.col("text"), doc_id=F.col("doc_id")).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.fp % 2**64 == brute_fingerprint(texts[r.doc_id])
    by_id = {r.doc_id: r.component for r in got if r.doc_id is not None}
    assert by_id[1] == by_id[2] == by_id[6] == 1 and by_id[4] == by_id[5] == 4 and by_id[3] == 3
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, i) for i in (1, 3, 4, 7)]
    assert simhash.one_of_each(nothing(spark)).count() == 0
    assert simhash.near_duplicates(nothing(spark), F.col("text"), doc_id=F.col("doc_id")).count() == 0
