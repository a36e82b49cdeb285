"""Near copies against all pairs."""

import itertools
import random

import pytest
from helpers import DOCS, awkward, nothing
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from entityflow.llm import near


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_kept(rows):
    """The smallest id of each component of pairs with similarity >= 0.8."""
    sets, root = {i: brute_shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(i for i in root if find(i) == i)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def planted(seed):
    """Groups of edited copies around the threshold, chains, texts that share a passage, and short texts."""
    rng, texts = random.Random(seed), []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            texts.append(edited(rng, rng.choice(texts[-3:]) if g % 3 == 0 else base, rng.randrange(1, max(2, len(base) // 25))))
    passage = [f"p{i}" for i in range(55)]
    texts += [[*passage, *[f"w{rng.randrange(5000)}" for _ in range(40)]] for _ in range(10)]
    texts += [[], ["a"], ["A"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "f"]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_all_pairs(spark, rounds):
    rows = planted(5)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    got = near.one_of_each(docs, p=near.NearParams(rounds=rounds))
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_stage_takes_near_copies_beyond_four_bits(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 5) if i else base)) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == brute_kept(rows)


def test_awkward_tables(spark):
    docs = awkward(spark)
    got = near.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == 5 and set(kept) == {1, 3, 4, 7, None}
    assert near.one_of_each(nothing(spark)).count() == 0


def test_large_buckets_are_split(spark):
    """Many copies of one text that are alike to it and not to one another, beside texts that share most words."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, 14))) for i in range(1, 60)]
    common = [f"c{i}" for i in range(300)]
    rows += [(i, " ".join([*edited(rng, common, 25), *[f"u{rng.randrange(10**9)}" for _ in range(20)]])) for i in range(100, 160)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    got = near.one_of_each(docs, p=near.NearParams(rounds=1, few=3))
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_pairs_that_no_leader_is_part_of_are_found(spark):
    """A large bucket of texts that are all unlike one another, but for pairs that never lead."""
    rng = random.Random(3)
    common, rows = [f"c{i}" for i in range(300)], []
    for i in range(60):
        text = [*edited(rng, common, 9), *[f"u{rng.randrange(10**9)}" for _ in range(30)]]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(edited(rng, text, 2)))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    # one MinHash value makes buckets of nearly all; splitting them by many values finds nothing
    got = near.one_of_each(docs, p=near.NearParams(rows=1, bands=4, few=2, parts=1, deep=40))
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_a_late_common_shingle_makes_no_pair(spark):
    # of 100 shingles each, 89 have to be common: the first of them is the 12th at the latest
    rows = [(1, 10, 100, 10, 12), (1, 11, 100, 11, 12), (2, 20, 100, 20, 13), (2, 21, 100, 21, 12), (3, 30, 80, 30, 1), (3, 31, 100, 31, 21), (4, 40, 1, 40, 1), (4, 41, 1, 41, 1)]
    first = spark.createDataFrame(rows, "token bigint, s bigint, n int, root bigint, at int")
    assert sorted((r.a, r.b) for r in near._maybe_alike(first, near.NearParams()).collect()) == [(10, 11), (30, 31), (40, 41)]


@pytest.mark.parametrize("few", [2, 8])
def test_copied_against_all_pairs(spark, few):
    """Texts with an equal set or another at the similarity, without components; only those asked for are told."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    rows = planted(8) + [(1000 + i, " ".join(edited(rng, base, 9))) for i in range(25)]
    rows += [(2000, rows[0][1].upper())]
    sets, p = {i: brute_shingles(t) for i, t in rows}, near.NearParams(few=few)
    alike = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    expected = {i for i, x in sets.items() if i % 3 and any(alike(x, y) for j, y in sets.items() if i != j)}
    texts = spark.createDataFrame([(i, i, -i, t.encode()) for i, t in rows], "id bigint, h1 bigint, h2 bigint, text binary")
    docs = near.hashed(texts, p).withColumn("asked", F.col("id") % 3 != 0).localCheckpoint()
    got = near.copied(docs, texts.select("h1", "h2", "text"), p).collect()
    assert sorted(r.id for r in got) == sorted(expected) and len(expected) > 20


def test_large_buckets_give_a_member_few_pairs(spark):
    """Sets that share many large buckets, each led by others, make few pairs a set, not few a bucket; small ones keep all."""
    rng = random.Random(2)
    rows = [(s, 10, rng.randrange(1000), b) for b in range(30) for s in rng.sample(range(100, 200), 40)]
    rows += [(s, 10, 1, 100 + b) for b in range(5) for s in (1, 2 + b)]
    now = spark.createDataFrame([(*r, r[0], 40 if r[3] < 100 else 2) for r in rows], "s bigint, n bigint, score bigint, bucket bigint, root bigint, size bigint")
    links, pairs = near._Links(None, near.NearParams()), []
    links.compare = lambda found: pairs.extend((r.a, r.b) for r in found.collect())
    links.lead(now, 4)
    assert {p for p in pairs if p[0] < 100} == {(1, 2 + b) for b in range(5)}
    assert 0 < len([p for p in pairs if p[0] >= 100]) <= 4 * 100


@pytest.mark.parametrize("weights", [1, 1 << 18])
def test_first_shingles_join_no_whole_sets(spark, weights):
    """Sets find their first shingles by themselves: all shingles of all sets were rows of a join before. No pair is lost,
    even where the order says nothing."""
    rng = random.Random(7)
    common = [rng.getrandbits(60) for _ in range(40)]
    texts = [[*common, *[rng.getrandbits(60) for _ in range(k % 9)]] for k in range(30)] + [[rng.getrandbits(60) for _ in range(50)] for _ in range(10)]
    sets = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate([*texts, []])], "s bigint, found array<bigint>")
    asked = sets.select("s", (F.col("s") / 2).cast("long").alias("root"))
    p = near.NearParams(weights=weights)
    first = near._first_shingles(asked, sets, p)
    assert "LeftOuter" not in first._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.a, r.b) for r in near._maybe_alike(first, p).collect()}
    alike = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if a // 2 != b // 2
             and len(set(texts[a]) & set(texts[b])) >= 0.8 * len(set(texts[a]) | set(texts[b]))}
    assert len(alike) > 100 and alike <= got
    rows = first.collect()
    per_set = {r.s: (r.n, sum(x.s == r.s for x in rows)) for r in rows}
    assert all(k <= n - int(0.8 * n) + 1 for n, k in per_set.values()) and not any(s >= 30 for s in per_set)


def test_pairs_that_meet_in_no_bucket_are_found(spark):
    """Pairs at 0.8 that share no bucket, alone, beside one another's common passage, and as the only link of two groups."""
    def words(k, n=9):
        return [f"a{k}b{i}" for i in range(n)]

    p, by = near.NearParams(), near._constants(150, 2)
    for k in (35449, 269289):
        x, y = (near.band_keys(near.minima(near.shingles(" ".join(w).encode(), 5, {}), by), p) for w in (words(k), words(k)[:8]))
        assert not (x == y).any()
    rows = [(1, words(35449)), (2, words(35449)[:8]), (3, words(269289)[:8]), (4, words(269289)), (5, words(269289)), (6, words(7, 60)), (7, words(8, 60))]
    rows = [(i, " ".join(w)) for i, w in rows] + [(8, None), (9, ""), (10, "a")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == brute_kept(rows) == [1, 3, 6, 7, 8, 10]


@pytest.mark.parametrize("weights", [1, 1 << 18])
def test_no_pair_needs_a_bucket(spark, weights):
    """Buckets of 40 MinHash values hold nearly no pair below 1: all pairs are found without them, in any order of shingles."""
    rows = planted(11)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).repartition(5)
    got = near.one_of_each(docs, p=near.NearParams(rows=40, bands=2, weights=weights))
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)
