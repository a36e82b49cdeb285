"""Fingerprint and vector search, text resolution and the decision rule on exact inputs and against brute force."""

import difflib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from entityflow.operators import cascade, cells, knn, radius, resolve
from entityflow.params import TIERS, CascadeParams

LONG = 0x7FFFFFFFFFFFFFFF


def signed(u):
    return u - 2**64 if u >= 2**63 else u


def brute(queries, index):
    out = {}
    for item, tier, bits in queries:
        best = {}
        for ref, t, other in index:
            if t == tier:
                d = bin((bits ^ other) & (2**64 - 1)).count("1")
                best[ref] = min(best.get(ref, 65), d)
        ranked = sorted((d, r) for r, d in best.items())
        first = ranked[0] if ranked else (64, None)
        out[item, tier] = (first[1], first[0], ranked[1][0] if len(ranked) > 1 else 64)
    return out


@pytest.mark.parametrize("grid", [knn.Grid(), knn.Grid(40, 17)])
def test_hamming_knn_is_exact(spark, grid):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]

    def near():
        b = rng.choice(seeds)
        for _ in range(rng.randrange(6)):
            b ^= 1 << rng.randrange(64)
        return signed(b)

    # a third of the index rows are copies of one fingerprint under several owners
    index = [(f"r{rng.randrange(30):02d}", rng.choice(TIERS[:3]), near()) for _ in range(200)]
    index += [(f"r{rng.randrange(30):02d}", "full", signed(seeds[0])) for _ in range(100)]
    index += [("r99", "edge_only", 5)]
    queries = [(i, rng.choice(TIERS[:4]), near() if i % 3 else signed(seeds[0])) for i in range(150)]
    got = knn.hamming_knn(
        spark.createDataFrame(queries, "item_id int, hash_type string, hash_bits bigint"),
        spark.createDataFrame(index, "ref_id string, hash_type string, hash_bits bigint"), grid,
    ).collect()
    want = brute(queries, index)
    assert len(got) == len(queries)
    for r in got:
        assert (r.best_ref, r.best_dist, r.second_dist) == want[r.item_id, r.hash_type]


def hash_match(spark, index, probe):
    rows = [(r, t, signed(b)) for r, b in index for t in TIERS]
    asked = [(1, t, signed(probe)) for t in TIERS]
    return knn.hamming_match(
        spark.createDataFrame(asked, "item_id int, hash_type string, hash_bits bigint"),
        spark.createDataFrame(rows, "ref_id string, hash_type string, hash_bits bigint"),
    ).first()


def test_hamming_match(spark):
    a, b = 0x0F0F0F0F0F0F0F0F, 0xF0F0F0F0F0F0F0F0
    exact = hash_match(spark, [("a", a), ("b", b)], a)
    assert (exact.ref_id, exact.distance, exact.margin, exact.agreement) == ("a", 0, 64, 5)
    assert exact.score == pytest.approx(1.0)
    off = hash_match(spark, [("a", a), ("b", b)], a ^ 0b111)
    assert (off.ref_id, off.distance) == ("a", 3) and off.score == pytest.approx(0.5 * 0.7 + 0.3 + 0.2)
    twins = hash_match(spark, [("a", a), ("b", a)], a)
    assert twins.ref_id is None and twins.score == 0.0 and twins.margin == 0
    lone = hash_match(spark, [("a", a)], a)
    assert lone.ref_id == "a" and lone.margin == 64


def cosine(spark, sims, refs):
    """Points at the given similarity to the query (1, 0)."""
    points = [(i, r, [s, (1 - s * s) ** 0.5]) for i, (s, r) in enumerate(zip(sims, refs))]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "item_id int, vector array<double>")
    return knn.cosine_match(q, spark.createDataFrame(points, "point_id int, ref_id string, vector array<double>")).first()


def test_cosine_match(spark):
    assert cosine(spark, [0.9, 0.8], ["a", "b"]).score == pytest.approx(0.9)
    assert cosine(spark, [0.9, 0.88], ["a", "b"]).score == pytest.approx(0.9 * 0.7)
    same = cosine(spark, [0.9, 0.89, 0.8], ["a", "a", "b"])
    assert same.ref_id == "a" and same.score == pytest.approx(0.9)
    assert cosine(spark, [0.9], ["a"]).score == pytest.approx(0.45)
    # the other owner is looked for among the five nearest points only
    crowd = cosine(spark, [0.9, 0.899, 0.898, 0.897, 0.896, 0.895], ["a"] * 5 + ["b"])
    assert crowd.score == pytest.approx(0.45)


def test_cosine_grid_is_exact(spark):
    rng = random.Random(9)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    points = spark.createDataFrame([(i, i % 40, vec()) for i in range(120)], "point_id int, ref_id int, vector array<double>")
    queries = spark.createDataFrame([(i, vec()) for i in range(50)], "item_id int, vector array<double>")
    whole = sorted(map(tuple, knn.cosine_top(queries, points).collect()))
    cells = sorted(map(tuple, knn.cosine_top(queries, points, p=knn.CellParams(11, 99, 7)).collect()))
    assert whole == cells and len(whole) == 250


def test_best_alternative(spark):
    index = spark.createDataFrame([("a", "full", 0)], "ref_id string, hash_type string, hash_bits bigint")
    alts = spark.createDataFrame([(1, 0, 7), (1, 1, 1), (1, 2, 2), (2, 0, LONG), (2, 3, LONG)], "item_id int, alternative int, hash_bits bigint")
    got = {r.item_id: r.alternative for r in knn.best_alternative(alts, index).collect()}
    assert got == {1: 1, 2: 0}
    none = knn.best_alternative(alts, index.where("false")).collect()
    assert {r.alternative for r in none} == {0}


def decide(spark, *methods):
    rows = [(1, m[0], m[1], float(m[2]), *(m[3:] or (None, None))) for m in methods]
    df = spark.createDataFrame(rows, "item_id int, method string, ref_id string, score double, margin int, agreement int")
    r = cascade.decide(df).first()
    return r.ref_id, r.confidence, r.stage, r.candidates, [m.method for m in r.methods]


def test_decide(spark):
    assert decide(spark, ("h", "x", 0.98, 8, 5)) == ("x", 93, "h", ["x"], ["h"])
    # agreement or margin too small: the hash match alone is not accepted
    assert decide(spark, ("h", "x", 0.9, 4, 5), ("a", "x", 0.8), ("b", None, 0.0))[1:3] == (98, "multi")
    assert decide(spark, ("h", "x", 0.7, 8, 3), ("a", "x", 0.8), ("b", None, 0.0))[:3] == ("x", 98, "multi")
    assert decide(spark, ("h", None, 0.0), ("a", "y", 0.6), ("b", "y", 0.7))[:3] == ("y", 96, "multi")
    open_ = [("h", None, 0.0), ("a", "x", 0.5), ("b", "y", 0.4)]
    assert decide(spark, *open_, ("c", "x", 0.7))[:3] == ("x", 79, "validation")
    assert decide(spark, ("h", None, 0.0), ("a", "x", 0.5), ("b", "y", 0.4), ("c", "x", 0.9667))[:3] == ("x", 81, "llm")
    assert decide(spark, ("h", None, 0.0), ("a", "x", 0.40), ("b", None, 0.0), ("c", None, 0.0))[:3] == (None, 40, "validation")
    assert decide(spark, ("h", None, 0.0), ("a", "x", 0.1), ("b", None, 0.0))[:3] == (None, 10, "unreadable")
    assert decide(spark, ("h", None, 0.0), ("a", "x", 0.9), ("b", "y", 0.95))[1:4] == (60, "validation", ["y", "x"])
    tie = decide(spark, ("h", None, 0.0), ("a", "x", 0.5), ("b", "y", 0.5), ("c", "z", 0.6))
    assert tie[3] == ["z", "x", "y"]


def test_identify_runs_each_stage_on_open_items_only(spark):
    seen = {}

    def matcher(name, rows, schema="item_id int, ref_id string, score double"):
        def run(items):
            seen[name] = sorted(r.item_id for r in items.collect())
            return spark.createDataFrame(rows, schema).join(items.select("item_id"), "item_id", "left_semi")

        return run

    items = spark.createDataFrame([(i, 50.0 if i < 5 else 10.0) for i in range(1, 6)], "item_id int, sharp double")
    h = [(1, "x", 0.98, 8, 5), (2, "x", 0.7, 4, 3), (3, None, 0.0, 0, 0), (4, None, 0.0, 0, 0)]
    out = cascade.identify(items, {
        "h": matcher("h", h, "item_id int, ref_id string, score double, margin int, agreement int"),
        "a": matcher("a", [(i, "x", 0.8) for i in range(1, 5)]),
        "c": matcher("c", [(i, "x" if i == 3 else "q", 0.9) for i in range(1, 5)]),
    }, CascadeParams(), "sharp")
    got = {r.item_id: (r.ref_id, r.confidence, r.stage, [m.method for m in r.methods]) for r in out.collect()}
    assert seen == {"h": [1, 2, 3, 4], "a": [2, 3, 4], "c": [3, 4]}
    assert got[1] == ("x", 93, "h", ["h"]) and got[2] == ("x", 98, "multi", ["h", "a"])
    assert got[3] == ("x", 83, "llm", ["h", "a", "c"]) and got[4] == (None, 60, "validation", ["h", "a", "c"])
    assert got[5] == (None, 0, "unreadable", [])


def test_resolve_against_brute_force(spark):
    rng = random.Random(2)
    names = ["Pikachu", "Pikachu V", "Raichu", "Charizard", "Charmander", "Mew", "Mewtwo", "Snorlax"]
    refs = [(i, rng.choice(names), str(rng.randrange(1, 4)), "10") for i in range(40)] + [(40, "Unique Name", "9", "10"), (41, "Mr. Mime", "9", "11")]
    asked = ["pikachu", "Pikachv V", "Chardizard", "mewtw", "unique name", "mr. mime", "", None, "zzz"]
    numbers = ["1/10", "002 / 010", "3/10", "9/10", "9/99", "SWSH001", None]
    obs = [(i, n, m) for i, (n, m) in enumerate((n, m) for n in asked for m in numbers)]

    def want(name, number):
        if number and "/" in number:
            num, total = (x.strip().lstrip("0") or "0" for x in number.split("/"))
            rows = [r for r in refs if r[2] == num and r[3] == total]
            if len(rows) == 1:
                return rows[0][0], 1.0
            if rows and name:
                scored = [(difflib.SequenceMatcher(None, name.lower(), r[1].lower()).ratio(), -r[0]) for r in rows]
                best = max(scored)
                if best[0] >= 0.75:
                    return -best[1], 0.9
        if name:
            rows = [r for r in refs if r[1].lower() == name.lower()]
            if len(rows) == 1:
                return rows[0][0], 0.6
        return None, 0.0

    got = resolve.resolve(
        spark.createDataFrame(obs, "item_id int, name string, number string"),
        spark.createDataFrame(refs, "id int, name string, number string, printed_total string"),
    ).collect()
    assert {r.item_id: (r.ref_id, r.exactness) for r in got} == {i: want(n, m) for i, n, m in obs}


def test_read_regions(spark):
    lines = [
        (1, "name", 0, "170 HP Porygon2", 0.9), (1, "name", 1, "x", 0.5),
        (1, "text", 0, "SWSH001 12", 0.8), (1, "text", 1, "  ", 0.6), (1, "text", 2, "/", 0.4), (1, "text", 3, "198 rare 3/4", 0.7),
        (2, "text", 0, "SM12", 1.0), (3, "name", 0, " HP ", 0.4),
    ]
    got = {r.item_id: r for r in resolve.read_regions(spark.createDataFrame(lines, "item_id int, band string, pos int, text string, conf double")).collect()}
    assert got[1].name == "Porygon2" and got[1].number == "12/198"
    assert got[1].mean_conf == pytest.approx((0.9 + 0.8 + 0.6 + 0.4 + 0.7) / 5)
    assert got[2].name is None and got[2].number == "SM12" and got[2].mean_conf == 1.0
    assert got[3].name is None and got[3].number is None


def test_hamming_is_symmetric(spark):
    from entityflow.functions.fingerprint import hamming

    rng = random.Random(4)
    pairs = [(signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for _ in range(50)] + [(0, -1), (-(2**63), LONG)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", hamming(F.col("a"), F.col("b")).alias("x"), hamming(F.col("b"), F.col("a")).alias("y"))
    for r in df.collect():
        assert r.x == r.y == bin((r.a ^ r.b) & (2**64 - 1)).count("1")


def band_tables(spark, seed=4, owners=150, asked=150):
    """Owners round a few seeds, some within a radius of a query and some just beyond it."""
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(25)]

    def near(most):
        b = rng.choice(seeds)
        for i in rng.sample(range(64), rng.randrange(most)):
            b ^= 1 << i
        return signed(b)

    index = [(f"r{i % owners:03d}", t, near(9)) for i in range(owners) for t in TIERS] + [("r000", t, signed(seeds[0])) for t in TIERS]
    queries = [(i, t, near(14)) for i in range(asked) for t in TIERS]
    return (spark.createDataFrame(queries, "item_id int, hash_type string, hash_bits bigint"),
            spark.createDataFrame(index, "ref_id string, hash_type string, hash_bits bigint"), queries, index)


@pytest.mark.parametrize("rows", [65_536, 40, 3])
def test_bands_meet_every_row_within_reach(spark, rows):
    from entityflow.operators import radius

    asked, index, queries, held = band_tables(spark)
    bands = radius.Bands(rows=rows)
    got = knn.hamming_knn(asked, index, knn.Grid(bands_from=0), bands).collect()
    want = brute(queries, held)
    assert len(got) == len(queries) and all((r.best_ref, r.best_dist, r.second_dist) == want[r.item_id, r.hash_type] for r in got)
    placed = knn._distinct_rows(knn.load_index(index))
    met = radius.met_owners(asked.select("hash_type", "hash_bits").distinct().withColumn("errors", F.lit(2)), placed, 151, bands)
    best = knn._merge_blocks(met, ["hash_type", "hash_bits"]).collect()
    found = {(r.hash_type, r.hash_bits): (r.ref_id, r.dist) for r in best}
    for i, t, b in queries:
        ref, d, _ = want[i, t]
        assert d > bands.reach or found[t, b] == (ref, d)


def test_bands_compare_few_pairs(spark):
    """Counted pairs of a spread index stay far below queries times rows."""
    from entityflow.operators import radius

    rng = random.Random(8)
    index = spark.createDataFrame([("full", signed(rng.getrandbits(64)), i) for i in range(20_000)], "tier string, bits bigint, ref_id int")
    asked = spark.createDataFrame([("full", signed(rng.getrandbits(64)), e) for e in (0, 1, 2) for _ in range(200)], "hash_type string, hash_bits bigint, errors int")
    met = radius.met_owners(asked, index, 20_000, radius.Bands(rows=2_000))
    per = {r.errors: r.n for r in asked.join(met, ["hash_type", "hash_bits"]).groupBy("errors").agg(F.sum("compared").alias("n")).collect()}
    pairs = 200 * 20_000
    assert per.get(0, 0) < pairs / 5_000 and per[1] < pairs / 500 and per[2] < pairs / 80


@pytest.mark.parametrize("bands_from", [0, 10**9])
def test_match_equals_the_vote_over_all_tiers(spark, bands_from):
    asked, index, queries, held = band_tables(spark, seed=12, owners=60)
    want, got = brute(queries, held), knn.hamming_match(asked, index, grid=knn.Grid(bands_from=bands_from)).collect()
    assert len(got) == 150 and any(r.ref_id for r in got) and not all(r.ref_id for r in got)
    for r in got:
        ref, d, second = want[r.item_id, "full"]
        agree = sum(want[r.item_id, t][0] == ref and want[r.item_id, t][1] <= 10 for t in TIERS)
        ok = agree >= 3 and d <= 10 and second - d >= 4
        assert (r.distance, r.margin, r.agreement, r.ref_id) == (d, second - d, agree, ref if ok else None)


def test_best_alternative_is_the_nearest_of_all(spark):
    asked, index, queries, held = band_tables(spark, seed=20)
    full = [(i // 4, i % 4, b) for i, t, b in queries if t == "full"]
    alts = spark.createDataFrame(full, "item_id int, alternative int, hash_bits bigint")
    bits = [b for _, t, b in held if t == "full"]
    want = {}
    for i, a, b in full:
        d = min(bin((b ^ o) & (2**64 - 1)).count("1") for o in bits)
        want[i] = min(want.get(i, (99, 0)), (d, a))
    assert {r.item_id: (r.distance, r.alternative) for r in knn.best_alternative(alts, index).collect()} == want


@pytest.mark.parametrize("block", [32_768, 40])
def test_cells_are_exact_and_few_are_visited(spark, block):
    import numpy as np

    from entityflow.operators import cells

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    place = rng.integers(0, 20, 2000)
    x = centres[place] + rng.normal(size=(2000, 16)) / 20
    x[5], x[6], x[7] = 0, x[8], x[8]
    q = np.concatenate([x[:40] + rng.normal(size=(40, 16)) / 30, np.zeros((1, 16)), -x[:2]])
    points = spark.createDataFrame([(i, i % 300, v.tolist()) for i, v in enumerate(x)] + [(9999, 1, None)], "point_id int, ref_id int, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "item_id int, vector array<double>")
    got, visited = cells.top(asked, points, 5, cells.CellParams(20, 99, block))
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = np.round(unit(q) @ unit(x).T, 12)
    want = {(i, n + 1, int(j)) for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(2000), -sims[i]))[:5])}
    assert {(r.item_id, r.rn, r.point_id) for r in got.collect()} == want
    near = visited.where("item_id < 40").count() / 40
    assert near < 25  # of 99 cells


def test_cells_without_points(spark):
    empty = spark.createDataFrame([], "point_id int, ref_id int, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "item_id int, vector array<double>")
    assert knn.cosine_top(asked, empty).count() == 0
    assert [tuple(r) for r in knn.cosine_match(asked, empty).collect()] == [(1, None, 0.0)]


def test_cached_answers_and_orientation_in_the_cascade(spark):
    refs = spark.createDataFrame([(1, "Red Fox", "4", "50"), (2, "Blue Owl", "4", "60"), (3, "Red Fox", "5", "50")],
                                 "id long, name string, number string, printed_total string")
    items = spark.createDataFrame([(i, f"k{i}", 50.0) for i in range(7)], "item_id long, content_key string, sharpness double")
    cache = spark.createDataFrame([
        ("k0", 'Sure: {"name": "RED FOX", "number": "4/50", "confidence": 80} done'), ("k1", '{"name": "blue owl", "confidence": "50"}'),
        ("k2", "no idea"), ("k3", '{"name": "Red Fox", "number": null, "confidence": 90}'), ("k4", '{"number": "5/50", "confidence": "high"}'),
        ("k5", '{"name": ')], "content_key string, response string")
    votes, missing = cascade.cached_votes(items, cache, refs)
    got = {r.item_id: (r.ref_id, round(r.score, 9)) for r in votes.collect()}
    assert got == {0: (1, 0.8), 1: (2, 0.3), 2: (None, 0.0), 3: (None, 0.0), 4: (3, 0.0), 5: (None, 0.0)}
    assert [r.item_id for r in missing.collect()] == [6]

    seen = []

    def by_hash(rows):
        seen.append("rotation" in rows.columns)
        zero = F.lit(0).cast("int")
        return rows.select("item_id", F.lit(1).cast("long").alias("ref_id"), F.lit(0.4).alias("score"), zero.alias("margin"), zero.alias("agreement"))

    poor = items.withColumn("sharpness", F.when(F.col("item_id") == 6, 0.0).otherwise(F.col("sharpness")))
    turns = spark.createDataFrame([(0, 90), (2, 270), (6, 180)], "item_id long, rotation int")
    done = cascade.identify(poor, {"h": by_hash, "c": lambda rows: cascade.cached_votes(rows, cache, refs)[0]}, quality="sharpness",
                            orient=lambda rows: turns.join(rows.select("item_id"), "item_id"))
    out = {r.item_id: (r.stage, r.confidence, r.rotation) for r in done.collect()}
    assert seen == [True] and out[0] == ("validation", 79, 90) and out[6] == ("unreadable", 0, 0)
    assert out[2][2] == 270 and out[1][2] == 0 and len(out) == 7


def test_cells_stay_bounded_on_large_tables():
    """Fine bounds hold on small tables; beyond a number of cells a slot, the cells grow and not their number."""
    fine = knn.Grid(1000, 150)
    assert fine.chunks(2_500, 500, 8) == (3, 4)
    n_q, n_i = fine.chunks(400_000, 200_000, 8)
    assert n_q * n_i <= 1.1 * knn._CELLS * 8 and 400_000 / n_q <= 131_072 and 200_000 / n_i <= 65_536
    assert knn.Grid().chunks(4_000_000, 20_000_000, 8) == (31, 306)  # the bounds of memory hold whatever the number


def test_top_candidates_move_once(spark):
    rows = [(f"i{i}", m, i % 7 + (m == "b"), 0.5 + (m == "c") / 4, None, None) for i in range(50) for m in "habc"] + [(None, "h", None, 0.1, None, None), (None, "a", 3, 0.2, None, None)]
    methods = spark.createDataFrame(rows, "item_id string, method string, ref_id bigint, score double, margin int, agreement int")
    got = cascade.top_candidates(methods)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {("i0", 0, 0.75, 1), ("i0", 1, 0.5, 2), (None, 3, 0.2, 1)}
    assert {tuple(r) for r in got.collect() if r.item_id in ("i0", None)} == want


def test_tiles_of_the_kernels_are_small():
    """What a worker holds of the pairs of one cell is a tile, whatever the cell's size."""
    from entityflow.operators import cells, radius

    assert radius._PAIRS <= 500_000 and cells._SIMS <= 500_000


def test_nearest_kernel_sorts_few_points_of_a_tile(monkeypatch):
    """Ties, equal points, more wanted than a tile has and vectors that are no numbers: as by sorting all. Only points that can
    be among the nearest are rounded and sorted; all were before."""
    rng = np.random.default_rng(3)
    asked = rng.integers(-2, 3, (70, 4)).astype(float)
    held = rng.integers(-2, 3, (900, 4)).astype(float)
    seen, best = [], cells._best
    monkeypatch.setattr(cells, "_WIDE", 128)
    monkeypatch.setattr(cells, "_TOPS", 8)
    monkeypatch.setattr(cells, "_best", lambda r, c, s, take: (seen.append(len(r)), best(r, c, s, take))[1])
    for vectors, k in ((held, 5), (held[:130], 5), (held[:3], 5), (np.where(held == 2, np.nan, held), 5), (rng.normal(size=(900, 4)), 1)):
        seen.clear()
        got = cells._nearest(k)(
            pa.table({"item_id": np.arange(70), "vector": pa.array(asked.tolist(), pa.list_(pa.float64()))}),
            pa.table({"point_id": np.arange(len(vectors)), "ref_id": np.arange(len(vectors)), "vector": pa.array(vectors.tolist(), pa.list_(pa.float64()))}))
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)
        sims = np.round(unit(asked) @ unit(vectors).T, 12)
        if np.isfinite(vectors).all():
            order = np.lexsort((np.broadcast_to(np.arange(len(vectors)), sims.shape), -sims), axis=1)[:, :k]
            assert got.column("point_id").to_pylist() == order.ravel().tolist()
            assert got.column("sim").to_pylist() == np.take_along_axis(sims, order, 1).ravel().tolist()
    assert max(seen) < 0.2 * 70 * 128


def test_hamming_kernel_and_bands_against_all_pairs():
    """Owners with several rows, equal distances, one owner alone; sorting packed numbers gives what sorting three keys does."""
    rng = np.random.default_rng(4)
    bits, owner = rng.integers(0, 64, 300), rng.integers(0, 40, 300)
    asked = np.arange(64)
    for some in (np.ones(300, bool), owner == 7):
        got = knn._hamming_cell(
            pa.table({"hash_type": ["full"] * 64, "hash_bits": asked}),
            pa.table({"tier": ["full"] * int(some.sum()), "bits": bits[some], "ref_id": owner[some]})).to_pylist()
        for r in got:
            near = sorted({o: min(int(b ^ r["hash_bits"]).bit_count() for b, x in zip(bits[some], owner[some]) if x == o) for o in set(owner[some])}.items(), key=lambda x: (x[1], x[0]))
            assert (r["ref_id"], r["dist"]) == near[0]
            assert (r["second_ref"], r["second_dist"]) == (near[1] if len(near) > 1 else (None, 64))
    row, near = rng.integers(0, 50, 4000), rng.integers(0, 65, 4000).astype(np.uint8)
    who = rng.integers(0, 30, 4000)
    order = np.lexsort((who, near, row))
    for scale in (1, 1 << 55):  # packed, and beyond the bits of one number
        found = radius._ordered(row, who * scale, near)
        assert all((a == b[order]).all() for a, b in zip(found, (row, who * scale, near)))
