"""Prices, variants, collections, reviews, quotas, gates, files and streams on exact inputs."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from entityflow.functions.ranking import first_n, running_total
from entityflow.operators import collection, evaluate, gates, index, layout, prices, quotas, reviews
from entityflow.params import AuthParams, HashParams, QuotaParams
from entityflow.sources import blocklist, catalog, reports, storage
from entityflow.streaming import changes, jobs

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def book(spark, rows):
    return spark.createDataFrame(
        [(r, f, c, "s", at(h)) for r, f, c, h in rows],
        "card_ref_id string, finish string, price_cents int, source string, fetched_at timestamp_ntz",
    )


def test_fresh_prices_keep_known_misses(spark):
    b = book(spark, [("a", "normal", 100, 1), ("b", "normal", None, 1), ("c", "normal", 5, 0)])
    keys = spark.createDataFrame([(x, "normal") for x in "abcd"], "card_ref_id string, finish string")
    got = {r.card_ref_id: (r.fresh, r.price_cents) for r in prices.fresh_prices(b, keys, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), 24).collect()}
    # exactly as old as the limit is stale
    assert got == {"a": (True, 100), "b": (True, None), "c": (False, None), "d": (False, None)}


def test_resolve_prices(spark):
    obs = [
        ("a", "x", "unavailable", None), ("a", "y", "ok", 950), ("b", "x", "ok", None), ("b", "y", "ok", 5),
        ("c", "x", "unavailable", None), ("d", "z", "ok", 1),
    ]
    df = spark.createDataFrame(
        [(r, "normal", s, st, c, T0, str(i)) for i, (r, s, st, c) in enumerate(obs)],
        "card_ref_id string, finish string, source string, obs_status string, cents int, observed_at timestamp_ntz, obs_id string",
    )
    done, retry = prices.resolve_prices(df, ["x", "y"])
    assert {r.card_ref_id: (r.price_cents, r.source) for r in done.collect()} == {"a": (950, "y"), "b": (None, "x")}
    assert [r.card_ref_id for r in retry.collect()] == ["c"]


SPREADS = [
    (["normal", "holofoil"], {"normal": 1000, "holofoil": 1100}, "normal"),
    (["normal", "holofoil"], {"normal": 1000, "holofoil": 1250}, None),
    (["normal", "holofoil"], {"normal": 1000, "holofoil": 1150}, "normal"),
    (["normal", "holofoil"], {"normal": 1000, "holofoil": None}, None),
    (["normal", "holofoil"], {"normal": 1000}, None),
    (["normal", "holofoil"], {"normal": 0, "holofoil": 0}, None),
    (["reverseHolofoil", "holofoil"], {"reverseHolofoil": 10, "holofoil": 10, "normal": 900}, "holofoil"),
    (["1stEdition"], {"1stEdition": 10}, None),
]


def test_variant_narrow(spark):
    refs = spark.createDataFrame([(str(i), f) for i, (f, _, _) in enumerate(SPREADS)], "id string, finishes array<string>")
    b = book(spark, [(str(i), f, c, 1) for i, (_, p, _) in enumerate(SPREADS) for f, c in p.items()])
    rows = [(f"{i}", str(i), None, "validation", True, "multi") for i in range(len(SPREADS))]
    rows += [("flag", "0", None, "validation", False, "multi"), ("stage", "0", None, "validation", True, "validation"), ("done", "0", "holofoil", "validated", True, "h")]
    cards = spark.createDataFrame(rows, "card_id string, card_ref_id string, finish string, status string, finish_needs_confirmation boolean, accepted_stage string")
    got = {r.card_id: (r.finish, r.status, r.finish_needs_confirmation) for r in prices.variant_narrow(cards, refs, b, 15.0).collect()}
    for i, (_, _, chosen) in enumerate(SPREADS):
        assert got[str(i)] == ((chosen, "auto", False) if chosen else (None, "validation", True)), i
    assert got["flag"] == (None, "validation", False) and got["stage"][1] == "validation" and got["done"] == ("holofoil", "validated", True)


def test_upsert_is_idempotent(spark):
    b = book(spark, [("a", "normal", 1, 0), ("b", "normal", 2, 0)])
    new = book(spark, [("a", "normal", None, 5), ("c", "normal", 3, 5)])
    once = prices.upsert_prices(b, new)
    assert sorted(once.collect()) == sorted(prices.upsert_prices(once, new).collect())
    assert {r.card_ref_id: r.price_cents for r in once.collect()} == {"a": None, "b": 2, "c": 3}


def star(spark, rows):
    return spark.createDataFrame(
        [(str(i), n, "S", "1", "normal", q, c, "s", T0, 90, 1, "auto", 7, c is not None) for i, (n, q, c) in enumerate(rows)],
        "card_id string, name string, set_name string, number string, finish string, quantity int, price_cents int, price_source string, "
        "price_fetched_at timestamp_ntz, confidence int, batch_id bigint, status string, user_id bigint, has_price_row boolean",
    )


def test_stats_and_pages(spark):
    df = star(spark, [("A", 2, 100), ("B", 1, None), ("C", 1, 500), ("D", 3, 10)])
    s = collection.collection_stats(df).first()
    assert (s.total_cards, s.total_value_cents, s.priced_fraction) == (7, 730, 0.75)
    empty = collection.collection_stats(df.where("false")).first()
    assert (empty.total_cards, empty.total_value_cents, empty.priced_fraction, empty.oldest_price_at) == (0, 0, 0.0, None)
    assert [(r.name, r.has_next) for r in collection.page(df, "value_desc", 1, 2).collect()] == [("C", True), ("A", True)]
    assert [(r.name, r.has_next) for r in collection.page(df, "nope", 2, 3).collect()] == [("B", False)]
    refs = spark.createDataFrame([(1, "Red", "S", "5"), (2, "redo", "S", "7"), (3, "blue", "S", "re")], "id int, name string, set_name string, number string")
    assert [r.id for r in collection.search_refs(refs, "RE").collect()] == [1, 2]
    assert [r.id for r in collection.search_refs(refs, "re").collect()] == [1, 3, 2]
    assert collection.search_refs(refs, "  ").count() == 0


def test_csv_is_rfc4180(spark, tmp_path):
    df = star(spark, [('A, "x"', 2, 1234), ("B", 1, None)])
    path = str(tmp_path / "csv")
    reports.write_collection_csv(df.coalesce(1), path)
    parts = [p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*.csv"))]
    lines = [x for p in parts for x in p.split("\r\n") if x]
    assert lines[0] == ",".join(reports.CSV_COLUMNS)
    body = sorted(x for x in lines if x != lines[0])
    assert body[0] == '"A, ""x""",S,1,normal,2,$12.34,s,2024-01-01T00:00:00.000Z,90,1,0.webp'
    assert body[1] == "B,S,1,normal,1,,s,2024-01-01T00:00:00.000Z,90,1,1.webp"
    assert len(reports.read_collection_csv(spark, path).collect()) == 2


CARD = "card_id string, batch_id bigint, card_ref_id string, finish string, quantity int, status string, created_at timestamp_ntz, finish_needs_confirmation boolean"


def test_reviews_and_merges(spark):
    cards = spark.createDataFrame([
        ("a", 1, "x", None, 1, "auto", at(1), False), ("b", 1, "x", None, 1, "validation", at(0), True),
        ("c", 1, "y", None, 1, "validation", at(2), True), ("d", 1, None, None, 1, "validation", at(3), True),
        ("e", 2, "x", None, 1, "auto", at(0), False), ("f", 1, "x", "normal", 1, "auto", at(0), False),
    ], CARD)
    rev = spark.createDataFrame([
        ("b", "x", None, at(10)), ("c", "y", "normal", at(11)), ("d", "y", "normal", at(12)),
    ], "card_id string, chosen_ref string, chosen_finish string, reviewed_at timestamp_ntz")
    out, log = reviews.apply_reviews(cards, rev)
    got = {r.card_id: (r.card_ref_id, r.finish, r.status, r.quantity, r.finish_needs_confirmation) for r in out.collect()}
    assert got["a"] == ("x", None, "auto", 2, False)          # gained b, though b is older
    assert got["b"] == ("x", None, "merged", 0, True)
    assert got["c"] == ("y", "normal", "validated", 2, False)  # the first reviewed keeps the row
    assert got["d"] == ("y", "normal", "merged", 0, False)
    assert got["e"][3] == 1 and got["f"][3] == 1
    assert {r.card_id: (r.predicted_ref_id, r.actual_ref_id) for r in log.collect()} == {"b": ("x", "x"), "c": ("y", "y"), "d": (None, "y")}
    total = lambda df: df.agg(F.sum("quantity")).first()[0]
    assert total(out) == total(cards) and total(reviews.merge_duplicates(cards)) == total(cards)


def test_cap_newest(spark):
    rows = [("r", "full", s, at(i), f"{s}{i}") for s in ("reference", "user_validated") for i in range(5)]
    df = spark.createDataFrame(rows, "ref_id string, hash_type string, source string, created_at timestamp_ntz, row_id string")
    kept = {r.row_id for r in index.cap_newest(df, 2).collect()}
    assert kept == {f"reference{i}" for i in range(5)} | {"user_validated3", "user_validated4"}


def test_stored_index_is_refreshed_by_owner(spark, tmp_path, monkeypatch):
    """The same rows after one run, two runs, and a run that failed behind the staged copy."""
    shape = "ref_id string, source string, hash_type string, hash_bits bigint"
    rows = [(r, s, "full", i) for i, (r, s) in enumerate((r, s) for r in "abcdef" for s in ("reference", "augmented", "user_validated"))]
    new = [("a", "reference", "full", 100), ("a", "reference", "edge", 101), ("x", "augmented", "full", 102)]
    path, held = str(tmp_path / "index"), spark.createDataFrame(rows, shape)
    index.create_index(held, path, 2)
    want = sorted([r for r in rows if r[0] != "a" or r[1] == "user_validated"] + new)

    def read():
        return sorted(map(tuple, index.read_index(spark, path, held.schema).collect()))

    assert read() == sorted(rows)
    real = index.materialise

    def failing(df, name, *a):
        real(df, name, *a)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(index, "materialise", failing)
        with pytest.raises(RuntimeError):
            index.write_refresh(path, spark.createDataFrame(new, shape), 2)
    assert read() == sorted(rows)
    for _ in range(2):
        index.write_refresh(path, spark.createDataFrame(new, shape), 2)
        assert read() == want
    # an owner that has lost all rows of a source, in buckets of its own
    index.create_index(held, path + "2", 64)
    index.write_refresh(path + "2", spark.createDataFrame(new[2:] + [("a", "reference", "full", 7)], shape), 64)
    got = sorted(map(tuple, index.read_index(spark, path + "2", held.schema).collect()))
    assert got == sorted([r for r in rows if r[0] != "a" or r[1] == "user_validated"] + [new[2], ("a", "reference", "full", 7)])


def test_redelivered_photos_are_charged_once(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, at(1), 1, "p", 6), (1, day, at(2), 2, "p", 6), (1, day, at(3), 3, "q", 6), (1, day, at(4), 4, "old", 9), (1, day, at(5), 5, None, 3), (1, day, at(6), 6, None, 3)]
    df = spark.createDataFrame(rows, "user_id bigint, day date, ts timestamp_ntz, request_id bigint, photo_id string, want int")
    stored = spark.createDataFrame([("old",), (None,)], "photo_id string")
    got = {r.request_id: (r.exempt, r.granted, r.want) for r in quotas.charge_deliveries(df, stored, 10).collect()}
    assert got == {1: (False, 6, 6), 2: (True, 6, 6), 3: (False, 4, 6), 4: (True, 9, 9), 5: (False, 0, 3), 6: (False, 0, 3)}


def test_transitions_follow_guards(spark):
    ledger = spark.createDataFrame([(k, "queued", T0, None) for k in "abc"], "key string, status string, since timestamp_ntz, detail string")
    events = spark.createDataFrame([
        ("a", at(1), 1, "ready", "early"), ("a", at(2), 2, "claim", None), ("a", at(3), 3, "claim", "again"), ("a", at(4), 4, "ready", "file"), ("a", at(5), 5, "fail", "late"),
        ("b", at(1), 6, "claim", None),
    ], "key string, ts timestamp_ntz, event_id bigint, event string, detail string")
    got = {r.key: (r.status, r.since, r.detail) for r in reviews.apply_transitions(ledger, events, reviews.EXPORT_EVENTS, ["detail"]).collect()}
    assert got == {"a": ("ready", at(4), "file"), "b": ("rendering", at(1), None), "c": ("queued", T0, None)}
    with pytest.raises(ValueError):
        reviews.apply_transitions(ledger, events, {"x": (("a",), "b"), "y": (("b",), "a")})


def test_events_need_no_status(spark):
    ledger = spark.createDataFrame([(k, "failed", T0, "old") for k in "abc"], "key string, status string, since timestamp_ntz, detail string")
    events = spark.createDataFrame([
        ("a", at(1), 1, "claim", None), ("a", at(2), 2, "ready", "file"), ("a", at(3), 3, "fail", None), ("b", at(1), 4, "unknown", "x"),
    ], "key string, ts timestamp_ntz, event_id bigint, event string, detail string")
    got = {r.key: (r.status, r.since, r.detail) for r in reviews.apply_events(ledger, events, reviews.EXPORT_EVENTS, ["detail"]).collect()}
    assert got == {"a": ("failed", at(3), "file"), "b": ("failed", T0, "old"), "c": ("failed", T0, "old")}
    items = spark.createDataFrame([("a", "auto", T0)], "key string, status string, since timestamp_ntz")
    skip = spark.createDataFrame([("a", at(1), 1, "skip")], "key string, ts timestamp_ntz, event_id bigint, event string")
    assert reviews.apply_events(items, skip, reviews.ITEM_EVENTS).first().status == "skipped"


def test_each_review_gives_a_correction(spark):
    cards = spark.createDataFrame([("c", "b", "r1", None, 1, "validation", T0, True)], "card_id string, batch_id string, card_ref_id string, finish string, quantity int, status string, created_at timestamp_ntz, finish_needs_confirmation boolean")
    given = spark.createDataFrame([("c", "r2", "foil", at(1)), ("c", "r2", None, at(2))], "card_id string, chosen_ref string, chosen_finish string, reviewed_at timestamp_ntz")
    out, log = reviews.apply_reviews(cards, given)
    assert [(r.predicted_ref_id, r.actual_ref_id) for r in log.orderBy("reviewed_at").collect()] == [("r1", "r2"), ("r2", "r2")]
    assert [(r.card_ref_id, r.status, r.finish) for r in out.collect()] == [("r2", "validated", "foil")]


def test_evaluation_of_nothing(spark):
    manifest = spark.createDataFrame([], "file string, pos int, scenario string, finish string, expected string")
    idents = spark.createDataFrame([], "file string, pos int, ref_id string, stage string")
    _, summary, verdict = evaluate.evaluate(manifest, idents, 0.0)
    assert [(r.split, r.total, r.auto_accept_rate) for r in summary.collect()] == [("all", 0, 0.0)]
    assert verdict.first().passed


def test_evaluation(spark):
    manifest = spark.createDataFrame([("f", i, "flat", None, "x") for i in range(5)], "file string, pos int, scenario string, finish string, expected string")
    idents = spark.createDataFrame(
        [("f", 0, "x", "h"), ("f", 1, "y", "multi"), ("f", 2, "x", "validation"), ("f", 3, None, "unreadable")], "file string, pos int, ref_id string, stage string"
    )
    rows, summary, verdict = evaluate.evaluate(manifest, idents, 0.5)
    assert [r.outcome for r in rows.orderBy("pos").collect()] == [
        "auto_accepted_correct", "auto_accepted_WRONG", "sent_to_validation", "unreadable", "missed_detection"]
    whole = summary.where("split = 'all'").first()
    assert (whole.total, whole.wrong, whole.auto_accept_rate, whole.hash_tier_hit_rate) == (5, 1, 0.4, 0.2)
    assert tuple(verdict.first())[:2] == (False, "wrong auto-accept")
    clean = evaluate.evaluate(manifest, idents.where("pos <> 1"), 0.2)[2].first()
    assert clean.passed
    assert evaluate.evaluate(manifest, idents.where("pos <> 1"), 0.22)[2].first().reason == "auto-accept rate below baseline"


def ask(spark, rows):
    return spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), at(i / 60), i, *r) for i, r in enumerate(rows)],
        "user_id bigint, day date, ts timestamp_ntz, request_id bigint, batches int, photos int, fetches int",
    )


def test_quota_admit_against_a_plain_walk(spark):
    caps = QuotaParams(batches_per_day=5, photos_per_day=20, fetches_per_day=6)
    rng = random.Random(7)
    for strict in (False, True):
        wants = [(rng.randrange(3), rng.choice([0, 1, 4, 9, 30]), rng.randrange(3)) for _ in range(120)]
        used, want_out = [0, 0, 0], []
        limit = (5, 20, 6)
        for i, w in enumerate(wants):
            bad = next((n for n, u, x, c in zip(quotas.DIMENSIONS, used, w, limit) if u + x > c), None)
            if i == 0 and not strict:
                bad = None
            if bad is None:
                used = [u + x for u, x in zip(used, w)]
            want_out.append(bad)
        got = quotas.quota_admit(ask(spark, wants), caps, strict).orderBy("request_id").collect()
        assert [r.reason for r in got] == want_out


def test_quota_lists_no_wants_over_a_cap_and_judges_null_keys(spark):
    caps = QuotaParams(batches_per_day=5, photos_per_day=20, fetches_per_day=6)
    # 3,000 different wants over the cap behind an opener over the cap, for a NULL user
    rows = spark.range(3001).select(
        F.lit(None).cast("int").alias("user_id"), F.lit(None).cast("date").alias("day"),
        F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        F.col("id").alias("request_id"), F.lit(0).alias("batches"), (F.col("id") + 21).cast("int").alias("photos"), F.lit(0).alias("fetches"))
    last = rows.where("request_id = 3000").withColumn("request_id", F.lit(4000).cast("bigint")).withColumn("photos", F.lit(0))
    got = quotas.quota_admit(rows.unionByName(last), caps)
    assert got.count() == 3002
    assert [r.request_id for r in got.where("admitted").collect()] == [0]
    strict = quotas.quota_admit(rows.unionByName(last), caps, strict_first=True)
    assert [r.request_id for r in strict.where("admitted").collect()] == [4000]


def test_fanout_of_batches_over_several_days(spark):
    caps = QuotaParams(photos_per_batch=10, photos_per_day=2, fetches_per_day=50)
    kinds = "user_id int, day date, ts timestamp_ntz, request_id int, batch_id int, offered int, in_batch int, used_photos int, used_fetches int"

    def grants(rows, caps):
        rows = [(u, at(h).date(), at(h), i, b, n, 0, 0, 0) for i, (u, h, b, n) in enumerate(rows)]
        return [r.granted for r in quotas.fanout(spark.createDataFrame(rows, kinds), caps).orderBy("request_id").collect()]

    # the first day gives 2 of 10, so the second still has room for its 2
    assert grants([(1, 20, 1, 10), (1, 30, 1, 5)], caps) == [2, 2]
    rng = random.Random(5)
    caps = QuotaParams(photos_per_batch=9, photos_per_day=7, fetches_per_day=8)
    rows = [(rng.randrange(3), h, 0, rng.randint(1, 6)) for h in sorted(rng.sample(range(24 * 6), 60))]
    rows = [(u, h, u * 10 + rng.randrange(4), n) for u, h, _, n in rows]
    batch, day, wanted = {}, {}, []
    for u, h, b, n in rows:
        got = max(0, min(n, 9 - batch.get(b, 0), 7 - day.get((u, h // 24), 0)))
        batch[b], day[u, h // 24] = batch.get(b, 0) + got, day.get((u, h // 24), 0) + got
        wanted.append(got)
    assert grants(rows, caps) == wanted


def test_clamp_and_running_total(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), at(i), i, w) for i, w in enumerate([4, 5, 6, 2])],
        "user_id bigint, day date, ts timestamp_ntz, request_id bigint, want int",
    )
    assert [r.granted for r in quotas.clamp_grants(df, 10).orderBy("request_id").collect()] == [4, 5, 1, 0]
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, rng.randrange(10)) for i in range(500)]
    many = spark.createDataFrame(rows, "k int, i int, v int")
    total = running_total(many, ["k"], ["i"], F.col("v"), "c").orderBy("i").collect()
    acc = {}
    for (k, _, v), r in zip(rows, total):
        acc[k] = acc.get(k, 0) + v
        assert r.c == acc[k]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_running_total_of_a_hot_key_over_many_parts(spark, batch):
    rng = random.Random(4)
    rows = [(None if i % 11 == 0 else rng.choice("aaaaaaab"), rng.choice([None, 1]), i, None if i % 17 == 0 else rng.randrange(-3, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, day int, i int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = running_total(df.repartition(3), ["k", "day"], ["i"], F.col("v"), "c").withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    acc, want = {}, {}
    for k, day, i, v in rows:
        acc[k, day] = acc.get((k, day), 0) + (v or 0)
        want[i] = acc[k, day]
    assert {r.i: r.c for r in got} == want and len(got) == 3000
    assert len({r.p for r in got if r.k == "a" and r.day == 1}) > 2
    assert running_total(df.where("false"), ["k"], ["i"], F.col("v"), "c").count() == 0


def test_first_n_with_a_large_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    got = first_n(df, ["k"], [F.desc("id")], 1500).groupBy("k").agg(F.count("id").alias("n"), F.min("id").alias("low")).orderBy("k").collect()
    assert [(r.n, r.low) for r in got] == [(1500, 2000), (1500, 2001)]


def plain_limit(times):
    kept, out = [], []
    for t in times:
        ok = sum(t - x < quotas.HOUR for x in kept) < 3 and sum(t - x < quotas.DAY for x in kept) < 10
        out.append(ok)
        if ok:
            kept.append(t)
    return out


def test_rate_limit_against_a_plain_walk(spark):
    rng = random.Random(11)
    seconds = sorted(rng.randrange(3 * 86400) for _ in range(600)) + [3 * 86400] * 5
    rows = [(1, T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "key bigint, ts timestamp_ntz, request_id bigint")
    got = quotas.rate_limit(df, "key", AuthParams()).orderBy("request_id").collect()
    assert [r.admitted for r in got] == plain_limit([s * 1_000_000 for s in seconds])


def test_scan_state_survives_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_rate_limit_against_a_plain_walk(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_url_gate(spark):
    urls = {
        "https://i.imgur.com/a.jpg": (None, "imgur"), "https://I.IMGUR.com/a.jpg": (None, "imgur"), "https://i.redd.it/a": (None, "reddit"),
        "https://imgur.com/": ("album/gallery URL requires a path", None), "http://i.imgur.com/a": ("https only", None),
        "https://imgur.com@evil.com/a": ("userinfo not allowed", None), "https://imgur.com.evil.io/": ("host not allowed: imgur.com.evil.io", None),
        "https://evil-imgur.com/": ("host not allowed: evil-imgur.com", None), "https://evil.com/?x=i.imgur.com": ("host not allowed: evil.com", None),
        "nope": ("not a valid URL", None), "https://a b": ("not a valid URL", None),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: (r.reason, r.source_type) for r in gates.gate_urls(df).collect()} == urls
    req = spark.createDataFrame([(1, " a\n b "), (2, "  "), (3, " ".join("abcdefghijk"))], "request_id int, text string")
    whole = gates.admit_url_requests(spark.createDataFrame(
        [(1, " https://i.imgur.com/a.jpg\n https://www.reddit.com/comments/b "), (2, "https://i.imgur.com/a.jpg http://i.redd.it/x https://evil.io/"),
         (3, " \n"), (4, None), (5, "https://i.imgur.com/a " * 10), (6, "https://i.imgur.com/a " * 11)], "request_id int, text string"))
    assert {r.request_id: (r.reason, r.source_types) for r in whole.collect()} == {
        1: (None, ["imgur", "reddit"]), 2: ("https only", None), 3: ("no urls supplied", None), 4: ("no urls supplied", None),
        5: (None, ["imgur"] * 10), 6: ("too many urls (max 10)", None)}
    ok, refused = gates.split_url_requests(req)
    assert [(r.request_id, r.url) for r in ok.orderBy("pos").collect()] == [(1, "a"), (1, "b")]
    assert sorted(r.request_id for r in refused.collect()) == [2, 3]


def test_payload_contract(spark):
    cases = [
        ("detect", '{"photo_id": "p"}', None), ("detect", "{}", "missing key photo_id"), ("detect", '{"photo_id": 1}', "photo_id must be a string"),
        ("detect", '{"photo_id": "p", "x": 1}', "unexpected key"), ("nope", "{}", "unknown type nope"), ("detect", "[]", "payload must be an object"),
        ("detect", "{", "payload must be an object"), ("ingest_correction", '{"card_id": "c", "actual_ref_id": "a", "predicted_ref_id": null}', None),
        ("ingest_correction", '{"card_id": "c", "actual_ref_id": "a"}', "missing key predicted_ref_id"),
        ("ingest_correction", '{"card_id": "c", "actual_ref_id": null, "predicted_ref_id": "x"}', "actual_ref_id must be a string"),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, type string, payload string")
    ok, bad = gates.validate_payload(df)
    got = {r.i: r.reason for r in bad.collect()} | {r.i: None for r in ok.collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_blobs_and_blocklist(spark):
    blobs = spark.createDataFrame([
        (0, bytearray(b"\xff\xd8\xff\xe0")), (1, bytearray(b"\x89PNG\r\n\x1a\n")), (2, bytearray(b"\x00\x00\x00\x18ftypheic")), (3, bytearray(b"\x00\x00\x00\x18ftypavif")), (4, bytearray(b"\xff\xd8")),
    ], "i int, content binary")
    from entityflow.params import GateParams

    assert [r.format for r in gates.sniff_blobs(blobs).orderBy("i").collect()] == ["jpeg", "png", "heif", None, None]
    assert [r.reason for r in gates.sniff_blobs(blobs, GateParams(accept_heif=False, max_photo_bytes=9)).orderBy("i").collect()] == [
        None, None, "file too large", "file too large", "unsupported format"]
    lines = spark.createDataFrame([("# c",), ("",), (" A.com ",), ("b.org",)], "value string")
    domains = blocklist.parse_blocklist(lines)
    emails = spark.createDataFrame([(e,) for e in ("x@a.com", "x@s.a.com", "x@nota.com", "x", "x@com")], "email string")
    assert {r.email: r.disposable for r in gates.flag_disposable(emails, domains).collect()} == {
        "x@a.com": True, "x@s.a.com": True, "x@nota.com": False, "x": False, "x@com": False}


def test_catalog_page(spark, tmp_path):
    (tmp_path / "p1.json").write_text("""{"data": [
        {"id": "b-4", "name": "X", "number": "4", "rarity": "Rare", "images": {"small": "s", "large": "l"},
         "set": {"id": "b", "name": "Base", "printedTotal": 102}, "tcgplayer": {"prices": {"normal": {"market": 1.5}, "holofoil": {"market": null}}}},
        {"id": "b-5", "name": "Y", "number": "5", "images": {"large": "m"}, "set": {"id": "b", "name": "Base"}}], "page": 1}""")
    rows = [tuple(r) for r in catalog.flatten_catalog(catalog.read_pages(spark, str(tmp_path))).orderBy("id").collect()]
    assert rows == [
        ("b-4", "X", "b", "Base", "4", "102", "Rare", "l", ["holofoil", "normal"]),
        ("b-5", "Y", "b", "Base", "5", None, None, "m", []),
    ]


def test_manifest_and_run(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"photos": [{"file": "f", "cards": [{"card_ref_id": "x", "finish": "normal"}, {"card_ref_id": "y"}]}]}')
    rows = [tuple(r) for r in reports.read_manifest(spark, str(tmp_path / "m.json")).orderBy("pos").collect()]
    assert rows == [("f", "unknown", 0, "x", "normal"), ("f", "unknown", 1, "y", "unknown")]
    manifest = reports.read_manifest(spark, str(tmp_path / "m.json"))
    good = spark.createDataFrame([("f", 0, "x", "h")], "file string, pos int, ref_id string, stage string")
    for name, idents, written in (("good", good, True), ("bad", good.withColumn("ref_id", F.lit("q")), False)):
        scored = evaluate.score_items(manifest, idents)
        assert reports.write_run(scored, evaluate.metrics(scored), str(tmp_path / name), str(tmp_path / f"{name}-base")) is written
        assert (tmp_path / f"{name}-base").exists() is written


def test_outlines(spark):
    rows = [("p", 0, 0.0, 0.0), ("p", 1, 10.0, 0.0), ("p", 2, 20.0, 0.0), ("p", 3, 200.0, 5.0), ("q", 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "photo_id string, position int, x0 double, y0 double")
    x, y = F.col("x0"), F.col("y0")
    quads = df.select("photo_id", "position", x, y, *[v.alias(n) for n, v in {"x1": x + 60, "y1": y, "x2": x + 60, "y2": y + 84, "x3": x, "y3": y + 84}.items()])
    kept = layout.drop_near(layout.union_passes(quads, quads))
    # 18 is the least distance of kept centres: the outline at 20 is near the dropped one only
    assert sorted((r.photo_id, r.x0) for r in kept.collect()) == [("p", 0.0), ("p", 20.0), ("p", 200.0), ("q", 0.0)]
    ordered = layout.reading_order(kept.withColumn("height", F.lit(1000.0)), 2).collect()
    assert sorted((r.photo_id, r.ordinal, r.x0) for r in ordered) == [("p", 0, 0.0), ("p", 1, 20.0), ("q", 0, 0.0)]


def test_blob_keys(spark):
    df = spark.createDataFrame([("u/b/p.webp",), ("u/b/crops/c.webp",), ("x",)], "key string")
    assert [tuple(r)[1:] for r in storage.parse_blob_key(df).collect()] == [("u", "b", "photo", "p"), ("u", "b", "crop", "c"), (None,) * 4]


def run_files(spark, tmp_path, df, parts, build, **kw):
    """Feed ``df`` as several files, one per micro-batch, and return the written changes."""
    src = tmp_path / "src"
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.parquet(str(src / f"{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(str(src))
    out = build(stream)
    changes.run_available(out, str(tmp_path / "out"), **kw)
    return changes.read_changes(spark, str(tmp_path / "out" / "table"), out.schema)


def test_completion_fires_once(spark, tmp_path):
    """A redelivered item counts once, in one micro-batch and over several; a complete batch stays silent."""
    rows = [(1, 2, "a", True, 0), (1, 2, "b", True, 1), (2, 2, "a", True, 0), (2, 2, "b", False, 1), (1, 2, "a", True, 2), (1, 2, "c", True, 2),
            (2, 2, "a", True, 1), (2, 2, "a", True, 2), (3, 2, "x", True, 0), (3, 2, "x", True, 0), (4, 1, "y", True, 2), (4, 1, "y", True, 2)]
    df = spark.createDataFrame(rows, "batch_id bigint, expected bigint, item_id string, terminal boolean, part int")
    got = run_files(spark, tmp_path, df, [f"part = {i}" for i in range(3)], lambda s: jobs.completion_stream(s.drop("part")), stateful=True)
    assert sorted((r.batch_id, r.items, r.change) for r in got.collect()) == [(1, 2, 1), (4, 1, 2)]


def test_completion_works_by_the_bucket(spark, tmp_path):
    """Batches share state keys; large batches, late deliveries and rows without a batch keep their own counts."""
    kinds = "batch_id bigint, expected bigint, item_id string, terminal boolean, part int"
    rows = [(b, 2, f"i{k}", True, k) for b in range(3000) for k in range(2)] + [(None, 2, f"n{k}", True, k) for k in range(2)]
    rows += [(-5, 700, f"big{i}", True, i % 3) for i in range(700)] + [(-5, 700, f"big{i}", True, 1) for i in range(50)]
    rows += [(b, 2, "i9", True, 2) for b in range(100)] + [(9000, 1, None, None, 0), (9000, 1, None, True, 2)]
    df = spark.createDataFrame(rows, kinds)
    stream = jobs.completion_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path)).drop("part"))
    assert "bucket" in stream._jdf.queryExecution().analyzed().toString()
    got = run_files(spark, tmp_path, df, [f"part = {i}" for i in range(3)], lambda s: jobs.completion_stream(s.drop("part")), stateful=True)
    want = [(b, 2, 1) for b in range(3000)] + [(None, 2, 1), (-5, 700, 2), (9000, 1, 2)]
    assert sorted((r.batch_id is None, r.batch_id or 0, r.items, r.change) for r in got.collect()) == sorted((b is None, b or 0, n, c) for b, n, c in want)


def test_forgotten_batches_leave_no_state(spark, tmp_path):
    """With a time to live of a moment, an item delivered before is unknown to the next run."""
    from entityflow.params import StateParams

    items = spark.createDataFrame([(1, 2, "a", True)], "batch_id bigint, expected bigint, item_id string, terminal boolean")
    for hours, want in ((0.0001, 0), (1, 1)):
        src, out = tmp_path / f"src{want}", str(tmp_path / f"out{want}")
        for i, item in enumerate("ab"):
            items.withColumn("item_id", F.lit(item)).write.mode("append").parquet(str(src))
            stream = spark.readStream.schema(items.schema).parquet(str(src))
            done = jobs.completion_stream(stream, StateParams(idle_hours=hours, fired_hours=hours))
            changes.run_available(done, out, stateful=True)
            time.sleep(1)
        assert changes.read_changes(spark, f"{out}/table", done.schema).count() == want


def test_outputs_of_a_micro_batch_appear_together(spark, tmp_path, monkeypatch):
    df, log = spark.createDataFrame([(1, 10)], "k int, v int"), changes.ChangeLog(str(tmp_path / "t"), every=4)
    log.write(0, {"a": df, "b": df})

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(changes.ChangeLog, "_commit", killed)
        with pytest.raises(RuntimeError):
            log.write(1, {"a": df, "b": df})
    assert [log.changes(spark, df.schema, x).count() for x in "ab"] == [1, 1]
    log.write(1, {"a": df.withColumn("v", F.lit(20)), "b": df})
    log.write(1, {"a": df.withColumn("v", F.lit(99)), "b": df})  # committed: left alone
    assert [tuple(r) for r in log.newest(spark, df.schema, ["k"], output="a").collect()] == [(1, 20)]
    assert log.changes(spark, df.schema, "b").count() == 2


def test_snapshots_bound_what_is_read(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([(1, 10)], "k int, v int").schema
    log, want = changes.ChangeLog(str(tmp_path / "t"), every=3), {}
    for n in range(11):
        rows = [(n % 4, n), (100 + n, n)]
        want.update(rows)
        log.write(n, {changes.ROWS: spark.createDataFrame(rows, schema)})
        if n == 4:
            with monkeypatch.context() as m:  # stopped between the snapshot and its commit
                m.setattr(changes.ChangeLog, "_commit", lambda *_: None)
                log.compact(spark, schema, ["k"])
        if n % 3 == 2:
            log.compact(spark, schema, ["k"])
        assert len(log.version(spark).changes) <= 2 + (n % 3 != 2)
        assert dict(map(tuple, log.newest(spark, schema, ["k"]).collect())) == want
    assert log.version(spark).upto == 8 and log.version(spark).changes == (9, 10)
    assert log.changes(spark, schema, "other").count() == 0


def test_rate_limit_stream_carries_state(spark, tmp_path):
    seconds = list(range(0, 86400, 600))
    rows = [(1, T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "key bigint, ts timestamp_ntz, request_id bigint")
    got = run_files(spark, tmp_path, df, ["request_id < 50", "request_id between 50 and 99", "request_id > 99"], jobs.rate_limit_stream, stateful=True)
    assert [r.admitted for r in got.orderBy("request_id").collect()] == plain_limit([s * 1_000_000 for s in seconds])


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 10)], "k int, v int")
    for _ in range(2):
        changes.write_changes(df, 0, str(tmp_path / "t"))
    changes.write_changes(df.withColumn("v", F.lit(20)), 1, str(tmp_path / "t"))
    assert changes.read_changes(spark, str(tmp_path / "t"), df.schema).count() == 2
    assert [tuple(r) for r in changes.read_newest(spark, str(tmp_path / "t"), df.schema, ["k"]).collect()] == [(1, 20)]


def test_asset_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in {"x-1.png": b"123", "a/y.2.png": b"", "z.txt": b"1"}.items():
        (tmp_path / name).write_bytes(body)
    listing = storage.list_assets(spark, str(tmp_path))
    assert sorted(map(tuple, listing.where("length > 0").collect())) == [("x-1", 3)]
    refs = spark.createDataFrame([("x-1",), ("y.2",), ("q",)], "id string")
    kept, skipped = catalog.with_assets(refs, listing)
    assert [r.id for r in kept.collect()] == ["x-1"] and sorted(r.id for r in skipped.collect()) == ["q", "y.2"]


def test_filters_from_text():
    f = collection.CollectionFilters.parse({"batch": "", "set": "S", "finish": "", "source": "odd"})
    assert f == collection.CollectionFilters(set_id="S")
    assert collection.CollectionFilters.parse({"source": "auto"}).source == "auto"


def test_constraints(spark):
    from entityflow.operators.constraints import violations
    from entityflow.schemas import TABLES

    prices_table = TABLES["prices"]
    df = spark.createDataFrame([
        ("a", "normal", 1, "s", T0), ("a", "normal", None, "s", T0), ("b", "holofoil", 1, None, T0), ("c", None, 1, "s", T0),
    ], prices_table.schema)
    parents = {"card_refs": spark.createDataFrame([("a",), ("b",)], "id string")}
    assert sorted((r.rule, r.value or "", r.rows) for r in violations(df, prices_table, parents).collect()) == [
        ("reference card_ref_id", "c", 1), ("required finish", "", 1), ("required source", "", 1), ("unique card_ref_id,finish", "a/normal", 2)]
    for table in TABLES.values():
        assert set(table.key) <= set(table.schema.names)


def test_grid_uses_slots_and_respects_bounds():
    from entityflow.operators.knn import Grid

    assert Grid(100, 50, 10).chunks(1000, 120, 4) == (10, 3)
    assert Grid(100, 50, 10).chunks(90, 10, 8) == (8, 1)
    assert Grid(100, 50, 10).chunks(5, 10, 8) == (1, 1)
    assert Grid(100, 50, 10).chunks(0, 0, 8) == (1, 1)


def test_albums_and_web_payloads(spark):
    urls = {"https://imgur.com/a/1": True, "https://imgur.com/gallery/x": True, "https://i.imgur.com/a/1": False, "https://www.reddit.com/r/x/comments/1": True, "zzz": False}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.a for r in df.select("url", gates.is_album(F.col("url")).alias("a")).collect()} == urls
    jobs_df = spark.createDataFrame([("export", '{"export_id": "e"}'), ("price", '{"card_ref_id": "r", "finish": "f"}')], "type string, payload string")
    ok, bad = gates.validate_payload(jobs_df, gates.WEB_PAYLOAD_KEYS)
    assert [r.type for r in ok.collect()] == ["export"] and [r.type for r in bad.collect()] == ["price"]


def test_outlines_beyond_the_looped_ones_are_kept_apart(spark):
    """More kept outlines than are compared as plain numbers, over several Arrow batches and photos."""
    from entityflow.operators import layout

    def quad(photo, at, x, y):
        return (photo, 0, at, x, y, x + 60.0, y, x + 60.0, y + 84.0, x, y + 84.0)

    rows = [quad(p, 2 * i + k, 100.0 * (i % 20) + k, 100.0 * (i // 20)) for p in (1, 2) for i in range(200) for k in (0, 1)] + [quad(None, 0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "photo_id long, pass int, position int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = sorted((r.photo_id or 0, r.position) for r in layout.drop_near(df.coalesce(1)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(0, 0)] + [(p, 2 * i) for p in (1, 2) for i in range(200)]


def test_only_newest_corrections_need_coefficients(spark):
    corrections = spark.createDataFrame(
        [("c0", 1, 2, at(0)), ("c1", 1, 2, at(1)), ("c1", 1, 2, at(2)), ("c2", 1, 2, at(3)), ("c9", 1, 2, at(9))],
        "card_id string, predicted_ref_id bigint, actual_ref_id bigint, reviewed_at timestamp_ntz")
    # the crop of c0 cannot give coefficients, that of c3 no hash, and c9 has no crop
    k = F.col("card_id")
    crops = spark.createDataFrame([(c,) for c in ("c0", "c1", "c2", "c3")], "card_id string").select(
        k, F.when(k == "c3", F.raise_error(F.lit("hash"))).otherwise(F.concat(k, F.lit("#"))).alias("crop_hash"),
        F.when(k == "c0", F.raise_error(F.lit("coefficients"))).otherwise(F.array(*[F.lit(float(i * 7 % 64)) for i in range(64)])).alias("coef"))
    empty = spark.createDataFrame([], "ref_id bigint, source string, created_at timestamp_ntz, row_id string, hash_type string, hash_bits bigint")
    log, kept = reviews.correction_rows(corrections, crops, empty, HashParams(user_validated_cap=2))
    assert sorted((r.card_id, r.crop_hash) for r in log.collect()) == [("c0", "c0#"), ("c1", "c1#"), ("c1", "c1#"), ("c2", "c2#")]
    assert {(r.row_id, r.created_at) for r in kept.collect()} == {("c2", at(3)), ("c1", at(2))} and kept.count() == 10


def test_metrics_score_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kinds = "file string, pos int, scenario string, finish string, expected int, got int, accepted_stage string, outcome string"
    rows = spark.createDataFrame([
        ("f", 0, "s", "x", 1, 1, "h", "auto_accepted_correct"), ("f", 1, "s", "y", 1, 2, "llm", "auto_accepted_WRONG"),
        ("g", 0, "t", "y", 1, None, None, "missed_detection")], kinds)
    got = {(r.split, r.value): tuple(r)[2:] for r in evaluate.metrics(rows.mapInArrow(count, kinds)).collect()}
    assert seen.value == 3
    assert got["all", "all"] == (3, 2, 1, 0.6667, 0.3333) and got["scenario", "s"] == (2, 2, 1, 1.0, 0.5)
    assert got["finish", "y"] == (2, 1, 1, 0.5, 0.0) and got["stage", "none"] == (1, 0, 0, 0.0, 0.0) and len(got) == 8


def test_reviews_read_their_items_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    # b is there twice and goes with both rows; the one of another batch and the item without a name stay as they are
    rows = [("a", 1, "x", None, 1, "auto", at(1), False), ("b", 1, "x", None, 1, "validation", at(0), True), ("b", 1, "x", None, 3, "validation", at(0), True),
            ("b", 2, "x", None, 1, "validation", at(0), True), (None, 1, "x", None, 1, "auto", at(9), False), ("c", 1, "y", "foil", 1, "auto", at(0), False)]
    cards = spark.createDataFrame(rows, CARD).mapInArrow(count, CARD)
    given = spark.createDataFrame([("b", "x", None, at(5)), ("c", "z", None, at(1)), ("c", "y", None, None)], "card_id string, chosen_ref string, chosen_finish string, reviewed_at timestamp_ntz")
    out, log = reviews.apply_reviews(cards, given)
    got = sorted((r.card_id or "", r.batch_id, r.card_ref_id, r.status, r.quantity) for r in out.collect())
    assert got == [("", 1, "x", "auto", 1), ("a", 1, "x", "auto", 3), ("b", 1, "x", "merged", 0), ("b", 1, "x", "merged", 0),
                   ("b", 2, "x", "validated", 1), ("c", 1, "z", "corrected", 1)]
    assert sorted(r.card_id for r in log.collect()) == ["b", "b", "b", "c", "c"]
    assert seen.value == len(rows)


def test_reports_are_compressed(spark, tmp_path, monkeypatch):
    from entityflow.plans import QUERIES

    made = []
    monkeypatch.setattr(storage, "scratch", lambda _spark, name: made.append(str(tmp_path / name)) or made[-1])
    for query in ("sink_scan_json", "sink_eval_run"):
        assert QUERIES[query](spark, "/root/testdata/sf0.001").count()
    parts = [p for d in ("scan-report", "eval-run/rows") for p in (tmp_path / d).glob("part-*")]
    assert parts and all(p.name.endswith(".json.gz") for p in parts)


def test_scan_report_sends_refs_to_the_names(spark):
    """Names reach all items of their ref, twice where a ref comes twice, also without a file; items are not dealt by ref."""
    idents = spark.createDataFrame(
        [("p1", 0, 7, 90, "h", [("h", 7, 0.5)], [7]), ("p1", 1, None, 10, "unreadable", [], []), ("p2", 0, 8, 80, "multi", [("h", 8, 0.5)], [8, 7]),
         ("p2", 1, 7, 81, "multi", [("a", 7, 0.25)], [7]), ("p3", 0, 99, 50, "validation", [], [99]), (None, 0, 7, 60, "validation", [], [])],
        "file string, crop_index int, ref_id long, confidence int, stage string, methods array<struct<method:string,ref_id:long,score:double>>, candidates array<long>")
    refs = spark.createDataFrame([(7, "seven"), (8, "eight"), (8, "eight"), (9, "nine"), (None, "none")], "id long, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        report = reports.scan_report(idents, refs)
        rows, found = report.collect(), [report._jdf.queryExecution().executedPlan().initialPlan()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r.file: [(c.crop_index, c.card_ref_id, c.name, c.confidence, c.accepted_stage, len(c.methods), c.candidates) for c in r.cards] for r in rows}
    assert got == {
        "p1": [(0, 7, "seven", 90, "h", 1, [7]), (1, None, None, 10, "unreadable", 0, [])],
        "p2": [(0, 8, "eight", 80, "multi", 1, [8, 7])] * 2 + [(1, 7, "seven", 81, "multi", 1, [7])],
        "p3": [(0, 99, None, 50, "validation", 0, [99])], None: [(0, 7, "seven", 60, "validation", 0, [])]}
    assert len(rows) == 4
    dealt = []
    while found:
        node = found.pop()
        if "Exchange" in node.nodeName():
            dealt.append((node.outputPartitioning().toString(), node.output().mkString(",")))
        found += [node.children().apply(i) for i in range(node.children().length())]
    by_ref = [of for by, of in dealt if "hashpartitioning(file" not in by and "hashpartitioning(_file" not in by and "coalesce(" not in by]
    assert by_ref and not any("methods" in of for of in by_ref)
