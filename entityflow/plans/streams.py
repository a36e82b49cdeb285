"""Streaming queries: the test tables are read as file streams, processed to the end and read back."""

from pyspark.sql import functions as F

from entityflow.operators import index as ix
from entityflow.params import TIERS
from entityflow.plans.bindings import Tables
from entityflow.plans.governance import RATE_SQL, TOUCH_SQL
from entityflow.plans.registry import query
from entityflow.sources.storage import scratch
from entityflow.streaming import changes, jobs


class StreamTables(Tables):
    """The same views over file streams."""

    def raw(self, name):
        schema = super().raw(name).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.dir)


def _streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.dir)


_KINDS = ("photo_stored", "photo_done", "card_identified", "batch_complete", "noise")


@query("st_progress", "", f"""
    SELECT user_id AS batch_id, {', '.join(f"count(*) FILTER (event_id % 5 = {i}) AS {k}" for i, k in enumerate(_KINDS[:4]))} FROM events GROUP BY 1""")
def _(t):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 5 + 1).cast("int"))
    card = F.when(F.col("event_id") % 5 == 2, F.col("event_id").cast("string"))
    value = F.to_json(F.struct(F.col("user_id").alias("batch_id"), kind.alias("event"), card.alias("card_id")))
    counters = jobs.progress_stream(_streams(t).raw("events").select(value.alias("value")))
    path = scratch(t.spark, "progress")
    changes.run_available(counters, path, mode="update", stateful=True)
    return changes.read_newest(t.spark, f"{path}/table", counters.schema, ["batch_id"])


@query("st_batch_complete_once", "v_cards", """
    SELECT batch_id, count(*) AS items FROM v_cards GROUP BY batch_id HAVING count(*) FILTER (status = 'pending') = 0""")
def _(t):
    # a third of the items is delivered twice, among them some of batches that lack others
    expected = t.cards.groupBy("batch_id").agg(F.count(F.lit(1)).alias("expected"))
    cards = _streams(t).cards.withColumn("copy", F.explode(F.when(F.col("ordinal") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    items = cards.join(expected, "batch_id").select(
        "batch_id", "expected", F.col("card_id").alias("item_id"), (F.col("status") != "pending").alias("terminal"))
    done = jobs.completion_stream(items)
    path = scratch(t.spark, "completions")
    changes.run_available(done, path, stateful=True)
    return changes.read_changes(t.spark, f"{path}/table", done.schema).select("batch_id", "items")


@query("st_price_upsert", "v_obs", """
    SELECT card_ref_id, finish, cents AS price_cents, source, observed_at FROM v_obs
    QUALIFY row_number() OVER (PARTITION BY card_ref_id, finish ORDER BY observed_at DESC, obs_id DESC) = 1""")
def _(t):
    # two runs of half the observations each: the first ends in a snapshot, the second adds a change behind it
    path, order = scratch(t.spark, "prices"), ["observed_at", "obs_id"]
    schema = jobs.price_changes(t.observations).schema
    stream, early = _streams(t).observations, F.col("card_ref_id") % 2 == 0
    changes.run_available(stream, path, lambda df: jobs.price_changes(df.where(early)), after=lambda log, n: log.compact(t.spark, schema, jobs.KEY, order))
    changes.write_changes(jobs.price_changes(t.observations.where(~early | (F.col("card_ref_id") % 3 == 0))), 1, f"{path}/table")
    book = changes.read_newest(t.spark, f"{path}/table", schema, jobs.KEY, order)
    return book.select("card_ref_id", "finish", "price_cents", "source", "observed_at")


_CORRECTED_SQL = "(SELECT *, card_ref_id % 40 AS actual FROM v_cards WHERE status = 'corrected')"


@query("st_correction_ingest", "v_cards v_bits", f"""
    SELECT 'fingerprint' AS output, actual AS ref_id, t, card_id AS row_id, CAST(bits AS VARCHAR) AS value FROM (
      SELECT actual, t, card_id, created_at, bits FROM {_CORRECTED_SQL} JOIN v_bits ON vec_id = card_ref_id)
    QUALIFY row_number() OVER (PARTITION BY actual, t ORDER BY created_at DESC, card_id DESC) <= 20
    UNION ALL
    SELECT 'log', actual, card_ref_id, card_id, sha256(card_id) FROM {_CORRECTED_SQL} JOIN embeddings ON vec_id = card_ref_id""")
def _(t):
    coef = t.coefficients.select(F.col("vec_id").alias("predicted_ref_id"), "coef")
    corrections = _streams(t).cards.where(F.col("status") == "corrected").select(
        "card_id", F.sha2("card_id", 256).alias("crop_hash"), F.col("card_ref_id").alias("predicted_ref_id"),
        (F.col("card_ref_id") % 40).alias("actual_ref_id"), "created_at",
    ).join(coef, "predicted_ref_id")
    path = scratch(t.spark, "corrections")
    changes.run_available(corrections, path, jobs.correction_changes)
    shapes = {name: df.schema for name, df in jobs.correction_changes(t.spark.createDataFrame([], corrections.schema)).items()}
    log, prints = (changes.read_changes(t.spark, f"{path}/table", shapes[name], name).drop("change") for name in ("log", "fingerprints"))
    tier = F.array_position(F.array(*[F.lit(x) for x in TIERS]), F.col("hash_type")) - 1
    kept = ix.cap_newest(prints, 20).select(
        F.lit("fingerprint").alias("output"), "ref_id", tier.alias("t"), "row_id", F.col("hash_bits").cast("string").alias("value"))
    return kept.unionByName(log.select(
        F.lit("log").alias("output"), F.col("actual_ref_id").alias("ref_id"), F.col("predicted_ref_id").alias("t"),
        F.col("card_id").alias("row_id"), F.col("crop_hash").alias("value")))


@query("st_idempotent_items", "v_requests", """
    SELECT DISTINCT user_id AS photo_id, request_id % 20 AS ordinal FROM v_requests""")
def _(t):
    items = _streams(t).requests.select(F.col("user_id").alias("photo_id"), (F.col("request_id") % 20).alias("ordinal"), "ts")
    unique = jobs.dedupe_items(items, ["photo_id", "ordinal"], "ts", "40 days")
    path = scratch(t.spark, "items")
    changes.run_available(unique, path)
    return changes.read_changes(t.spark, f"{path}/table", unique.schema).select("photo_id", "ordinal")


def _keyed(t: Tables):
    return _streams(t).requests.select(F.col("user_id").alias("key"), "ts", "request_id")


@query("st_rate_limit_stream", "v_requests", RATE_SQL)
def _(t):
    admitted = jobs.rate_limit_stream(_keyed(t))
    path = scratch(t.spark, "rate-limit")
    changes.run_available(admitted, path, stateful=True)
    return changes.read_changes(t.spark, f"{path}/table", admitted.schema).select("request_id", "key", "admitted")


@query("st_session_touch_stream", "v_requests", TOUCH_SQL)
def _(t):
    touched = jobs.session_touch_stream(_keyed(t))
    path = scratch(t.spark, "touch")
    changes.run_available(touched, path, stateful=True)
    return changes.read_changes(t.spark, f"{path}/table", touched.schema).select("request_id", "key", "touched")


@query("st_idle_sessions_stream", "v_requests", """
    SELECT user_id, session_start, session_end, events FROM (
      SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS events FROM (
        SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS s FROM (
          SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, request_id) >= INTERVAL 2 HOUR, true) AS fresh FROM v_requests))
      GROUP BY user_id, s) WHERE session_end <= (SELECT max(ts) FROM v_requests) - INTERVAL 6 HOUR""")
def _(t):
    """Sessions that the watermark, six hours behind the newest event, has passed; later ones stay open."""
    closed = jobs.idle_session_stream(_streams(t).requests.select("user_id", "ts"), "2 hours", "6 hours")
    path = scratch(t.spark, "sessions")
    changes.run_available(closed, path)
    done = changes.read_changes(t.spark, f"{path}/table", closed.schema)
    return done.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "events")
