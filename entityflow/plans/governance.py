"""Review, evaluation and quota queries over the bound tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from entityflow.operators import cascade, evaluate, quotas, reviews
from entityflow.params import AuthParams, QuotaParams
from entityflow.plans.bindings import Tables
from entityflow.plans.matching import decide_sql
from entityflow.plans.registry import query

# entities modulo 3 so that a batch holds duplicates
_DUP_SQL = """(SELECT * REPLACE (card_ref_id % 3 AS card_ref_id), ordinal % 2 = 0 AS finish_needs_confirmation FROM v_cards)"""


def dup_cards(t: Tables):
    return t.cards.withColumn("card_ref_id", F.col("card_ref_id") % 3).select(
        "card_id", "batch_id", "card_ref_id", "finish", "quantity", "status", "created_at", "ordinal",
        (F.col("ordinal") % 2 == 0).alias("finish_needs_confirmation"),
    )


@query("join_null_safe_dup", "v_cards", f"""
    SELECT c.card_id, arg_min(d.card_id, (d.created_at, d.card_id)) AS target_id
    FROM {_DUP_SQL} c JOIN {_DUP_SQL} d ON d.batch_id = c.batch_id AND d.card_ref_id = c.card_ref_id AND d.finish IS NOT DISTINCT FROM c.finish
      AND d.card_id <> c.card_id AND d.status IN ('auto', 'validated', 'corrected') GROUP BY 1""")
def _(t):
    return reviews.dup_candidates(dup_cards(t))


@query("win_dup_merge", "v_cards", f"""
    SELECT card_id, CASE WHEN res AND rn = 1 THEN quantity + n - 1 WHEN res THEN 0 ELSE quantity END AS quantity,
           CASE WHEN res AND rn > 1 THEN 'merged' ELSE status END AS status
    FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY res, batch_id, card_ref_id, finish) AS n
          FROM (SELECT *, status IN ('auto', 'validated', 'corrected') AS res FROM {_DUP_SQL})
          WINDOW w AS (PARTITION BY res, batch_id, card_ref_id, finish ORDER BY created_at, card_id))""", types={"quantity": "INTEGER"})
def _(t):
    return reviews.merge_duplicates(dup_cards(t)).select("card_id", "quantity", "status")


_REVIEWS_SQL = """(SELECT card_id, CASE WHEN confidence % 3 = 0 THEN (card_ref_id + 1) % 3 ELSE card_ref_id % 3 END AS chosen_ref,
    CASE WHEN confidence % 2 = 0 THEN 'normal' END AS chosen_finish, created_at + to_days(confidence) AS reviewed_at
    FROM v_cards WHERE status = 'validation')"""


def _reviews(t: Tables):
    c = F.col("confidence")
    return t.cards.where(F.col("status") == "validation").select(
        "card_id", F.when(c % 3 == 0, (F.col("card_ref_id") + 1) % 3).otherwise(F.col("card_ref_id") % 3).alias("chosen_ref"),
        F.when(c % 2 == 0, "normal").alias("chosen_finish"),
        (F.col("created_at") + F.make_dt_interval(days=c)).alias("reviewed_at"),
    )


@query("apply_reviews", "v_cards", f"""
    WITH upd AS (
      SELECT c.card_id, c.batch_id, c.created_at, c.quantity, r.reviewed_at, r.card_id IS NOT NULL AS seen, c.card_ref_id AS predicted,
             coalesce(r.chosen_ref, c.card_ref_id) AS ref, coalesce(r.chosen_finish, c.finish) AS finish,
             CASE WHEN r.card_id IS NULL THEN c.status WHEN r.chosen_ref = c.card_ref_id THEN 'validated' ELSE 'corrected' END AS status,
             c.finish_needs_confirmation AND NOT (r.chosen_finish IS NOT NULL) AS flag
      FROM {_DUP_SQL} c LEFT JOIN {_REVIEWS_SQL} r ON r.card_id = c.card_id),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY res, batch_id, ref, finish ORDER BY seen, CASE WHEN seen THEN reviewed_at ELSE created_at END, card_id) AS rn,
             count(*) FILTER (seen) OVER (PARTITION BY res, batch_id, ref, finish) AS n_seen,
             bool_and(seen) OVER (PARTITION BY res, batch_id, ref, finish) AS all_seen
      FROM (SELECT *, status IN ('auto', 'validated', 'corrected') AS res FROM upd))
    SELECT card_id, ref AS card_ref_id, finish, flag AS finish_needs_confirmation,
           CASE WHEN res AND rn = 1 THEN quantity + n_seen - CASE WHEN all_seen THEN 1 ELSE 0 END WHEN res AND seen THEN 0 ELSE quantity END AS quantity,
           CASE WHEN res AND rn > 1 AND seen THEN 'merged' ELSE status END AS status,
           CASE WHEN seen THEN coalesce(CAST(predicted AS VARCHAR), '') || '>' || ref END AS correction
    FROM ranked""", types={"quantity": "INTEGER"})
def _(t):
    cards, corrections = reviews.apply_reviews(dup_cards(t), _reviews(t))
    text = F.concat_ws(">", F.coalesce(F.col("predicted_ref_id").cast("string"), F.lit("")), F.col("actual_ref_id").cast("string"))
    logged = corrections.select("card_id", text.alias("correction"))
    return cards.join(logged, "card_id", "left").select(
        "card_id", "card_ref_id", "finish", "finish_needs_confirmation", "quantity", "status", "correction"
    )


@query("correction_rows", "v_cards v_tier_coef v_bits", f"""
    WITH c AS (SELECT card_id, card_ref_id % 3 AS predicted, CASE WHEN confidence % 3 = 0 THEN (card_ref_id + 1) % 3 ELSE card_ref_id % 3 END AS actual,
                      created_at + to_days(confidence) AS w, card_ref_id % (SELECT count(*) FROM embeddings) AS vec_id
               FROM v_cards WHERE status = 'validation')
    SELECT 'log' AS part, card_id AS id, sha256(card_id) AS hash, actual || '<' || predicted AS detail, NULL::BIGINT AS bits FROM c
    UNION ALL
    SELECT 'index', card_id, NULL, actual || '/' || t, bits FROM c JOIN v_bits USING (vec_id)
    QUALIFY row_number() OVER (PARTITION BY actual, t ORDER BY w DESC, card_id DESC) <= 20""")
def _(t):
    from entityflow.params import TIERS

    n = t.raw("embeddings").count()
    crops = t.cards.select("card_id", (F.col("card_ref_id") % n).alias("vec_id")).join(t.coefficients, "vec_id").select(
        "card_id", F.sha2("card_id", 256).alias("crop_hash"), "coef"
    )
    corrections = reviews.apply_reviews(dup_cards(t), _reviews(t))[1]
    empty = t.index.where(F.lit(False)).select(
        "ref_id", F.lit("x").alias("source"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit("").alias("row_id"), "hash_type", "hash_bits"
    )
    log, index = reviews.correction_rows(corrections, crops, empty)
    tier = (F.array_position(F.array(*[F.lit(x) for x in TIERS]), F.col("hash_type")) - 1).cast("string")
    return log.select(
        F.lit("log").alias("part"), F.col("card_id").alias("id"), F.col("crop_hash").alias("hash"),
        F.concat_ws("<", F.col("actual_ref_id").cast("string"), F.col("predicted_ref_id").cast("string")).alias("detail"),
        F.lit(None).cast("bigint").alias("bits"),
    ).unionByName(index.select(
        F.lit("index").alias("part"), F.col("row_id").alias("id"), F.lit(None).cast("string").alias("hash"),
        F.concat_ws("/", F.col("ref_id").cast("string"), tier).alias("detail"), F.col("hash_bits").alias("bits"),
    ))


_EVENTS_SQL = """(SELECT batch_id AS key, created_at AS ts, CAST(ordinal * 1000000 + suppkey * 100 + confidence AS BIGINT) AS event_id,
    (['claim', 'ready', 'fail', 'claim', 'other', 'ready', 'fail'])[ordinal] AS event, CASE WHEN suppkey % 2 = 0 THEN card_id END AS detail FROM v_cards)"""


@query("apply_transitions", "v_cards v_batches", f"""
    SELECT b.batch_id AS key, coalesce(CASE e.event WHEN 'claim' THEN 'rendering' WHEN 'ready' THEN 'ready' WHEN 'fail' THEN 'failed' END, 'queued') AS status,
           coalesce(e.ts, b.created_at) AS since, e.detail
    FROM v_batches b LEFT JOIN (
      SELECT key, arg_max(event, (ts, event_id)) AS event, max(ts) AS ts, arg_max(detail, (ts, event_id)) FILTER (detail IS NOT NULL) AS detail
      FROM {_EVENTS_SQL} WHERE event IN ('claim', 'ready', 'fail') GROUP BY key) e ON e.key = b.batch_id""")
def _(t):
    return reviews.apply_events(*_ledger_and_events(t), reviews.EXPORT_EVENTS, ["detail"])


@query("apply_item_events", "v_cards", """
    SELECT card_id AS key, CASE confidence % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'not_card' WHEN 2 THEN 'unreadable' ELSE status END AS status FROM v_cards""")
def _(t):
    # a skip, not-a-card or broken event for three items of four, whatever their status
    names = F.array(*[F.lit(e) for e in ("skip", "not_card", "broken")])
    ledger = t.cards.select(F.col("card_id").alias("key"), "status", F.col("created_at").alias("since"))
    events = t.cards.select(
        F.col("card_id").alias("key"), F.col("created_at").alias("ts"), F.col("ordinal").cast("bigint").alias("event_id"),
        F.get(names, F.col("confidence") % 4).alias("event"))
    return reviews.apply_events(ledger, events, reviews.ITEM_EVENTS).select("key", "status")


@query("apply_transitions_guarded", "v_cards v_batches", f"""
    WITH e AS MATERIALIZED (SELECT * FROM {_EVENTS_SQL}),
    one AS (SELECT * FROM e WHERE event = 'claim' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, event_id) = 1),
    two AS (SELECT e.* FROM e JOIN one o ON o.key = e.key AND (e.ts, e.event_id) > (o.ts, o.event_id) WHERE e.event IN ('ready', 'fail')
            QUALIFY row_number() OVER (PARTITION BY e.key ORDER BY e.ts, e.event_id) = 1)
    SELECT b.batch_id AS key, CASE two.event WHEN 'ready' THEN 'ready' WHEN 'fail' THEN 'failed' ELSE CASE WHEN one.key IS NOT NULL THEN 'rendering' ELSE 'queued' END END AS status,
           coalesce(two.ts, one.ts, b.created_at) AS since, coalesce(two.detail, one.detail) AS detail
    FROM v_batches b LEFT JOIN one ON one.key = b.batch_id LEFT JOIN two ON two.key = b.batch_id""")
def _(t):
    return reviews.apply_transitions(*_ledger_and_events(t), reviews.EXPORT_EVENTS, ["detail"])


def _ledger_and_events(t: Tables):
    names = F.array(*[F.lit(e) for e in ("claim", "ready", "fail", "claim", "other", "ready", "fail")])
    events = t.cards.select(
        F.col("batch_id").alias("key"), F.col("created_at").alias("ts"),
        (F.col("ordinal").cast("bigint") * 1000000 + F.col("suppkey") * 100 + F.col("confidence")).alias("event_id"),
        F.element_at(names, F.col("ordinal")).alias("event"), F.when(F.col("suppkey") % 2 == 0, F.col("card_id")).alias("detail"),
    )
    ledger = t.batches.select(
        F.col("batch_id").alias("key"), F.lit("queued").alias("status"), F.col("created_at").alias("since"), F.lit(None).cast("string").alias("detail")
    )
    return ledger, events


# --- evaluation ------------------------------------------------------------------------------

_SCORED_SQL = f"""(SELECT m.file, m.pos, m.scenario, coalesce(m.finish, 'unknown') AS finish, m.expected, g.ref_id AS got, g.stage AS accepted_stage,
      CASE WHEN g.item_id IS NULL THEN 'missed_detection' WHEN g.stage = 'unreadable' THEN 'unreadable'
           WHEN g.stage IN ('h', 'multi', 'llm') THEN CASE WHEN g.ref_id = m.expected THEN 'auto_accepted_correct' ELSE 'auto_accepted_WRONG' END
           ELSE 'sent_to_validation' END AS outcome
    FROM (SELECT card_id, photo_id AS file, row_number() OVER (PARTITION BY photo_id ORDER BY card_id) - 1 AS pos, scenario, finish, card_ref_id AS expected, suppkey
          FROM v_cards) m
    LEFT JOIN {decide_sql()} g ON g.item_id = m.card_id AND m.suppkey % 10 <> 0)"""


def _scored(t: Tables):
    # ordered by every column: equal cards get the same positions in both tables, and both read the same dealt rows
    columns = ["card_id", "scenario", "finish", "card_ref_id", "suppkey"]
    per_photo = Window.partitionBy("photo_id").orderBy(*columns)
    placed = t.cards.select("photo_id", *columns).withColumn("pos", F.row_number().over(per_photo) - 1).select(
        "card_id", F.col("photo_id").alias("file"), "pos", "scenario", "finish", F.col("card_ref_id").alias("expected"), "suppkey",
    )
    idents = cascade.decide(t.methods).withColumnRenamed("item_id", "card_id").select("card_id", "ref_id", "stage")
    got = placed.where(F.col("suppkey") % 10 != 0).select("card_id", "file", "pos").join(idents, "card_id")
    return placed, got


@query("join_eval_positional", "v_cards v_wide", f"SELECT * FROM {_SCORED_SQL}", types={"pos": "INTEGER"})
def _(t):
    return evaluate.score_items(*_scored(t))


_METRICS_SQL = f"""(SELECT CASE WHEN grouping(scenario) = 0 THEN 'scenario' WHEN grouping(finish) = 0 THEN 'finish' WHEN grouping(stage) = 0 THEN 'stage' ELSE 'all' END AS split,
      coalesce(scenario, finish, stage, 'all') AS value, count(*) AS total, count(*) FILTER (starts_with(outcome, 'auto_accepted')) AS auto_accepted,
      count(*) FILTER (outcome = 'auto_accepted_WRONG') AS wrong,
      round_even(count(*) FILTER (starts_with(outcome, 'auto_accepted'))::DOUBLE / count(*), 4) AS auto_accept_rate,
      round_even(count(*) FILTER (accepted_stage = 'h')::DOUBLE / count(*), 4) AS hash_tier_hit_rate
    FROM (SELECT *, coalesce(accepted_stage, 'none') AS stage FROM {_SCORED_SQL}) GROUP BY GROUPING SETS ((), (scenario), (finish), (stage)))"""


@query("agg_eval_metrics", "v_cards v_wide", f"SELECT * FROM {_METRICS_SQL}")
def _(t):
    return evaluate.metrics(evaluate.score_items(*_scored(t)))


_GATE_SQL = f"""(SELECT wrong = 0 AND auto_accept_rate >= 0.9::DOUBLE - 0.01::DOUBLE AS passed,
    CASE WHEN wrong > 0 THEN 'wrong auto-accept' WHEN auto_accept_rate < 0.9::DOUBLE - 0.01::DOUBLE THEN 'auto-accept rate below baseline' ELSE 'ok' END AS reason,
    auto_accept_rate, wrong FROM {_METRICS_SQL} WHERE split = 'all')"""


@query("agg_eval_gate", "v_cards v_wide", f"""
    SELECT g.*, CASE WHEN wrong > 0 THEN (SELECT string_agg(told, ', ' ORDER BY file, pos, told) FROM (
               SELECT file, pos, file || '#' || pos || ' ' || coalesce(CAST(expected AS VARCHAR), 'none') || '->' || coalesce(CAST(got AS VARCHAR), 'none') AS told
               FROM {_SCORED_SQL} WHERE outcome = 'auto_accepted_WRONG' ORDER BY file, pos, told LIMIT 20))
             WHEN NOT passed THEN 'auto_accept_rate ' || auto_accept_rate || ' < baseline 0.9 - 0.01' ELSE '' END AS detail
    FROM {_GATE_SQL} g""")
def _(t):
    return evaluate.evaluate(*_scored(t), 0.9)[2]


@query("eval_run", "v_cards v_wide", f"""
    SELECT 'metric' AS part, split || '/' || value AS name, total AS n, auto_accept_rate AS rate FROM {_METRICS_SQL}
    UNION ALL SELECT 'outcome', outcome, count(*), NULL FROM {_SCORED_SQL} GROUP BY outcome
    UNION ALL SELECT 'gate', reason, wrong, auto_accept_rate FROM {_GATE_SQL}""")
def _(t):
    rows, summary, verdict = evaluate.evaluate(*_scored(t), 0.9)
    return (
        summary.select(F.lit("metric").alias("part"), F.concat_ws("/", "split", "value").alias("name"), F.col("total").alias("n"), F.col("auto_accept_rate").alias("rate"))
        .unionByName(rows.groupBy(F.col("outcome").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("outcome").alias("part"), "name", "n", F.lit(None).cast("double").alias("rate")))
        .unionByName(verdict.select(F.lit("gate").alias("part"), F.col("reason").alias("name"), F.col("wrong").alias("n"), F.col("auto_accept_rate").alias("rate")))
    )


@query("agg_distinct_ids", "v_wide", f"SELECT DISTINCT ref_id FROM {decide_sql()} WHERE ref_id IS NOT NULL")
def _(t):
    accepted = cascade.decide(t.methods).select("ref_id").where(F.col("ref_id").isNotNull())
    return accepted.distinct().orderBy("ref_id")


# --- quotas ----------------------------------------------------------------------------------

@query("win_quota_clamp", "v_requests", """
    SELECT request_id, user_id, want, CAST(least(c, 12) - least(c - want, 12) AS BIGINT) AS granted
    FROM (SELECT *, sum(want) OVER (PARTITION BY user_id, day ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS c FROM v_requests)""")
def _(t):
    return quotas.clamp_grants(t.requests, 12).select("request_id", "user_id", "want", "granted")


# every fourth message comes again later under another number, and photos of every ninth have stored items
_TWICE_SQL = """(SELECT request_id, user_id, day, ts, request_id AS photo_id, want FROM v_requests
    UNION ALL SELECT request_id + 100000000, user_id, day, ts + INTERVAL 1 SECOND, request_id, want FROM v_requests WHERE request_id % 4 = 0)"""


@query("win_quota_deliveries", "v_requests", f"""
    SELECT request_id, photo_id, want, exempt, CAST(CASE WHEN exempt THEN want ELSE least(c, 12) - least(c - want, 12) END AS BIGINT) AS granted
    FROM (SELECT *, sum(CASE WHEN exempt THEN 0 ELSE want END) OVER (PARTITION BY user_id, day ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS c
          FROM (SELECT *, photo_id % 9 = 0 OR row_number() OVER (PARTITION BY photo_id ORDER BY ts, request_id) > 1 AS exempt FROM {_TWICE_SQL}))""")
def _(t):
    k = F.col("request_id")
    once = t.requests.select(k, "user_id", "day", "ts", k.alias("photo_id"), "want")
    again = once.where(k % 4 == 0).withColumn("request_id", k + 100000000).withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(1)))
    stored = t.requests.where(k % 9 == 0).select(k.alias("photo_id"))
    return quotas.charge_deliveries(once.unionByName(again), stored, 12).select("request_id", "photo_id", "want", "exempt", "granted")


# a batch takes in two days
_FANOUT_SQL = """(SELECT request_id, user_id, day, ts, CAST(day - DATE '2024-01-01' AS INTEGER) // 2 AS pair,
    user_id * 100000 + CAST(day - DATE '2024-01-01' AS INTEGER) // 2 * 10 + request_id % 2 AS batch_id,
    want AS offered, CAST(user_id % 4 AS INTEGER) AS in_batch, CAST(user_id % 7 AS INTEGER) AS used_photos, CAST(user_id % 5 AS INTEGER) AS used_fetches FROM v_requests)"""
_FANOUT_CAPS = QuotaParams(photos_per_batch=6, photos_per_day=14, fetches_per_day=13)


@query("win_fanout_truncate", "v_requests", f"""
    WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id, pair ORDER BY ts, request_id) AS i FROM {_FANOUT_SQL}),
    walk AS (
      SELECT user_id, pair, day, i, request_id, batch_id, offered, greatest(6 - in_batch, 0) AS batch_room, 14 - used_photos AS photos_room, 13 - used_fetches AS fetches_room,
             least(offered, greatest(6 - in_batch, 0), 14 - used_photos, 13 - used_fetches) AS granted, [0, 0] AS given, 0 AS today
      FROM r WHERE i = 1
      UNION ALL
      SELECT user_id, pair, day, i, request_id, batch_id, offered, br, pr, fr, least(offered, br, pr, fr), g, d
      FROM (SELECT *, greatest(6 - in_batch - g[request_id % 2 + 1], 0) AS br, greatest(14 - used_photos - d, 0) AS pr, greatest(13 - used_fetches - d, 0) AS fr
            FROM (SELECT r.*, CASE WHEN w.request_id % 2 = 0 THEN [w.given[1] + w.granted, w.given[2]] ELSE [w.given[1], w.given[2] + w.granted] END AS g,
                         CASE WHEN r.day = w.day THEN w.today + w.granted ELSE 0 END AS d
                  FROM walk w JOIN r ON r.user_id = w.user_id AND r.pair = w.pair AND r.i = w.i + 1)))
    SELECT request_id, batch_id, offered, granted, CASE WHEN granted < offered THEN
        CASE WHEN granted = least(offered, batch_room) THEN 'photos_per_batch' WHEN granted = photos_room THEN 'daily photos quota' ELSE 'daily fetches quota' END END AS bound
    FROM walk""", types={"granted": "BIGINT"})
def _(t):
    k = F.col("user_id")
    pair = F.floor(F.date_diff("day", F.lit("2024-01-01").cast("date")) / 2)
    offers = t.requests.select(
        "request_id", k, "day", "ts", (k * 100000 + pair * 10 + F.col("request_id") % 2).alias("batch_id"),
        F.col("want").alias("offered"), (k % 4).cast("int").alias("in_batch"), (k % 7).cast("int").alias("used_photos"), (k % 5).cast("int").alias("used_fetches"),
    )
    return quotas.fanout(offers, _FANOUT_CAPS).select("request_id", "batch_id", "offered", "granted", "bound")


@query("agg_usage_daily", "v_requests", """
    SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) FILTER (event_type = 'signup') AS batches, CAST(sum(want) AS BIGINT) AS photos,
           count(*) FILTER (event_type = 'view') AS fetches FROM v_requests GROUP BY 1, 2""")
def _(t):
    counted = t.requests.select(
        "user_id", "ts", F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("batches"), F.col("want").alias("photos"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("fetches"),
    )
    return quotas.usage_daily(counted, ["batches", "photos", "fetches"]).withColumn("day", F.col("day").cast("string"))


_WANTS_SQL = """(SELECT request_id, user_id, day, ts, CAST(request_id % 2 AS INTEGER) AS batches, CAST(want * (request_id % 3) AS INTEGER) AS photos,
    CAST(request_id % 5 // 3 AS INTEGER) AS fetches FROM v_requests)"""
_ADMIT_CAPS = QuotaParams(batches_per_day=1, photos_per_day=10, fetches_per_day=1)


def quota_wants(t: Tables):
    k = F.col("request_id")
    return t.requests.select(
        k, "user_id", "day", "ts", (k % 2).cast("int").alias("batches"), (F.col("want") * (k % 3)).cast("int").alias("photos"),
        F.floor(k % 5 / 3).cast("int").alias("fetches"),
    )


QUOTA_SQL = f"""
    WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, request_id) AS i FROM {_WANTS_SQL}),
    walk AS (
      SELECT user_id, day, i, request_id, NULL::VARCHAR AS reason, batches AS b, photos AS p, fetches AS f FROM r WHERE i = 1
      UNION ALL
      SELECT user_id, day, i, request_id, reason, CASE WHEN reason IS NULL THEN b + nb ELSE b END, CASE WHEN reason IS NULL THEN p + np ELSE p END,
             CASE WHEN reason IS NULL THEN f + nf ELSE f END
      FROM (SELECT r.user_id, r.day, r.i, r.request_id, w.b, w.p, w.f, r.batches AS nb, r.photos AS np, r.fetches AS nf,
                   CASE WHEN w.b + r.batches > 1 THEN 'batches' WHEN w.p + r.photos > 10 THEN 'photos' WHEN w.f + r.fetches > 1 THEN 'fetches' END AS reason
            FROM walk w JOIN r ON r.user_id = w.user_id AND r.day = w.day AND r.i = w.i + 1))
    SELECT request_id, user_id, reason IS NULL AS admitted, reason FROM walk"""


@query("st_quota_admit", "v_requests", QUOTA_SQL)
def _(t):
    return quotas.quota_admit(quota_wants(t), _ADMIT_CAPS).select("request_id", "user_id", "admitted", "reason")


RATE_SQL = """
    WITH RECURSIVE r AS (SELECT request_id, user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS i FROM v_requests),
    walk AS (
      SELECT key, i, request_id, true AS admitted, [ts] AS recent FROM r WHERE i = 1
      UNION ALL
      SELECT key, i, request_id, ok, CASE WHEN ok THEN list_concat(recent, [ts])[-10:] ELSE recent END
      FROM (SELECT r.key, r.i, r.request_id, r.ts, w.recent,
                   len(list_filter(w.recent, lambda x: x > r.ts - INTERVAL 1 HOUR)) < 3 AND len(list_filter(w.recent, lambda x: x > r.ts - INTERVAL 1 DAY)) < 10 AS ok
            FROM walk w JOIN r ON r.key = w.key AND r.i = w.i + 1))
    SELECT request_id, key, admitted FROM walk"""


@query("st_rate_limit", "v_requests", RATE_SQL)
def _(t):
    keyed = t.requests.select(F.col("user_id").alias("key"), "ts", "request_id")
    return quotas.rate_limit(keyed, "key", AuthParams()).select("request_id", "key", "admitted")


TOUCH_SQL = """
    WITH RECURSIVE r AS (SELECT request_id, user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS i FROM v_requests),
    walk AS (
      SELECT key, i, request_id, true AS touched, ts AS last FROM r WHERE i = 1
      UNION ALL
      SELECT r.key, r.i, r.request_id, w.last < r.ts - INTERVAL 1 HOUR, CASE WHEN w.last < r.ts - INTERVAL 1 HOUR THEN r.ts ELSE w.last END
      FROM walk w JOIN r ON r.key = w.key AND r.i = w.i + 1)
    SELECT request_id, key, touched FROM walk"""


@query("st_session_touch", "v_requests", TOUCH_SQL)
def _(t):
    keyed = t.requests.select(F.col("user_id").alias("key"), "ts", "request_id")
    return quotas.session_touch(keyed, "key").select("request_id", "key", "touched")


@query("st_idle_sessions", "v_requests", """
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS events FROM (
      SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, request_id) >= INTERVAL 2 HOUR, true) AS fresh FROM v_requests))
    GROUP BY user_id, s""")
def _(t):
    return quotas.idle_sessions(t.requests)


# --- constraints -----------------------------------------------------------------------------

_ODD_SQL = """(SELECT card_id AS id, photo_id, CASE WHEN confidence = 50 THEN NULL ELSE ordinal END AS crop_index, quantity, confidence,
    CASE WHEN confidence = 77 THEN 'lost' ELSE status END AS status, CASE WHEN confidence = 88 THEN card_ref_id + 1000000 ELSE card_ref_id END AS card_ref_id FROM v_cards)"""


@query("check_constraints", "v_cards v_refs v_photos", f"""
    WITH odd AS (SELECT * FROM {_ODD_SQL})
    SELECT 'required crop_index' AS rule, NULL AS value, count(*) AS rows FROM odd WHERE crop_index IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'allowed status', status, count(*) FROM odd WHERE status = 'lost' GROUP BY status
    UNION ALL SELECT 'unique photo_id,crop_index', photo_id || '/' || crop_index, count(*) FROM odd WHERE crop_index IS NOT NULL GROUP BY photo_id, crop_index HAVING count(*) > 1
    UNION ALL SELECT 'reference card_ref_id', CAST(card_ref_id AS VARCHAR), count(*) FROM odd ANTI JOIN v_refs r ON r.id = odd.card_ref_id GROUP BY card_ref_id""")
def _(t):
    from entityflow.operators.constraints import violations
    from entityflow.schemas import TABLES

    c = F.col("confidence")
    odd = t.cards.select(
        F.col("card_id").alias("id"), "photo_id", F.when(c != 50, F.col("ordinal")).alias("crop_index"), "quantity", "confidence",
        F.when(c == 77, "lost").otherwise(F.col("status")).alias("status"),
        F.when(c == 88, F.col("card_ref_id") + 1000000).otherwise(F.col("card_ref_id")).alias("card_ref_id"),
    )
    return violations(odd, TABLES["cards"], {"card_refs": t.refs, "photos": t.photos.withColumnRenamed("photo_id", "id")})
