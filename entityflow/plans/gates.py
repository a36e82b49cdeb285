"""Gate queries over the bound tables."""

from pyspark.sql import functions as F

from entityflow.operators import gates as op
from entityflow.plans.bindings import lit_ts
from entityflow.plans.registry import query
from entityflow.sources.blocklist import DISPOSABLE_DOMAINS, default_blocklist

_URLS_SQL = """(SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://i.imgur.com/p' || page_id || '.jpg' WHEN 1 THEN 'https://imgur.com/'
    WHEN 2 THEN 'https://IMGUR.com/a/' || page_id WHEN 3 THEN 'http://i.redd.it/' || page_id WHEN 4 THEN 'https://imgur.com@evil.com/'
    WHEN 5 THEN 'https://www.reddit.com/comments/' || page_id WHEN 6 THEN 'https://imgur.com.evil.io/a/1' WHEN 7 THEN 'not a url'
    ELSE url END AS url FROM pages)"""
_SCHEME = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
_HOST = r"lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_REASON_SQL = rf"""CASE WHEN {_SCHEME} = '' THEN 'not a valid URL' WHEN {_SCHEME} <> 'https' THEN 'https only'
      WHEN regexp_matches(url, '^[a-z]+://[^/?#]*@') THEN 'userinfo not allowed'
      WHEN {_HOST} NOT IN ('i.imgur.com', 'imgur.com', 'api.imgur.com', 'i.redd.it', 'www.reddit.com') THEN 'host not allowed: ' || {_HOST}
      WHEN {_HOST} IN ('imgur.com', 'www.reddit.com') AND {_PATH} IN ('', '/') THEN 'album/gallery URL requires a path' END"""


@query("flt_url_gate", "", f"""
    SELECT page_id, url, reason, CASE WHEN reason IS NULL THEN CASE WHEN host IN ('www.reddit.com', 'i.redd.it') THEN 'reddit' ELSE 'imgur' END END AS source_type
    FROM (SELECT page_id, url, {_HOST} AS host, {_REASON_SQL} AS reason FROM {_URLS_SQL})""")
def _(t):
    k = F.col("page_id")
    n = k.cast("string")
    url = (
        F.when(k % 9 == 0, F.concat(F.lit("https://i.imgur.com/p"), n, F.lit(".jpg"))).when(k % 9 == 1, F.lit("https://imgur.com/"))
        .when(k % 9 == 2, F.concat(F.lit("https://IMGUR.com/a/"), n)).when(k % 9 == 3, F.concat(F.lit("http://i.redd.it/"), n))
        .when(k % 9 == 4, F.lit("https://imgur.com@evil.com/")).when(k % 9 == 5, F.concat(F.lit("https://www.reddit.com/comments/"), n))
        .when(k % 9 == 6, F.lit("https://imgur.com.evil.io/a/1")).when(k % 9 == 7, F.lit("not a url")).otherwise(F.col("url"))
    )
    return op.gate_urls(t.raw("pages").select("page_id", url.alias("url")))


# a request of 0 to 12 links, of which one in some requests is refused
@query("flt_url_request", "", rf"""
    WITH entries AS (
      SELECT page_id, i, CASE WHEN (page_id + i) % 37 = 0 THEN 'http://i.redd.it/' || i WHEN (page_id + i) % 41 = 0 THEN 'https://imgur.com'
               WHEN i % 3 = 0 THEN 'https://i.imgur.com/' || page_id || '.jpg' WHEN i % 3 = 1 THEN 'https://www.reddit.com/comments/' || page_id
               ELSE 'https://IMGUR.com/a/' || page_id END AS url
      FROM (SELECT page_id, unnest(range(page_id % 13)) AS i FROM pages)),
    gated AS (SELECT page_id, count(*) AS n, arg_min(reason, i) FILTER (reason IS NOT NULL) AS bad, string_agg(url, ' ' ORDER BY i) AS urls,
                     string_agg(CASE WHEN {_HOST} IN ('www.reddit.com', 'i.redd.it') THEN 'reddit' ELSE 'imgur' END, ' ' ORDER BY i) AS kinds
              FROM (SELECT *, {_REASON_SQL} AS reason FROM entries) GROUP BY page_id),
    told AS (SELECT p.page_id, g.urls, g.kinds, CASE WHEN g.n IS NULL THEN 'no urls supplied' WHEN g.n > 10 THEN 'too many urls (max 10)' ELSE g.bad END AS reason
             FROM pages p LEFT JOIN gated g USING (page_id))
    SELECT page_id, reason, CASE WHEN reason IS NULL THEN urls END AS urls, CASE WHEN reason IS NULL THEN kinds END AS source_types FROM told""")
def _(t):
    k = F.col("page_id")
    n = k.cast("string")

    def link(i):
        return (
            F.when((k + i) % 37 == 0, F.concat(F.lit("http://i.redd.it/"), i.cast("string"))).when((k + i) % 41 == 0, F.lit("https://imgur.com"))
            .when(i % 3 == 0, F.concat(F.lit("https://i.imgur.com/"), n, F.lit(".jpg")))
            .when(i % 3 == 1, F.concat(F.lit("https://www.reddit.com/comments/"), n)).otherwise(F.concat(F.lit("https://IMGUR.com/a/"), n))
        )

    links = F.when(k % 13 > 0, F.transform(F.sequence(F.lit(0), (k % 13 - 1).cast("int")), link)).otherwise(F.array().cast("array<string>"))
    asked = t.raw("pages").select("page_id", F.concat(F.lit(" \n"), F.array_join(links, "\t \n")).alias("text"))
    done = op.admit_url_requests(asked)
    return done.select("page_id", "reason", F.array_join("urls", " ").alias("urls"), F.array_join("source_types", " ").alias("source_types"))


# three records per host: public ones, and in some hosts a private, shared or mapped one
_IPS = ("93.184.216.34", "10.1.2.3", "100.64.0.1", "8.8.8.8", "::ffff:127.0.0.1", "2606:2800:220:1::1", "fd00::1", "1.1.1.1", "172.32.0.1", "172.31.9.9")
_CLOSED = ("10.1.2.3", "100.64.0.1", "::ffff:127.0.0.1", "fd00::1", "172.31.9.9")


@query("flt_ip_public", "", f"""
    SELECT host, bool_and(ip NOT IN {_CLOSED}) AS public, count(*) AS records FROM (
      SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, ({list(_IPS)})[(page_id * page_id + r * 3) % 10 + 1] AS ip
      FROM pages, (SELECT unnest(range(3)) AS r)) GROUP BY host""")
def _(t):
    ips = F.array(*[F.lit(i) for i in _IPS])
    k = F.col("page_id")
    records = t.raw("pages").select(
        F.try_parse_url("url", F.lit("HOST")).alias("host"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.element_at(ips, ((k * k + r * 3) % 10 + 1).cast("int")))).alias("ip"),
    )
    return op.public_hosts(records)


@query("flt_disposable_domain", "v_users", f"""
    SELECT user_id, email, coalesce(list_bool_or(list_transform(range(1, len(l)), lambda i:
        list_contains({DISPOSABLE_DOMAINS}, array_to_string(l[i:], '.')))), false) AS disposable
    FROM (SELECT user_id, email, string_split(split_part(email, '@', 2), '.') AS l FROM v_users)""")
def _(t):
    return op.flag_disposable(t.users.select("user_id", "email"), default_blocklist(t.spark))


_PAYLOADS = {
    "detect": '{"photo_id": "p"}', "identify": '{"card_id": 7}', "price": '{"card_ref_id": "r", "finish": "normal", "x": 1}',
    "fetch_source": '["photo_id"]', "ingest_correction": '{"card_id": "c", "actual_ref_id": "r", "predicted_ref_id": null}',
    "export": '{"export_id": "e"}',
}
_WHY = {
    "identify": "card_id must be a string", "price": "unexpected key", "fetch_source": "payload must be an object", "export": "unknown type export",
}


@query("flt_payload_contract", "", f"""
    SELECT event_id, type, CASE WHEN event_id % 7 = 6 THEN CASE WHEN type = 'export' THEN 'unknown type export'
        ELSE 'missing key ' || MAP {{'detect': 'photo_id', 'identify': 'card_id', 'price': 'card_ref_id', 'fetch_source': 'photo_id', 'ingest_correction': 'card_id'}}[type] END
      ELSE MAP {{{', '.join(f"'{k}': '{v}'" for k, v in _WHY.items())}}}[type] END AS reason
    FROM (SELECT event_id, ({list(_PAYLOADS)})[event_id % 6 + 1] AS type FROM events)""")
def _(t):
    k = F.col("request_id")
    kinds = F.array(*[F.lit(x) for x in _PAYLOADS])
    bodies = F.array(*[F.lit(x) for x in _PAYLOADS.values()])
    jobs = t.requests.select(
        k.alias("event_id"), F.element_at(kinds, (k % 6 + 1).cast("int")).alias("type"),
        F.when(k % 7 == 6, F.lit("{}")).otherwise(F.element_at(bodies, (k % 6 + 1).cast("int"))).alias("payload"),
    )
    ok, bad = op.validate_payload(jobs)
    return ok.select("event_id", "type", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", "type", "reason"))


@query("set_key_equality", "", """
    SELECT event_id, event_id % 4 < 2 AS equal FROM events""")
def _(t):
    k = F.col("request_id")
    a = F.array(F.lit("x"), F.lit("y"))
    b = (
        F.when(k % 4 == 0, F.array(F.lit("y"), F.lit("x"))).when(k % 4 == 1, F.array(F.lit("x"), F.lit("y"), F.lit("y")))
        .when(k % 4 == 2, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    )
    return t.requests.select(k.alias("event_id"), op.keys_equal(a, b).alias("equal"))


_BRANDS = ("jpeg", "png", "heif", "webp", "short", "avif")


@query("flt_blob_sniff", "", f"""
    SELECT doc_id, CASE WHEN doc_id % 6 < 3 THEN ({list(_BRANDS)})[doc_id % 6 + 1] END AS format,
           CASE WHEN doc_id % 6 >= 3 THEN 'unsupported format' END AS reason FROM documents""")
def _(t):
    heads = F.array(*[F.lit(h) for h in (
        "FFD8FFE0", "89504E470D0A1A0A", "00000018" + b"ftypheic".hex(), b"RIFF0000WEBP".hex(), "FFD8", "0000001C" + b"ftypavif".hex())])
    k = F.col("doc_id")
    tail = F.when(k % 6 == 4, F.lit("")).otherwise(F.col("text")).cast("binary")
    blobs = t.raw("documents").select("doc_id", F.concat(F.unhex(F.element_at(heads, (k % 6 + 1).cast("int"))), tail).alias("content"))
    return op.sniff_blobs(blobs).drop("content")


_SESSIONS_SQL = """(SELECT request_id AS session_id, user_id, ts AS last_seen_at,
    ts - to_days(CAST(request_id % 40 AS INTEGER)) + INTERVAL 30 DAY AS expires_at FROM v_requests)"""


@query("flt_session_live", "v_requests v_users", f"""
    SELECT s.session_id, s.user_id, u.tier FROM {_SESSIONS_SQL} s JOIN v_users u USING (user_id)
    WHERE s.expires_at > TIMESTAMP '2024-01-26 00:00:00' AND s.last_seen_at > TIMESTAMP '2024-01-26 00:00:00' - INTERVAL 7 DAY
      AND u.status = 'active'""")
def _(t):
    age = F.make_dt_interval(days=(F.col("request_id") % 40).cast("int"))
    sessions = t.requests.select(
        F.col("request_id").alias("session_id"), "user_id", F.col("ts").alias("last_seen_at"),
        (F.col("ts") - age + F.make_dt_interval(days=F.lit(30))).alias("expires_at"),
    )
    return op.live_sessions(sessions, t.users, lit_ts("2024-01-26 00:00:00")).select("session_id", "user_id", "tier")


@query("flt_single_use", "v_requests", """
    SELECT u.request_id // 5 AS token_id, u.request_id AS use_id, u.ts AS used_at
    FROM v_requests u JOIN v_requests c ON c.request_id = u.request_id // 5 * 5
    WHERE u.request_id % 5 > 1 AND u.ts < c.ts + INTERVAL 15 MINUTE
    QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY u.ts, u.request_id) = 1""")
def _(t):
    k = F.col("request_id")
    token = F.floor(k / 5).cast("bigint").alias("token_id")
    tokens = t.requests.where(k % 5 == 0).select(token, (F.col("ts") + F.make_dt_interval(mins=F.lit(15))).alias("expires_at"))
    uses = t.requests.where(k % 5 > 1).select(token, k.alias("use_id"), F.col("ts").alias("used_at"))
    return op.consume(tokens, uses)


@query("flt_export_state", "v_batches", """
    SELECT batch_id AS export_id, CASE WHEN batch_id % 4 <> 3 OR batch_id % 5 = 0 THEN 'not ready'
       WHEN created_at + INTERVAL 48 HOUR <= TIMESTAMP '1998-06-01 00:00:00' THEN 'expired' ELSE 'downloadable' END AS state FROM v_batches""")
def _(t):
    k = F.col("batch_id")
    states = F.array(*[F.lit(s) for s in ("queued", "rendering", "failed", "ready")])
    exports = t.batches.select(
        k.alias("export_id"), F.element_at(states, (k % 4 + 1).cast("int")).alias("status"),
        F.when(k % 5 != 0, F.concat(F.lit("exports/"), k.cast("string"))).alias("storage_key"),
        (F.col("created_at") + F.make_dt_interval(hours=F.lit(48))).alias("expires_at"),
    )
    return op.export_state(exports, lit_ts("1998-06-01 00:00:00")).select("export_id", "state")


_ERRORS = ("ValueError", "TimeoutError", "ConnectionError")


@query("flt_error_class", "v_requests", f"""
    SELECT request_id, error, CASE WHEN error = 'ValueError' THEN 'permanent' ELSE 'transient' END AS class
    FROM (SELECT request_id, ({list(_ERRORS)})[request_id % 3 + 1] AS error FROM v_requests)""")
def _(t):
    e = F.element_at(F.array(*[F.lit(x) for x in _ERRORS]), (F.col("request_id") % 3 + 1).cast("int"))
    return t.requests.select("request_id", e.alias("error")).withColumn("class", op.error_class(F.col("error")))


@query("fn_backoff", "v_requests", """
    SELECT request_id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS next_status,
           CASE WHEN attempts >= 3 THEN ts - to_seconds(5) ELSE ts + to_seconds(30 * attempts) END AS run_after
    FROM (SELECT request_id, ts, CAST(request_id % 4 + 1 AS INTEGER) AS attempts FROM v_requests)""")
def _(t):
    jobs = t.requests.select(
        "request_id", F.col("ts").alias("failed_at"), (F.col("ts") - F.make_dt_interval(secs=F.lit(5))).alias("run_after"), (F.col("request_id") % 4 + 1).cast("int").alias("attempts"), F.lit(3).alias("max_attempts")
    )
    return op.backoff(jobs).select("request_id", "next_status", "run_after")


@query("agg_window_counts", "v_requests", """
    SELECT user_id, count(*) FILTER (ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR) AS hour_count,
           count(*) FILTER (ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 DAY) AS day_count
    FROM v_requests WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY user_id""")
def _(t):
    as_of = lit_ts("2024-01-20 12:00:00")
    return op.recent_counts(t.requests.where(F.col("ts") <= as_of), "user_id", as_of)
