"""Admission checks: URLs, hosts, mail domains, payloads, blobs, sessions, tokens, errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.net import is_public
from entityflow.functions.ranking import oldest
from entityflow.functions.text import json_value
from entityflow.params import AuthParams, GateParams

# Required payload keys of each job type (in checking order) and keys that may be null.
PAYLOAD_KEYS: dict[str, tuple[str, ...]] = {
    "detect": ("photo_id",),
    "identify": ("card_id",),
    "fetch_source": ("photo_id",),
    "ingest_correction": ("card_id", "actual_ref_id", "predicted_ref_id"),
    "price": ("card_ref_id", "finish"),
}
NULLABLE_KEYS = ("predicted_ref_id",)
# The types the web side may enqueue.
WEB_PAYLOAD_KEYS: dict[str, tuple[str, ...]] = {
    **{k: v for k, v in PAYLOAD_KEYS.items() if k != "price"},
    "export": ("export_id",),
}

# Leading bytes of accepted images and the brands of the HEIF family.
JPEG_MAGIC = "FFD8FF"
PNG_MAGIC = "89504E470D0A1A0A"
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1", "heim", "heis", "hevm", "hevs")

# Fixed value: error classes that no retry can cure.
PERMANENT_ERRORS = ("ValueError",)


def url_reason(url: Column, p: GateParams = GateParams()) -> Column:
    """Why a URL is refused; NULL if it is admitted."""
    # parse_url raises on malformed text, so its tolerant form is used
    scheme, host, user, path = (F.try_parse_url(url, F.lit(x)) for x in ("PROTOCOL", "HOST", "USERINFO", "PATH"))
    host = F.lower(host)
    return (
        F.when(scheme.isNull(), "not a valid URL")
        .when(F.lower(scheme) != "https", "https only")
        .when(user.isNotNull(), "userinfo not allowed")
        .when(host.isNull() | ~host.isin(*p.allowed_hosts), F.concat(F.lit("host not allowed: "), F.coalesce(host, F.lit(""))))
        .when(host.isin(*p.path_hosts) & F.coalesce(path, F.lit("")).isin("", "/"), "album/gallery URL requires a path")
    )


def source_type(url: Column) -> Column:
    """Which kind of source an admitted URL names."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(host.isin("www.reddit.com", "i.redd.it"), "reddit").otherwise("imgur")


def gate_urls(df: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Add ``reason`` (NULL when admitted) and ``source_type`` to rows with a ``url``."""
    gated = df.withColumn("reason", url_reason(F.col("url"), p))
    return gated.withColumn("source_type", F.when(F.col("reason").isNull(), source_type(F.col("url"))))


def is_album(url: Column) -> Column:
    """Does an admitted URL name an album or thread, whose images have to be listed first?"""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    album = (host == "imgur.com") & (path.contains("/a/") | path.contains("/gallery/"))
    return F.coalesce(album | ((host == "www.reddit.com") & path.contains("/comments/")), F.lit(False))


def split_url_requests(requests: DataFrame, p: GateParams = GateParams()) -> tuple[DataFrame, DataFrame]:
    """(entries, refused): whitespace-separated text to one row per URL; too many or none refuses the request."""
    parts = F.filter(F.split("text", r"\s+"), lambda s: s != "")
    sized = requests.withColumn("_parts", parts).withColumn("_n", F.size(parts))
    refused = sized.where((F.col("_n") == 0) | (F.col("_n") > p.max_urls)).select(
        "request_id", F.when(F.col("_n") == 0, "no urls supplied").otherwise(f"too many urls (max {p.max_urls})").alias("reason")
    )
    entries = sized.where(F.col("_n").between(1, p.max_urls)).select("request_id", F.posexplode("_parts").alias("pos", "url"))
    return entries, refused


def admit_url_requests(requests: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Add ``reason`` (NULL when admitted), ``urls`` and ``source_types`` to requests with whitespace-separated ``text``.

    One refused URL refuses the whole request, with the reason of the first such URL; so do too many URLs or none, in
    which case no URL is looked at. A refused request has no URLs. Nothing is shuffled.
    """
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda s: s != "")
    sized = requests.withColumn("_parts", parts).withColumn("_n", F.size("_parts"))
    judged = F.filter(F.transform("_parts", lambda u: url_reason(u, p)), lambda r: r.isNotNull())
    reason = (
        F.when(F.col("_n") == 0, "no urls supplied").when(F.col("_n") > p.max_urls, f"too many urls (max {p.max_urls})")
        .otherwise(F.get(judged, F.lit(0)))
    )
    admitted = sized.withColumn("reason", reason).withColumn("urls", F.when(F.col("reason").isNull(), F.col("_parts")))
    return admitted.withColumn("source_types", F.transform("urls", source_type)).drop("_parts", "_n")


def public_hosts(resolutions: DataFrame) -> DataFrame:
    """(host, ip) rows to one row per host: public only if every record is."""
    return resolutions.groupBy("host").agg(
        F.bool_and(is_public(F.col("ip"))).alias("public"), F.count(F.lit(1)).alias("records")
    )


def mail_domain(email: Column) -> Column:
    return F.when(email.contains("@"), F.lower(F.trim(F.element_at(F.split(email, "@"), -1))))


def flag_disposable(emails: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Add ``disposable``: the domain or a parent domain is listed; a single label never matches.

    Suffixes are expanded once per distinct domain, not once per address.
    """
    with_domain = emails.withColumn("_domain", mail_domain(F.col("email")))
    labels = F.split("_domain", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    listed = (
        with_domain.select("_domain").distinct()
        .where(F.size(labels) > 1)
        .select("_domain", F.explode(suffixes).alias("domain"))
        .join(blocklist.select("domain"), "domain", "left_semi")
        .select("_domain", F.lit(True).alias("_hit")).distinct()
    )
    return (
        with_domain.join(listed, "_domain", "left")
        .withColumn("disposable", F.coalesce("_hit", F.lit(False)))
        .drop("_domain", "_hit")
    )


def payload_reason(kind: Column, payload: Column, required: Mapping[str, Sequence[str]] = PAYLOAD_KEYS) -> Column:
    """Why a JSON payload breaks the contract of its type, NULL if it keeps it."""
    value = json_value(payload)
    keys = F.json_object_keys(payload)
    reason = F.when(~kind.isin(*required), F.concat(F.lit("unknown type "), kind))
    reason = reason.when(value.isNull() | keys.isNull(), "payload must be an object")
    for name, wanted in required.items():
        mine = kind == name
        for key in wanted:
            found = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
            allowed = ("STRING", "VOID") if key in NULLABLE_KEYS else ("STRING",)
            reason = reason.when(mine & ~F.array_contains(keys, key), f"missing key {key}")
            reason = reason.when(mine & ~found.isin(*allowed), f"{key} must be a string")
        reason = reason.when(mine & ~keys_equal(keys, F.array(*[F.lit(k) for k in wanted])), "unexpected key")
    return reason


def keys_equal(a: Column, b: Column) -> Column:
    """Same key set: nothing missing and nothing extra."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def validate_payload(
    jobs: DataFrame, required: Mapping[str, Sequence[str]] = PAYLOAD_KEYS
) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with reason)."""
    checked = jobs.withColumn("reason", payload_reason(F.col("type"), F.col("payload"), required))
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def sniff_blobs(blobs: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Add ``format`` and ``reason`` to rows with ``content``; the size limit comes before any look at the bytes."""
    c = F.col("content")
    head = F.hex(F.substring(c, 1, 12))
    brand = F.decode(F.substring(c, 9, 4), "ISO-8859-1")
    heif = (F.length(c) >= 12) & (F.decode(F.substring(c, 5, 4), "ISO-8859-1") == "ftyp") & brand.isin(*HEIF_BRANDS)
    kind = F.when(head.startswith(JPEG_MAGIC), "jpeg").when(head.startswith(PNG_MAGIC), "png").when(heif, "heif")
    known = kind.isNotNull() if p.accept_heif else kind.isNotNull() & (kind != "heif")
    reason = F.when(F.length(c) > p.max_photo_bytes, "file too large").when(~known, "unsupported format")
    return blobs.withColumn("reason", reason).withColumn("format", F.when(F.col("reason").isNull(), kind))


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: Column, p: AuthParams = AuthParams()) -> DataFrame:
    """Sessions inside both windows whose owner is active."""
    idle = as_of - F.make_dt_interval(days=F.lit(p.session_idle_days))
    live = sessions.where((F.col("expires_at") > as_of) & (F.col("last_seen_at") > idle))
    active = users.where(F.col("status") == "active").select("user_id", "email", "tier")
    return live.join(active, "user_id")


def consume(tokens: DataFrame, uses: DataFrame) -> DataFrame:
    """The one use of each token that counts: the earliest before it expires."""
    tried = uses.join(tokens.select("token_id", "expires_at"), "token_id").where(F.col("used_at") < F.col("expires_at"))
    return oldest(tried.select("token_id", "use_id", "used_at"), ["token_id"], ["used_at", "use_id"])


def export_state(exports: DataFrame, as_of: Column) -> DataFrame:
    state = (
        F.when((F.col("status") != "ready") | F.col("storage_key").isNull(), "not ready")
        .when(F.col("expires_at") <= as_of, "expired")
        .otherwise("downloadable")
    )
    return exports.withColumn("state", state)


def error_class(name: Column) -> Column:
    return F.when(name.isin(*PERMANENT_ERRORS), "permanent").otherwise("transient")


def backoff(jobs: DataFrame, step_seconds: int = 30) -> DataFrame:
    """Next state of failed attempts: requeued after 30 s per attempt, or failed once the attempts are used up, which
    leaves ``run_after`` as it was."""
    over = F.col("attempts") >= F.col("max_attempts")
    wait = F.make_dt_interval(secs=(F.col("attempts") * step_seconds).cast("decimal(18,6)"))
    return jobs.withColumn("next_status", F.when(over, "failed").otherwise("queued")).withColumn(
        "run_after", F.when(over, F.col("run_after")).otherwise(F.col("failed_at") + wait)
    )


def recent_counts(df: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Rows of the last hour and of the last day per key, in one pass."""
    hour = as_of - F.make_dt_interval(hours=F.lit(1))
    day = as_of - F.make_dt_interval(days=F.lit(1))
    return df.groupBy(key).agg(
        F.count_if(F.col("ts") > hour).alias("hour_count"), F.count_if(F.col("ts") > day).alias("day_count")
    )
