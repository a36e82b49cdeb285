"""Not-modified revisits of a web archive.

A revisit record (status 304) says that a page has not changed since an earlier capture. Each is joined, by canonical URL
and time, to the latest earlier full response. The pair is accepted if the revisit's validators agree with the
response's: an ETag decides where the revisit has one (a strong one must be equal, a weak one equal without its mark),
else Last-Modified, and a revisit without validators only stands if the response has none either. An accepted revisit
takes the response's headers, replaced by those of its own that a 304 may change.

The as-of join is a range partitioning by URL and time with a scan of each partition, in which a URL with a third of all
records is spread over many partitions; what a partition must know of those before it is one row per URL and partition.
Only keys, times, validators and headers move; bodies are fetched by record id afterwards.

Edge cases: records with a NULL URL or time match nothing; of equal times the smaller record id is earlier, and a
response serves revisits of its own time only if its id is smaller; repeated rows are records each; a NULL header map is
empty and header names are compared in lower case; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.llm.common import boxed
from entityflow.sources.storage import materialise

# Header fields that a 304 response may replace (RFC 9110, 15.4.5; RFC 9111, 3.2), and query parameters
# that only track.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """host/path?query: scheme, ``www.``, default port, fragment, tracking parameters and a last slash are left out, the
    host is in lower case and parameters are sorted. NULL for what is no http address."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING))))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.rlike(bare, F.lit("^[Hh][Tt][Tt][Pp][Ss]?://[^/?]")), F.concat(host, path, tail))


def lower_names(headers: Column) -> Column:
    """Header entries sorted by lower-case name; of equal names the last stays."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.sort_array(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.filter(named, lambda e, i: F.coalesce(F.get(named, i + 1)["key"] != e["key"], F.lit(True)))


def as_of(df: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """``df`` with ``latest``: of its key, the last non-NULL ``value`` (a struct) strictly before the row in (time, tie)
    order. ``df`` must hold what moves only: it is written once."""
    ranged = df.repartitionByRange(key, time, tie).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "as-of")
    order = F.when(F.col(value).isNotNull(), F.struct(time, tie))
    tails = ranged.groupBy("_part", key).agg(F.max_by(F.col(value), order).alias("_tail"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(earlier)).where("_carry IS NOT NULL").select(
        F.col("_part").alias("_of_part"), F.col(key).alias("_of_key"), "_carry")
    inside = Window.partitionBy("_part", key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1)
    seen = ranged.withColumn("_seen", F.last(value, ignorenulls=True).over(inside))
    matched = seen.join(carried, (F.col("_part") == F.col("_of_part")) & (F.col(key) == F.col("_of_key")), "left")
    return matched.withColumn("latest", F.coalesce("_seen", "_carry")).drop("_seen", "_carry", "_of_part", "_of_key", "_part")


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _header(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` has record_id (long), kind (``response`` or ``revisit``), url, captured_at (long), status (int) and
    headers (map). Per revisit: its row (boxed), url_key, response_id, verdict (``resolved``, ``mismatch`` or
    ``no_response``) and headers (entries sorted by name; NULL unless resolved)."""
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    known = lower_names(F.col("headers"))
    keyed = boxed(
        records, url_key=canonical_url(F.col("url")), at=F.col("captured_at"), id=F.col("record_id"), full=full,
        revisit=F.col("kind") == "revisit", known=known,
    ).where("full OR revisit")
    moving = keyed.select(
        "row", "url_key", "at", "id", "revisit", "known", F.when(F.col("full"), F.struct("id", "known")).alias("value"))
    sound = moving.where("url_key IS NOT NULL AND at IS NOT NULL")
    lost = moving.where("revisit AND (url_key IS NULL OR at IS NULL)").withColumn("latest", F.lit(None).cast(moving.schema["value"].dataType))
    joined = as_of(sound, "url_key", "at", "id", "value").where("revisit").unionByName(lost)
    response = F.col("latest.known")
    tag, date = _header(F.col("known"), "etag"), _header(F.col("known"), "last-modified")
    old_tag, old_date = _header(response, "etag"), _header(response, "last-modified")
    agrees = (
        F.when(tag.isNotNull() & tag.startswith("W/"), _strong(tag) == _strong(old_tag))
        .when(tag.isNotNull(), tag == old_tag)
        .when(date.isNotNull(), date == old_date)
        .otherwise(old_tag.isNull() & old_date.isNull())
    )
    verdict = (
        F.when(F.col("latest").isNull(), "no_response")
        .when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    )
    new = F.filter("known", lambda e: e["key"].isin(*PERMITTED))
    old = F.filter(response, lambda e: ~F.coalesce(F.array_contains(F.transform(new, lambda n: n["key"]), e["key"]), F.lit(False)))
    done = joined.withColumn("verdict", verdict)
    resolved = F.col("verdict") == "resolved"
    return done.select(
        "row", "url_key", F.when(resolved, F.col("latest.id")).alias("response_id"), "verdict",
        F.when(resolved, F.sort_array(F.concat(old, new))).alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame, body: str) -> DataFrame:
    """``resolved`` with the ``body`` of the response each revisit stands for."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("of"), F.col(body).alias("body"))
    return resolved.join(bodies, F.col("response_id") == F.col("of"), "left").drop("of")
