"""Daily quotas and rate limits, in batch form.

Rules whose state is a running sum are closed forms over running totals; the all-or-nothing rule works on a
thinned list of requests that is bounded by the caps; the time-window rules scan each key in time order with a
state of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.functions.ranking import oldest, running_total
from entityflow.functions.scan import ordered_scan, time_slots, with_runs
from entityflow.params import AuthParams, QuotaParams
from entityflow.sources.storage import materialise

HOUR = 3_600_000_000  # microseconds
DAY = 24 * HOUR


def _clamped(total: Column, want: Column, cap: Column) -> Column:
    """What a request gets once the running total of wants is cut at ``cap``."""
    return F.least(total, cap) - F.least(total - want, cap)


def clamp_grants(requests: DataFrame, cap: int) -> DataFrame:
    """Partial grants (user_id, day, ts, request_id, want): each gets what is left of the day's cap."""
    want = F.col("want").cast("bigint")
    summed = running_total(requests, ["user_id", "day"], ["ts", "request_id"], want, "_total")
    return summed.withColumn("granted", _clamped(F.col("_total"), want, F.lit(cap).cast("bigint"))).drop("_total")


def charge_deliveries(deliveries: DataFrame, stored: DataFrame, cap: int) -> DataFrame:
    """Partial grants of item messages (user_id, day, ts, request_id, photo_id, want) that may come more than once.

    A photo is charged at its first delivery, and not at all if ``stored`` (photo_id) says that items of it were stored
    before: such messages are ``exempt``, take nothing from the day and are not cut. A NULL photo is a message of its own.
    """
    first = oldest(deliveries.where("photo_id is not null").select("photo_id", "ts", "request_id"), ["photo_id"], ["ts", "request_id"])
    known = stored.select(F.col("photo_id").alias("_stored")).distinct()
    marked = (
        deliveries.join(first.select(F.col("photo_id").alias("_photo"), F.col("request_id").alias("_first")), F.col("photo_id") == F.col("_photo"), "left")
        .join(known, F.col("photo_id") == F.col("_stored"), "left")
        .withColumn("exempt", F.col("_stored").isNotNull() | F.coalesce(F.col("_first") != F.col("request_id"), F.lit(False)))
        .drop("_photo", "_first", "_stored").withColumn("_asked", F.col("want")).withColumn("want", F.when(~F.col("exempt"), F.col("want")).otherwise(0))
    )
    granted = clamp_grants(marked, cap).withColumn("want", F.col("_asked")).drop("_asked")
    return granted.withColumn("granted", F.when(F.col("exempt"), F.col("want").cast("bigint")).otherwise(F.col("granted")))


def fanout(requests: DataFrame, p: QuotaParams = QuotaParams()) -> DataFrame:
    """Grants of linked images: bounded by the offer, the room in the batch and the day's photos and fetches.

    Rows carry (user_id, day, ts, request_id, batch_id, offered, in_batch, used_photos, used_fetches), the last
    three as they stood before the first request. ``bound`` names what cut a grant. Once the day's room is used
    up every later grant of the day is 0, so within a day the batch cut and the day cut can be taken one after the
    other. A batch of several days starts each with the room that its grants so far have left: for the users of such
    batches rounds are run until these sums stand, each round settling at least one more day.
    """
    spans = requests.groupBy("batch_id", "user_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo < hi")
    users = materialise(spans.select("user_id").distinct(), "fanout-users")
    earlier = None
    if not users.isEmpty():
        again = requests.join(users.withColumnRenamed("user_id", "_user"), F.col("user_id").eqNullSafe(F.col("_user")), "left_semi")
        before = Window.partitionBy("batch_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        while True:
            days = _fanout_round(again, earlier, p).groupBy("batch_id", "day").agg(
                F.sum("granted").alias("_sum"), F.max("_earlier").alias("_was"))
            sums = days.withColumn("_now", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("bigint")))
            sums = materialise(sums.where("_now > 0 or _was > 0"), "fanout-days")
            if sums.where("_now <> _was").isEmpty():
                break
            earlier = sums.select("batch_id", "day", "_now")
    order, zero = ["ts", "request_id"], F.lit(0).cast("bigint")
    granted = _fanout_round(requests, earlier, p)
    offered = F.col("offered").cast("bigint")
    in_day = running_total(granted, ["batch_id", "day"], order, F.col("granted"), "_given")
    room_left = F.greatest(F.col("_room") - (F.col("_given") - F.col("granted")), zero)
    photos, fetches = _day_room(p)
    used = F.least(F.col("_demands") - F.col("_demand"), F.least(photos, fetches))
    bound = (
        F.when(F.col("granted") == F.least(offered, room_left), "photos_per_batch")
        .when(F.col("granted") == photos - used, "daily photos quota")
        .otherwise("daily fetches quota")
    )
    return in_day.withColumn("bound", F.when(F.col("granted") < offered, bound)).drop(
        "_demand", "_demands", "_given", "_room", "_earlier")


def _day_room(p: QuotaParams) -> tuple[Column, Column]:
    """Photos and fetches a day has left before its first request."""
    zero = F.lit(0).cast("bigint")
    return (F.greatest(F.lit(p.photos_per_day) - F.col("used_photos"), zero).cast("bigint"),
            F.greatest(F.lit(p.fetches_per_day) - F.col("used_fetches"), zero).cast("bigint"))


def _fanout_round(requests: DataFrame, earlier: DataFrame | None, p: QuotaParams) -> DataFrame:
    """Grants where ``earlier`` (batch_id, day, _now) tells what batches were given before a day; 0 for days not listed."""
    order, zero = ["ts", "request_id"], F.lit(0).cast("bigint")
    if earlier is None:
        known = requests.withColumn("_earlier", zero)
    else:
        sums = earlier.select(F.col("batch_id").alias("_batch"), F.col("day").alias("_on"), F.col("_now").alias("_earlier"))
        match = F.col("batch_id").eqNullSafe(F.col("_batch")) & F.col("day").eqNullSafe(F.col("_on"))
        known = requests.join(sums, match, "left").drop("_batch", "_on").withColumn("_earlier", F.coalesce("_earlier", zero))
    offered = F.col("offered").cast("bigint")
    room = F.greatest(F.lit(p.photos_per_batch) - F.col("in_batch") - F.col("_earlier"), zero).cast("bigint")
    roomy = known.withColumn("_room", room)
    per_batch = running_total(roomy, ["batch_id", "day"], order, offered, "_offers")
    asked = per_batch.withColumn("_demand", _clamped(F.col("_offers"), offered, F.col("_room"))).drop("_offers")
    per_day = running_total(asked, ["user_id", "day"], order, F.col("_demand"), "_demands")
    return per_day.withColumn("granted", _clamped(F.col("_demands"), F.col("_demand"), F.least(*_day_room(p))))


def usage_daily(events: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Additive daily counters per user."""
    return events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in counters]
    )


DIMENSIONS = ("batches", "photos", "fetches")


def _same(columns: Sequence[str], prefix: str) -> Column:
    """Join condition of columns with their prefixed copies; NULL equals NULL."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns])


def quota_admit(requests: DataFrame, p: QuotaParams = QuotaParams(), strict_first: bool = False) -> DataFrame:
    """All-or-nothing admission over three daily counters; a refused request consumes nothing.

    Adds ``admitted`` and ``reason`` (the first counter that would overflow). The day's first request is let in
    whatever it asks for, unless ``strict_first``.

    Counters only grow, so of requests asking for the same amounts only the first few of a day can be admitted.
    Those few, at most the cap divided by the amount, decide the day's counters, and so the moment from which each
    amount no longer fits; every request is then only compared with that moment. An amount over its cap passes as
    the day's first request or never, so the list holds the first request and amounts within the caps, whatever else
    is asked for. A NULL amount is 0; a NULL user or day is a key like any other.
    """
    requests = requests.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in DIMENSIONS else c for c in requests.columns])
    caps = dict(zip(DIMENSIONS, (p.batches_per_day, p.photos_per_day, p.fetches_per_day)))
    keys, order = ["user_id", "day"], ["ts", "request_id"]
    fits = F.least(*[F.when(F.col(d) > 0, F.floor(F.lit(c) / F.col(d))) for d, c in caps.items()], F.lit(10**9))
    within = F.lit(True)
    for d, c in caps.items():
        within = within & (F.col(d) <= c)
    asking = requests.where(within & (F.greatest(*[F.col(d) for d in DIMENSIONS]) > 0))
    same = Window.partitionBy(*keys, *DIMENSIONS).orderBy(*order)
    most = max(caps.values()) + 1
    few = (
        asking.select(*keys, *order, *DIMENSIONS).withColumn("_nth", F.row_number().over(same))
        .where(F.col("_nth") <= most)  # cut before the shuffle
        .where(F.col("_nth") <= fits + 1)
    )
    entry = F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("request_id").cast("bigint").alias("request_id"),
                     *[F.col(d).cast("bigint").alias(d) for d in DIMENSIONS])
    opener = requests.groupBy(*keys).agg(F.min(entry).alias("_opener"))
    listed = few.groupBy(*keys).agg(F.collect_list(entry).alias("_few")).select(*[F.col(k).alias(f"_l_{k}") for k in keys], "_few")
    others = F.filter(F.coalesce("_few", F.array()), lambda x: x["request_id"] != F.col("_opener.request_id"))
    day = opener.join(listed, _same(keys, "_l_"), "left").select(
        *keys, "_opener", F.sort_array(F.concat(F.array("_opener"), others)).alias("_few"))
    state = F.struct(*[F.lit(0).cast("bigint").alias(d) for d in DIMENSIONS])
    log_type = "array<struct<ts:timestamp_ntz,request_id:bigint,batches:bigint,photos:bigint,fetches:bigint>>"
    start = F.struct(state.alias("used"), F.array().cast(log_type).alias("log"))

    def passes(used: Column, want: Column) -> Column:
        ok = F.lit(True)
        for d, c in caps.items():
            ok = ok & (used[d] + want[d] <= c)
        return ok

    def step(acc: Column, want: Column) -> Column:
        first = F.lit(False) if strict_first else (want["request_id"] == F.col("_opener.request_id"))
        after = F.struct(*[(acc["used"][d] + want[d]).alias(d) for d in DIMENSIONS])
        logged = F.struct(want["ts"].alias("ts"), want["request_id"].alias("request_id"), *[after[d].alias(d) for d in DIMENSIONS])
        return F.when(
            first | passes(acc["used"], want),
            F.struct(after.alias("used"), F.concat(acc["log"], F.array(logged)).alias("log")),
        ).otherwise(acc)

    ledger = day.select(
        *keys, "_opener",
        F.aggregate("_few", start, step, lambda acc: acc["log"]).alias("_log"),
    )
    # from which logged admission on does each counter have no room for these amounts?
    def full_at(d: str, cap: int) -> Column:
        entry = F.try_element_at(F.filter("_log", lambda x: x[d] + F.col(d) > cap), F.lit(1))
        return F.struct(entry["ts"].alias("ts"), entry["request_id"].alias("request_id"))

    full = [full_at(d, c).alias(f"_full_{d}") for d, c in caps.items()]
    ledger = ledger.select(*[F.col(k).alias(f"_l_{k}") for k in keys], "_opener", "_log")
    kinds = requests.select(*keys, *DIMENSIONS).distinct().join(ledger, _same(keys, "_l_")).select(
        *[F.col(k).alias(f"_k_{k}") for k in (*keys, *DIMENSIONS)], "_opener", *full
    )
    same_kind = _same((*keys, *DIMENSIONS), "_k_")
    here = F.struct("ts", "request_id")
    reason = F.lit(None).cast("string")
    for d, c in reversed(caps.items()):
        late = F.col(f"_full_{d}.ts").isNotNull() & (here > F.col(f"_full_{d}"))
        reason = F.when((F.col(d) > c) | late, d).otherwise(reason)
    if not strict_first:
        reason = F.when(F.col("request_id") == F.col("_opener.request_id"), F.lit(None).cast("string")).otherwise(reason)
    judged = requests.join(kinds, same_kind).withColumn("reason", reason)
    return judged.select(*requests.columns, "reason", F.col("reason").isNull().alias("admitted"))


# --- time-window rules: one ordered scan per key, state of fixed size -------------------------

def next_admitted(times: np.ndarray, recent: list[int], limits: Sequence[tuple[int, int]]) -> tuple[np.ndarray, list[int]]:
    """Positions admitted in ascending ``times``; ``recent`` holds the last admitted times of this key.

    ``limits`` are (most, window) pairs: at most ``most`` admitted within any ``window``. The search jumps from one
    admitted time to the next possible one, so refused rows cost nothing.
    """
    keep = max(m for m, _ in limits)
    out, pos = [], 0
    while pos < len(times):
        ready = max((recent[-m] + w for m, w in limits if len(recent) >= m), default=None)
        if ready is not None and times[pos] < ready:
            pos = int(np.searchsorted(times, ready, side="left"))
            continue
        out.append(pos)
        recent = (recent + [int(times[pos])])[-keep:]
        pos += 1
    return np.array(out, dtype=np.int64), recent


def next_touched(times: np.ndarray, last: int | None, gap: int) -> tuple[np.ndarray, int | None]:
    """Positions that move ``last``: more than ``gap`` after the position before; the first one opens the key."""
    out, pos = [], 0
    while pos < len(times):
        if last is not None:
            pos = max(pos, int(np.searchsorted(times, last + gap, side="right")))
            if pos >= len(times):
                break
        out.append(pos)
        last = int(times[pos])
        pos += 1
    return np.array(out, dtype=np.int64), last


def _picked_times(fold: Callable) -> Callable:
    def on_frame(pdf: pd.DataFrame, state):
        return fold(pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), state)

    return on_frame


def rate_limit(requests: DataFrame, key: str = "user_id", p: AuthParams = AuthParams()) -> DataFrame:
    """Admit at most so many per hour and per day and key, counting only admitted requests.

    After a pause of more than a day nothing is remembered, so a key's stretches between such pauses are scanned
    by different tasks.
    """
    limits = ((p.links_per_hour, HOUR), (p.links_per_day, DAY))
    fold = _picked_times(lambda times, recent: next_admitted(times, recent, limits))
    rows = with_runs(requests.select(key, "ts", "request_id"), key, timedelta(days=1))
    return ordered_scan(rows, [key, "run"], ["ts", "request_id"], "admitted", fold, list).drop("run")


def session_touch(requests: DataFrame, key: str = "user_id", every: timedelta = timedelta(hours=1)) -> DataFrame:
    """Mark the requests that advance a key's last-seen time, which happens at most once per ``every``.

    The first request after a longer pause always does, so the stretches between pauses are independent.
    """
    micros = int(every.total_seconds() * 1_000_000)
    fold = _picked_times(lambda times, last: next_touched(times, last, micros))
    rows = with_runs(requests.select(key, "ts", "request_id"), key, every)
    return ordered_scan(rows, [key, "run"], ["ts", "request_id"], "touched", fold, lambda: None).drop("run")


def idle_sessions(events: DataFrame, key: str = "user_id", gap: timedelta = timedelta(hours=2)) -> DataFrame:
    """Sessions closed by a pause of ``gap``: (key, session_start, session_end, events)."""
    slots = time_slots(events, key, gap, lambda pause, limit: pause >= limit)
    end = F.max("last") + F.make_dt_interval(secs=F.lit(gap.total_seconds()))
    return slots.groupBy(key, "run").agg(
        F.min("first").alias("session_start"), end.alias("session_end"), F.sum("n").alias("events")
    ).drop("run")
