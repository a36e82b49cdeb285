"""Structured Streaming forms of the progress, completion, price, correction and admission jobs."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from entityflow.functions.ranking import first_n, newest
from entityflow.operators.index import fingerprint_rows
from entityflow.operators.prices import KEY
from entityflow.operators.quotas import DAY, HOUR, next_admitted, next_touched
from entityflow.params import AuthParams, HashParams, StateParams

HOUR_MS = 3_600_000
MESSAGE = "batch_id bigint, event string, photo_id string, card_id string"


_SEEN = ("photo_stored", "photo_done", "card_identified", "batch_complete")


class _Progress(StatefulProcessor):
    """Counters of one batch; forgotten when nothing has come for a while."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", ", ".join(f"{e} bigint" for e in _SEEN), self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now = list(self.counts.get()) if self.counts.exists() else [0] * len(_SEEN)
        for pdf in rows:
            found = pdf["event"].value_counts()
            now = [n + int(found.get(e, 0)) for n, e in zip(now, _SEEN)]
        self.counts.update(tuple(now))
        yield pd.DataFrame({"batch_id": [key[0]], **{e: [n] for e, n in zip(_SEEN, now)}})

    def close(self) -> None:
        pass


def progress_stream(messages: DataFrame, p: StateParams = StateParams()) -> DataFrame:
    """JSON messages (``value``) to live counters per batch, one row per batch with news. Use update mode. Counters of a
    batch without messages for ``p.idle_hours`` are forgotten."""
    m = messages.select(F.from_json("value", MESSAGE).alias("m")).select("m.batch_id", "m.event").where(F.col("batch_id").isNotNull())
    return m.groupBy("batch_id").transformWithStateInPandas(
        _Progress(int(p.idle_hours * HOUR_MS)), "batch_id bigint, " + ", ".join(f"{e} bigint" for e in _SEEN), "Update", "ProcessingTime")


def dedupe_items(items: DataFrame, keys: list[str], ts: str, horizon: str) -> DataFrame:
    """Redelivered keys within the horizon are ignored. (A watermark needs a time with zone.)"""
    timed = items.withColumn("_event_time", F.col(ts).cast("timestamp"))
    return timed.withWatermark("_event_time", horizon).dropDuplicatesWithinWatermark(keys).drop("_event_time")


_BUCKETS = 1024  # keys of the completion state: batches are worked on by the bucket
_PART = 256  # item ids of an open batch in one state value, about


class _Completion(StatefulProcessor):
    """The distinct terminal items of the open batches of a bucket, in maps by batch. Completion removes a batch's items
    and leaves a mark for a while. The items of one batch lie in parts of about ``_PART`` ids, so news rewrites little.

    A micro-batch is reduced to batches and new items by columns. Calls to the state are what costs: the first part lies
    beside the counters, and the marks of a micro-batch are one value.
    """

    def __init__(self, idle: int, fired: int):
        self.idle, self.after = idle, fired

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.terminal = handle.getMapState("terminal", "batch bigint, part int", "items array<string>", self.idle)
        self.open = handle.getMapState("open", "batch bigint", "done bigint, expected bigint, parts int, items array<string>", self.idle)
        self.fired = handle.getListState("fired", "batches array<bigint>", self.after)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([r[["batch_id", "expected", "item_id", "terminal"]] for r in rows])
        expected = pdf.groupby("batch_id", sort=True)["expected"].max()
        items = pdf.loc[pdf["terminal"], ["batch_id", "item_id"]].drop_duplicates().sort_values("batch_id", kind="stable")
        ids, batch = items["item_id"].to_numpy(), expected.index.to_numpy()
        at = np.searchsorted(items["batch_id"].to_numpy(), batch)
        ends = np.append(at[1:], len(ids))
        some_open, done = self.open.exists(), []
        fired = {b for value in self.fired.get() for b in value[0]} if self.fired.exists() else ()
        for b, want, lo, hi in zip(batch.tolist(), expected.tolist(), at.tolist(), ends.tolist()):
            n = 0 if b in fired else self._complete(b, want, ids[lo:hi], some_open)
            if n:
                done.append((b, n))
        if done:
            self.fired.appendValue(([b for b, _ in done],))
            found = pd.DataFrame(done, columns=["batch_id", "items"])
            yield found if key[0] >= 0 else found.assign(batch_id=pd.Series([None] * len(found), dtype="Int64"))

    def _complete(self, batch: int, expected: int, ids: np.ndarray, some_open: bool) -> int:
        """The items of a batch if it is complete with these; else 0, and the state is brought up to date."""
        before = self.open.getValue((batch,)) if some_open else None
        count, known, parts, first = before or (0, 0, 0, None)
        expected = max(expected, known)
        parts = parts or 1 + max(expected, len(ids)) // _PART
        by_part: dict[int, list[str]] = {0: []}
        for i in ids.tolist():
            by_part.setdefault(crc32(i.encode()) % parts if parts > 1 else 0, []).append(i)
        held = {0: list(first or ())}
        for part, new in by_part.items():
            if part:
                old = self.terminal.getValue((batch, part)) if before else None
                held[part] = list(old[0]) if old else []
            seen = set(held[part])
            by_part[part] = [i for i in new if i not in seen]
        count += sum(map(len, by_part.values()))
        if 0 < expected <= count:
            if before:
                self.open.removeKey((batch,))
                for part in range(1, parts):
                    self.terminal.removeKey((batch, part))
            return count
        for part, new in by_part.items():
            if part and new:
                self.terminal.updateValue((batch, part), (held[part] + new,))
        self.open.updateValue((batch,), (count, expected, parts, held[0] + by_part[0]))
        return 0

    def close(self) -> None:
        pass


def completion_stream(items: DataFrame, p: StateParams = StateParams()) -> DataFrame:
    """(batch_id, expected, item_id, terminal) to one completion row per batch, the first time all of its expected items
    are terminal. Items count once however often they are delivered, as their ids are kept until the batch is complete.

    A batch without news for ``p.idle_hours`` is forgotten; a complete one is remembered for ``p.fired_hours``, in which
    late deliveries are ignored. Rows without a batch are one batch.
    """
    b = F.col("batch_id").cast("bigint")
    named = items.select(
        # rows without a batch have a bucket of their own, so that ids stay whole numbers
        F.when(b.isNull(), -1).otherwise(F.pmod(F.xxhash64(b), F.lit(_BUCKETS))).cast("int").alias("bucket"),
        F.coalesce(b, F.lit(0).cast("bigint")).alias("batch_id"), F.coalesce(F.col("expected").cast("bigint"), F.lit(0).cast("bigint")).alias("expected"),
        F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item_id"), F.coalesce("terminal", F.lit(False)).alias("terminal"))
    return named.groupBy("bucket").transformWithStateInPandas(
        _Completion(int(p.idle_hours * HOUR_MS), int(p.fired_hours * HOUR_MS)), "batch_id bigint, items bigint", "Append", "ProcessingTime")


def price_changes(observations: DataFrame) -> DataFrame:
    """The newest observation per (ref, variant) of one micro-batch; NULL prices are kept."""
    rows = observations.select(*KEY, F.col("cents").alias("price_cents"), "source", "observed_at", "obs_id")
    return newest(rows, KEY, ["observed_at", "obs_id"])


def correction_changes(corrections: DataFrame, p: HashParams = HashParams()) -> dict[str, DataFrame]:
    """The two outputs of one micro-batch of corrections (card_id, crop_hash, predicted_ref_id, actual_ref_id, created_at,
    coef): ``log`` rows, and ``fingerprints``, cut to what the cap can ever keep before any is computed."""
    log = corrections.select("card_id", "crop_hash", "predicted_ref_id", "actual_ref_id", "created_at")
    order = [F.desc("created_at"), F.desc("row_id")]
    rows = corrections.select(
        F.col("actual_ref_id").alias("ref_id"), F.lit("user_validated").alias("source"), "created_at", F.col("card_id").alias("row_id"), "coef")
    kept = first_n(rows, ["ref_id"], order, p.user_validated_cap).drop("rn")
    return {"log": log, "fingerprints": fingerprint_rows(kept)}


class _Marking(StatefulProcessor):
    """Marks the rows of a key that ``fold(times, memory) -> (positions, memory)`` picks; the memory lives for ``ttl``."""

    def __init__(self, flag: str, fold, schema: str, ttl: int):
        self.flag, self.fold, self.schema, self.ttl = flag, fold, schema, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", self.schema, self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        times = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        picked, memory = self.fold(times, self.memory.get()[0] if self.memory.exists() else None)
        marks = np.zeros(len(pdf), dtype=bool)
        marks[picked] = True
        self.memory.update((memory,))
        yield pdf.assign(**{self.flag: marks})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, p: AuthParams = AuthParams()) -> DataFrame:
    """Stream form of the rate limit on (key, ts, request_id); the state is the last admitted times of a key, and is gone
    a day after the last.

    A micro-batch must hold only requests later than those of the batches before it; its size (files or offsets
    per trigger) bounds what one key can bring at a time.
    """
    limits = ((p.links_per_hour, HOUR), (p.links_per_day, DAY))

    def fold(times, recent):
        return next_admitted(times, [int(t) for t in recent] if recent is not None else [], limits)

    return requests.select("key", "ts", "request_id").groupBy("key").transformWithStateInPandas(
        _Marking("admitted", fold, "recent array<bigint>", 24 * HOUR_MS),
        "key bigint, ts timestamp_ntz, request_id bigint, admitted boolean", "Append", "ProcessingTime")


def session_touch_stream(requests: DataFrame, every: int = HOUR) -> DataFrame:
    """Stream form of the hourly touch; the state is the last touch of a key, and is gone after ``every``."""

    def fold(times, last):
        return next_touched(times, None if last is None else int(last), every)

    return requests.select("key", "ts", "request_id").groupBy("key").transformWithStateInPandas(
        _Marking("touched", fold, "last bigint", every // 1000),
        "key bigint, ts timestamp_ntz, request_id bigint, touched boolean", "Append", "ProcessingTime")


def idle_session_stream(events: DataFrame, gap: str, lateness: str, key: str = "user_id") -> DataFrame:
    """Stream form of idle sessions; a session is emitted once the watermark has passed its end."""
    timed = events.withColumn("_event_time", F.col("ts").cast("timestamp")).withWatermark("_event_time", lateness)
    return timed.groupBy(F.session_window("_event_time", gap), F.col(key)).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events"
    )
