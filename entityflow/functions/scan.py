"""Ordered scan of each key with a small carried state, for rules that no window function can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.functions.clock import second_number


def time_slots(events: DataFrame, key: str, gap: timedelta, opens: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per key and ``gap``-wide slot: (key, slot, first, last, n, run).

    ``opens(pause, gap)`` tells whether a pause starts a new run. Rows of one slot are less than ``gap`` apart and
    so always share a run; they are reduced to one row before the shuffle, so the window sees few rows per key.
    """
    pause = F.make_dt_interval(secs=F.lit(gap.total_seconds()))
    slots = events.groupBy(key, slot_number(gap).alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")
    )
    along = Window.partitionBy(key).orderBy("slot")
    fresh = F.coalesce(opens(F.col("first") - F.lag("last").over(along), pause), F.lit(True))
    return slots.withColumn("_fresh", fresh).withColumn("run", F.count_if("_fresh").over(along)).drop("_fresh")


def slot_number(gap: timedelta) -> Column:
    return F.floor(second_number(F.col("ts")) / F.lit(int(gap.total_seconds())))


def with_runs(events: DataFrame, key: str, gap: timedelta) -> DataFrame:
    """Add ``run``: the stretch of a key's rows without a pause longer than ``gap``."""
    slots = time_slots(events, key, gap, lambda pause, limit: pause > limit).select(
        F.col(key).alias("_key"), F.col("slot").alias("_slot"), "run"
    )
    match = F.col(key).eqNullSafe(F.col("_key")) & (slot_number(gap) == F.col("_slot"))
    return events.join(slots, match).drop("_key", "_slot")


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, fold: Callable, start: Callable,
    prepare: Callable[[pd.DataFrame], np.ndarray] | None = None,
) -> DataFrame:
    """Mark the rows that ``fold(rows, state) -> (positions, state)`` picks, going through each key in order.

    Keys are hashed to partitions and sorted there (the sort spills); Arrow batches then stream through with only
    the current key's state carried from one to the next, so a long key is never held in memory. With ``prepare``, which
    turns a batch into an array with a row per row, ``fold`` gets rows of that array.
    """
    keys = list(keys)

    def key_at(pdf: pd.DataFrame, i: int) -> tuple:
        return tuple(None if pd.isna(v) else v for v in (pdf[k].iat[i] for k in keys))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, start()
        for pdf in batches:
            if not len(pdf):
                continue
            rows = pdf.iloc if prepare is None else prepare(pdf)
            codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            marks = np.zeros(len(pdf), dtype=bool)
            cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)]):
                if lo or key_at(pdf, 0) != current:  # only a batch's first key can go on from the one before
                    state = start()
                picked, state = fold(rows[lo:hi], state)
                marks[[lo + i for i in picked]] = True
            current = key_at(pdf, len(pdf) - 1)
            yield pdf.assign(**{flag: marks})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {flag} boolean"
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)
