"""First rows per key and running totals that stay whole when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.sources.storage import materialise

# Spark prunes `row_number() <= n` before the shuffle only up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT = 1000
_SALTS = 64


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key with their rank.

    Small ``n``: Spark keeps n rows per key and task before the shuffle. Large ``n``: the same cut is made
    per (key, salt) first, so a hot key is ranked by many tasks and only n rows of each reach the last one.
    """
    row = F.row_number()
    if n > _GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)))
        local = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_local", row.over(local)).where(F.col("_local") <= n).drop("_local", "_salt")
    return df.withColumn(rank, row.over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def newest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest version. Partial aggregation runs before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def oldest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` (whole numbers, NULL counts 0) per key in ``order``, as column ``name``.

    Two levels: rows are dealt once, by ranges of (key, order), so a key of any size lies in consecutive parts; each part
    is summed along as it streams. A key that goes on from one part into the next gets what the parts before hold of it:
    at most one key per part does, so these offsets are no more rows than there are parts. NULL keys are one key.
    """
    keys, by = list(keys), [*keys, *order]
    ranged = df.withColumn("_v", F.coalesce(value.cast("bigint"), F.lit(0))).repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n, fresh = batch.num_rows, np.zeros(batch.num_rows, bool)
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                fresh[1:] |= codes[1:] != codes[:-1]
            fresh[0] = held != [batch.column(k)[0].as_py() for k in keys]
            sums = np.cumsum(batch.column("_v").to_numpy())
            opens = np.flatnonzero(fresh)
            before = np.concatenate([[0], sums])[opens]  # all of the batch ahead of each key's first row
            group = np.cumsum(fresh)
            run = sums - np.concatenate([[-total], before])[group]
            held, total = [batch.column(k)[n - 1].as_py() for k in keys], int(run[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(run, pa.int64())], [*batch.schema.names, "_part", "_run"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    rows = materialise(ranged.mapInArrow(run, f"{kinds}, _part int, _run bigint"), "running")
    along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_part").agg(F.sum("_v").alias("_sum"))
    starts = sums.withColumn("_start", F.sum("_sum").over(along)).where(F.col("_start") != 0).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_kpart"), "_start")
    match = F.col("_part") == F.col("_kpart")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        rows.join(F.broadcast(starts), match, "left")  # fewer rows than parts
        .withColumn(name, F.col("_run") + F.coalesce("_start", F.lit(0)))
        .drop("_v", "_part", "_run", "_start", "_kpart", *[f"_k{i}" for i in range(len(keys))])
    )
