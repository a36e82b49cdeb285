"""Exactly-once results of streams: a log of micro-batches with commits and compacted snapshots.

A micro-batch writes one or more outputs under its own number and then one commit row; what has no commit is not read. So
outputs of one micro-batch appear together or not at all, a repeated micro-batch that was committed is left alone, and one
that was not is written anew. No micro-batch ever rewrites what others wrote.

Commits lie in epochs of ``every`` micro-batches. A snapshot holds the newest row per key of all changes up to a number
and is committed in the epoch that follows it; readers take the last snapshot and the changes behind it, by path, so what
is read does not grow with the number of micro-batches. Where a snapshot was not finished, the epochs before are read too.

A log folder holds ``<output>/change=<n>``, ``<output>-snapshot/<id>`` and ``commits/<epoch>``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from entityflow.functions.ranking import newest

ROWS = "rows"  # the output of a log that has one
_COMMIT = "output string, change bigint, folder string"


@dataclass(frozen=True)
class Version:
    """What a reader sees of one output: a snapshot's folder and last change, and the committed changes behind it."""

    folder: str | None
    upto: int
    changes: tuple[int, ...]


@dataclass(frozen=True)
class ChangeLog:
    path: str
    every: int = 64  # micro-batches of an epoch

    def _commits(self, spark: SparkSession, epoch: int) -> list | None:
        """The commit rows of an epoch (at most ``every`` and a few snapshots), None where there is none."""
        try:
            return spark.read.schema(_COMMIT).json(f"{self.path}/commits/{epoch}").collect()
        except AnalysisException:
            return None

    def _last_epoch(self, spark: SparkSession) -> int:
        """The last epoch with a commit, -1 where there is none; found in steps that double, then halve."""
        if self._commits(spark, 0) is None:
            return -1
        step = 1
        while self._commits(spark, step) is not None:
            step *= 2
        low, high = step // 2, step
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._commits(spark, mid) is not None else (low, mid)
        return low

    def _commit(self, spark: SparkSession, epoch: int, rows: Sequence[tuple[str, int, str | None]]) -> None:
        spark.createDataFrame(list(rows), _COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits/{epoch}")

    def write(self, batch_id: int, outputs: Mapping[str, DataFrame]) -> None:
        """Write a micro-batch's outputs and commit them together."""
        spark, epoch = next(iter(outputs.values())).sparkSession, batch_id // self.every
        if any(r.change == batch_id and r.folder is None for r in self._commits(spark, epoch) or ()):
            return
        for before in range(epoch):  # epochs are found by number, so none is left out
            if before >= epoch - 1 and self._commits(spark, before) is None:
                self._commit(spark, before, [("", -1, None)])
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/change={batch_id}")
        self._commit(spark, epoch, [(name, batch_id, None) for name in outputs])

    def version(self, spark: SparkSession, output: str = ROWS) -> Version:
        changes: set[int] = set()
        for epoch in range(self._last_epoch(spark), -1, -1):
            rows = [r for r in self._commits(spark, epoch) or () if r.output == output]
            changes |= {r.change for r in rows if r.folder is None}
            held = max((r for r in rows if r.folder is not None), key=lambda r: r.change, default=None)
            if held is not None:
                return Version(held.folder, held.change, tuple(sorted(c for c in changes if c > held.change)))
        return Version(None, -1, tuple(sorted(changes)))

    def changes(self, spark: SparkSession, schema: StructType, output: str = ROWS, of: Version | None = None) -> DataFrame:
        """The committed changes behind the last snapshot, with their micro-batch number as ``change``."""
        at = of or self.version(spark, output)
        full = StructType([*schema.fields, StructField("change", LongType())])
        if not at.changes:
            return spark.createDataFrame([], full)
        paths = [f"{self.path}/{output}/change={n}" for n in at.changes]
        return spark.read.schema(full).option("basePath", f"{self.path}/{output}").parquet(*paths)

    def newest(self, spark: SparkSession, schema: StructType, keys: Sequence[str], order: Sequence[str] = (), output: str = ROWS) -> DataFrame:
        """The newest row per key: of the snapshot and the changes behind it."""
        at = self.version(spark, output)
        rows = self.changes(spark, schema, output, at)
        if at.folder is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(at.folder))
        return newest(rows, keys, [*order, "change"]).select(*schema.names)

    def compact(self, spark: SparkSession, schema: StructType, keys: Sequence[str], order: Sequence[str] = (), output: str = ROWS) -> None:
        """Write and commit a snapshot of all that is committed. Stopped before the commit, it changes nothing."""
        at = self.version(spark, output)
        if not at.changes:
            return
        rows = self.changes(spark, schema, output, at)
        if at.folder is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(at.folder))
        folder, upto = f"{self.path}/{output}-snapshot/{uuid.uuid4().hex}", at.changes[-1]
        newest(rows, keys, [*order, "change"]).select(*rows.columns).write.parquet(folder)
        self._commit(spark, (upto + 1) // self.every, [(output, upto, folder)])


def write_changes(df: DataFrame, batch_id: int, path: str) -> None:
    ChangeLog(path).write(batch_id, {ROWS: df})


def read_changes(spark: SparkSession, path: str, schema: StructType, output: str = ROWS) -> DataFrame:
    """All changes behind the last snapshot (all there are, if nothing was compacted) with their number as ``change``."""
    return ChangeLog(path).changes(spark, schema, output)


def read_newest(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    return ChangeLog(path).newest(spark, schema, keys, order)


def run_available(
    stream: DataFrame, path: str, reduce: Callable[[DataFrame], DataFrame | Mapping[str, DataFrame]] | None = None, mode: str = "append",
    after: Callable[[ChangeLog, int], None] | None = None, stateful: bool = False,
) -> StreamingQuery:
    """Process everything available, each micro-batch reduced to one output, or several by name, and written as one
    change, then stop. ``after`` is called with the log and the number of each micro-batch, to compact it for instance.
    ``stateful`` streams keep state by processing time, which would otherwise be looked after for ever."""
    log = ChangeLog(f"{path}/table")

    def write(df: DataFrame, batch_id: int) -> None:
        out = reduce(df) if reduce else df
        log.write(batch_id, out if isinstance(out, Mapping) else {ROWS: out})
        if after:
            after(log, batch_id)

    # state with maps and a time to live needs this store; and a run over what is there must not wait for state to expire
    needs = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(not stateful).lower(),
    }
    spark = stream.sparkSession
    before = {k: spark.conf.get(k) for k in needs}
    for k, v in needs.items():
        spark.conf.set(k, v)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
            .foreachBatch(write).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return query
