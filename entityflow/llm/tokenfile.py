"""Token ids in patched frame-of-reference blocks.

A token folder holds two Parquet tables, so that Spark commits them and any store Spark reads will do:

* ``segments``: (part, segment, first, n_ids, doc_ids, lengths, data). Documents lie whole in one segment, in order;
  ``first`` counts the ids of the part before the segment, ``lengths`` the ids of each document.
* ``parts``: (part, start), the ids of all parts before each part. It is written last: a folder without it is unfinished.

``data`` is little-endian: the mark ``PFR1``, then as u8 the block size, the number of ids and the number of exceptions;
per block its minimum (u4), its width in bits (u1), the start of its packed bytes (u8) and of its exceptions (u8), the
last two with one more entry for the end; then per exception its position in the block (u4) and the bits of its value
beyond the width (u4); then the packed bytes. A block is stored as the differences to its minimum, each in the width that
holds the ``share`` of them (a percentile); the others are the exceptions. Any run of ids is read from the blocks that
cover it.

Texts are dealt by ranges of the id, with a hash of the text and a row number behind it, so that many rows of one id fall
into many tasks; each task tokenises its sorted rows and packs them as they come. Starts come from sums of the parts.

Edge cases: a NULL text is empty, an empty text is its end token alone; NULL ids come last; rows of one id are ordered by a
hash of the text, so equal rows are written each and are interchangeable; an empty table gives an empty folder; other
columns are not read. Memory is bounded by a segment and the longest document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entityflow.llm.common import bounded
from entityflow.llm.tokens import Encoder

_HEAD = "<4sQQQ"
_MARK = b"PFR1"
_CHUNK = 256  # blocks unpacked at a time


@dataclass(frozen=True)
class PforParams:
    block: int = 1024  # ids
    share: float = 0.95  # of a block's ids that its width holds
    segment: int = 1 << 18  # ids of a segment, about
    end_id: int = 2


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)  # exact below 2 ** 53


def _lane(width: int) -> str:
    """The smallest kind of number that holds ``width`` bits."""
    return "u1" if width <= 8 else "<u2" if width <= 16 else "<u4"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, row by row: (rows, bytes)."""
    kind, n = _lane(width), values.shape[1]
    out = np.empty((len(values), -(-n * width // 8)), np.uint8)
    for at in range(0, len(values), _CHUNK):
        part = values[at : at + _CHUNK].astype(kind)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), n, -1), axis=2, bitorder="little")[:, :, :width]
        out[at : at + _CHUNK] = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
    return out


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    kind = _lane(width)
    out = np.empty((len(packed), n), "<u4")
    for at in range(0, len(packed), _CHUNK):
        part = packed[at : at + _CHUNK]
        bits = np.zeros((len(part), n, 8 * np.dtype(kind).itemsize), np.uint8)
        bits[:, :, :width] = np.unpackbits(part, axis=1, count=n * width, bitorder="little").reshape(len(part), n, width)
        out[at : at + _CHUNK] = np.packbits(bits, axis=2, bitorder="little").view(kind)[:, :, 0]
    return out


def pack_ids(ids: np.ndarray, p: PforParams = PforParams()) -> bytes:
    """One segment's ``data``."""
    ids = np.asarray(ids, np.uint32)
    full = len(ids) // p.block * p.block
    groups = [g for g in (ids[:full].reshape(-1, p.block), ids[full:].reshape(1, -1)) if g.size]
    least, widths, sizes, counts, where, high, payload = [], [], [], [], [], [], []
    for rows in groups:
        n = rows.shape[1]
        low = rows.min(axis=1)
        delta = rows - low[:, None]
        kth = max(0, int(np.ceil(p.share * n)) - 1)
        width = _bit_length(np.partition(delta, kth, axis=1)[:, kth])
        over = (delta.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
        block, position = np.nonzero(over)
        nbytes = -(-n * width // 8)
        start = np.cumsum(nbytes) - nbytes
        packed = np.zeros(int(nbytes.sum()), np.uint8)
        for w in np.unique(width[width > 0]):
            own = np.flatnonzero(width == w)
            packed[start[own][:, None] + np.arange(nbytes[own[0]])] = _pack(delta[own], int(w))
        least.append(low)
        widths.append(width.astype(np.uint8))
        sizes.append(nbytes)
        counts.append(np.bincount(block, minlength=len(rows)))
        where.append(position.astype("<u4"))
        high.append(over[block, position].astype("<u4"))
        payload.append(packed)

    def joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
        return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)

    def starts(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(joined(parts, "<u8"))]).astype("<u8")

    exceptions = starts(counts)
    return b"".join([
        struct.pack(_HEAD, _MARK, p.block, len(ids), int(exceptions[-1])), joined(least, "<u4").tobytes(), joined(widths, "u1").tobytes(),
        starts(sizes).tobytes(), exceptions.tobytes(), joined(where, "<u4").tobytes(), joined(high, "<u4").tobytes(),
        joined(payload, "u1").tobytes(),
    ])


def unpack_ids(data: bytes, start: int = 0, n: int | None = None) -> np.ndarray:
    """``n`` ids of a segment from ``start`` on (all to the end by default); only the blocks that hold them are unpacked."""
    mark, size, total, n_over = struct.unpack_from(_HEAD, data)
    if mark != _MARK:
        raise ValueError("not a block of token ids")
    stop = total if n is None else min(total, start + n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    blocks, at = -(-total // size), struct.calcsize(_HEAD)

    def field(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    least, width = field("<u4", blocks), field("u1", blocks)
    begin, over = field("<u8", blocks + 1).astype(np.int64), field("<u8", blocks + 1).astype(np.int64)
    where, high = field("<u4", n_over), field("<u4", n_over)
    payload = np.frombuffer(data, np.uint8, -1, at)
    lo, hi = start // size, -(-stop // size)
    delta = np.zeros((hi - lo, size), np.uint32)
    length = np.minimum(size, total - size * np.arange(lo, hi))
    for w, r in {(int(w), int(r)) for w, r in zip(width[lo:hi], length) if w}:
        own = np.flatnonzero((width[lo:hi] == w) & (length == r))
        rows = payload[begin[lo + own][:, None] + np.arange(-(-r * w // 8))]
        delta[own, :r] = _unpack(rows, w, r)
    first, last = over[lo], over[hi]
    block = np.repeat(np.arange(hi - lo), np.diff(over[lo : hi + 1]))
    lifted = high[first:last].astype(np.uint64) << width[lo:hi][block].astype(np.uint64)
    delta[block, where[first:last]] |= lifted.astype(np.uint32)
    flat = (delta + least[lo:hi, None]).reshape(-1)
    return flat[start - lo * size : stop - lo * size]


def _segments(ranged: DataFrame, vocabulary: str, p: PforParams) -> DataFrame:
    """Sorted rows (doc_id, text) of each partition to segments of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = Encoder.of_worker(vocabulary), np.array([p.end_id], np.uint32)
        part, segment, first, held = TaskContext.get().partitionId(), 0, 0, 0
        names: list[pa.Array] = []
        rows: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            owners = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([held], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners),
                 pa.array([[len(x) for x in rows]], pa.list_(pa.int64())), pa.array([pack_ids(np.concatenate(rows), p)], pa.binary())],
                ["part", "segment", "first", "n_ids", "doc_ids", "lengths", "data"])

        for batch in batches:
            for piece in bounded(batch):
                flat, starts = encoder.flat(piece.column("text"))
                done = 0
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist()), 1):
                    rows.append(np.concatenate([flat[a:b], end]))
                    held += b - a + 1
                    if held >= p.segment:
                        names.append(piece.column("doc_id").slice(done, i - done))
                        yield flush()
                        names.clear()
                        rows.clear()
                        segment, first, held, done = segment + 1, first + held, 0, i
                names.append(piece.column("doc_id").slice(done))
        if rows:
            yield flush()

    doc = ranged.schema["doc_id"].dataType.simpleString()
    return ranged.mapInArrow(
        run, f"part int, segment int, first bigint, n_ids bigint, doc_ids array<{doc}>, lengths array<bigint>, data binary")


def write_tokens(df: DataFrame, text: Column, doc_id: Column, vocabulary: str, path: str, p: PforParams = PforParams()) -> None:
    """Write a token folder of all rows in ascending ``doc_id``. ``vocabulary`` is a tokenizer file that every machine has
    at that path."""
    rows = df.select(doc_id.alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("doc_id", "text", *[c.alias(f"by{i}") for i, c in enumerate(order)])
    by = [f"by{i}" for i in range(len(order))]
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    _segments(ranged, vocabulary, p).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/segments")
    sums = df.sparkSession.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part, of which there are as many as Spark has range partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.mode("overwrite").parquet(f"{path}/parts")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The segments with the ids of the whole folder before each as ``start``."""
    segments, parts = spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/parts")
    return segments.join(parts, "part").withColumn("start", F.col("start") + F.col("first"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 [, ids]) of every document of a token folder."""
    placed = _placed(spark, path).select("start", "doc_ids", "lengths", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack_ids(batch.column("data")[i].as_py())
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                rows = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                cols = [batch.column("doc_ids")[i].values, pa.array(batch.column("start")[i].as_py() + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in rows], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.astype(np.int64) for x in rows], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    doc = placed.schema["doc_ids"].dataType.elementType.simpleString()
    extra = ", ids array<bigint>" if with_ids else ""
    return placed.mapInArrow(run, f"doc_id {doc}, start bigint, n_tokens bigint, ids_crc32 bigint{extra}")


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """(start, ids) pieces of the ids from ``start`` to ``start + n`` of the folder, from the blocks that hold them."""
    at, stop = F.col("start"), F.col("start") + F.col("n_ids")
    covering = _placed(spark, path).where((at < start + n) & (stop > start)).select("start", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [max(start, s) for s in batch.column("start").to_pylist()]
            ids = [unpack_ids(d.as_py(), f - s, start + n - f).astype(np.int64)
                   for d, s, f in zip(batch.column("data"), batch.column("start").to_pylist(), first)]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["start", "ids"])

    return covering.mapInArrow(run, "start bigint, ids array<bigint>")
