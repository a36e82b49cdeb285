"""Clustering of integer vectors by bit planes.

Components become integers, and bit j of a vector's 64 components becomes one unsigned 64-bit word, plane j, in two's
complement: the top plane weighs -2 ** j. The product of a vector and a centroid is the sum over their planes of weight
times weight times the set bits both words share, so distances are exact integers made of ANDs and bit counts alone.
Vectors are stored as their planes once; every round reads them, assigns each to its nearest centroid, and adds up the
centroids' components per batch, before the shuffle. The driver holds the ``k`` centroids and nothing else.

Edge cases: vectors that are NULL, of another length than 64, or with a NULL or non-finite component take no part; a NULL
id is an id (its hash is that of the prefix alone); repeated rows count each; fewer vectors than ``k`` give as many
centroids; equal distances go to the smaller centroid, equal hashes to the smaller planes; a centroid without vectors
stays; an empty table gives an empty result; other columns are not read. Components of 2 ** 27 or more are refused with
an error, as squared distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.sources.storage import materialise

WIDTH = 64  # components of a vector, bits of a plane
_MOST = 27  # bits of a component's size
_ROWS = 4096  # vectors compared at a time


@dataclass(frozen=True)
class KMeansParams:
    k: int = 8
    rounds: int = 10
    scale: int = 1024  # a component x becomes floor(scale * x)
    prefix: str = "3:"  # of an id, when vectors are drawn as first centroids by hash


def to_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits) words of (rows, 64) integers from -2 ** (bits - 1) on."""
    planes = [np.packbits(((x >> j) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for j in range(bits)]
    return np.concatenate(planes, axis=1)


def from_planes(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(planes), WIDTH), np.int64)
    for w, plane in zip(weights(planes.shape[1]), planes.T):
        bits = np.unpackbits(np.ascontiguousarray(plane)[:, None].view(np.uint8), axis=1, bitorder="little")
        out += w * bits.astype(np.int64)
    return out


def weights(bits: int) -> list[int]:
    return [*[1 << j for j in range(bits - 1)], -(1 << (bits - 1))]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the vectors of two sets of planes: (rows of a, rows of b)."""
    own, other = weights(a.shape[1]), weights(b.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, len(a), _ROWS):
        part = a[at : at + _ROWS]
        for i, wi in enumerate(own):
            for j, wj in enumerate(other):
                out[at : at + _ROWS] += (wi * wj) * np.bitwise_count(part[:, i, None] & b[None, :, j]).astype(np.int64)
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """The squared lengths."""
    w, out = weights(planes.shape[1]), np.zeros(len(planes), np.int64)
    for i in range(len(w)):
        for j in range(i + 1):
            out += (w[i] * w[j] * (1 if i == j else 2)) * np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, and the squared distance to it."""
    far = squares(planes)[:, None] + squares(centroids)[None, :] - 2 * products(planes, centroids)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def _words(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, bits)


def packed(df: DataFrame, vec_id: Column, vector: Column, p: KMeansParams = KMeansParams()) -> tuple[DataFrame, int]:
    """Stored rows (vec_id, draw, planes) of the sound vectors, and the number of planes. ``draw`` is the id's hash."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = (F.size(vector) == WIDTH) & F.forall(doubles, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    digest = F.sha2(F.concat(F.lit(p.prefix), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)
    rows = df.select(vec_id.alias("vec_id"), digest.alias("draw"), doubles.alias("v")).where(F.coalesce(sound, F.lit(False)))
    least, most = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, high = (np.floor(p.scale * x) if x is not None else 0 for x in (least, most))
    if max(-low - 1, high) >= 1 << _MOST:
        raise ValueError(f"components times {p.scale} must stay below 2 ** {_MOST}")
    bits = max(int(max(-low - 1, high, 0)).bit_length(), 1) + 1
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, WIDTH)
            words = to_planes(np.floor(p.scale * x).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("draw"), pa.array([w.tobytes() for w in words], pa.binary())], ["vec_id", "draw", "planes"])

    return materialise(rows.mapInArrow(run, f"vec_id {kind}, draw string, planes binary"), "planes"), bits


def _sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, at, n, total) of one round: the vectors of each cluster and the sum of their component ``at``."""
    bits = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words(batch.column("planes"), bits)
            best, _ = nearest(words, centroids)
            x = from_planes(words)
            used = np.unique(best)
            total = [x[best == c].sum(axis=0) for c in used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(np.bincount(best)[used], pa.int64()), pa.array(total, pa.list_(pa.int64()))],
                ["cluster", "n", "total"])

    part = rows.select("planes").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    each = part.select("cluster", "n", F.posexplode("total").alias("at", "x"))
    return each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))


def kmeans(df: DataFrame, vec_id: Column, vector: Column, p: KMeansParams = KMeansParams()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every sound vector; ``centroid`` is the cluster's
    final integer components."""
    rows, bits = packed(df, vec_id, vector, p)
    drawn = rows.orderBy("draw", "planes").limit(p.k).select("planes").collect()  # k rows
    centroids = np.frombuffer(b"".join(r.planes for r in drawn), "<u8").reshape(-1, bits)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if len(centroids):
        for _ in range(p.rounds):
            now = from_planes(centroids)
            for r in _sums(rows, centroids).collect():  # k * 64 rows
                now[r.cluster, r.at] = int(r.total) // r.n
            moved = to_planes(now, bits)
            if np.array_equal(moved, centroids):  # every later round would be the same
                break
            centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far = nearest(_words(batch.column("planes"), bits), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = rows.select("vec_id", "planes").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")
    placed = materialise(placed, "clusters")
    found = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    per = [(c, found[c], sum(found.values()), x) for c, x in enumerate(from_planes(centroids).tolist()) if c in found]
    about = df.sparkSession.createDataFrame(per, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return placed.join(F.broadcast(about), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
