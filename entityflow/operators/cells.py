"""Exact nearest points by cosine, routed by bounds.

Points lie in cells round pivots, each with its largest angle to the pivot. No point of a cell is nearer to a query than
the query's angle to the pivot less that radius. Every query is answered in the cell of its nearest pivot first; its kth
similarity there then rules out all cells whose bound is below it, and the query goes to the others only.

Pivots are points drawn by hash, at most ``most``, so the driver holds a table of bounded size. A large cell is cut into
blocks and a much-asked one into chunks of queries, so no task holds more than ``block`` rows of either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.ranking import first_n
from entityflow.sources.storage import materialise

_SIMS = 400_000  # similarities of a tile: four arrays of 8 bytes each
_SLACK = 1e-6  # of an angle, for rounding
_DIGITS = 12  # of a similarity
_WIDE = 2_048  # points of a tile
_AGAIN = 8_192  # pairs multiplied again at a time
_TOPS = 32  # groups of points for each of the nearest ones wanted


@dataclass(frozen=True)
class CellParams:
    rows: int = 4_096  # points of a cell, about
    most: int = 4_096  # cells
    block: int = 32_768  # points or queries of one group, about


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array(vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors], vectors.type).combine_chunks()
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=m, where=norm > 0)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


@dataclass
class Cells:
    """Stored points (point_id, ref_id, vector, cell), and of each cell the pivot, radius and number of points."""

    points: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.pivots)


def build(points: DataFrame, p: CellParams = CellParams()) -> Cells:
    """Deal points (point_id, ref_id, vector) to cells; rows without a vector take no part."""
    rows = points.where(F.col("vector").isNotNull()).select("point_id", "ref_id", "vector")
    n = rows.count()
    wanted = max(1, min(p.most, -(-n // p.rows)))
    if wanted == 1:
        return Cells(rows.withColumn("cell", F.lit(0)), np.zeros((1, 1)), np.array([np.pi]), np.array([n]))
    drawn = rows.orderBy(F.xxhash64("point_id"), "point_id").limit(wanted).select("vector").toArrow()  # at most ``most``
    pivots = unit_rows(drawn.column("vector"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _angles(unit_rows(batch.column("vector")), pivots)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell])], [*batch.schema.names, "cell", "angle"])

    dealt = rows.mapInArrow(run, ", ".join([*(f"{k} {v}" for k, v in types.items()), "cell int, angle double"]))
    dealt = materialise(dealt, "cells")
    radius, count = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():  # a row per cell
        radius[r.cell], count[r.cell] = r.a, r.n
    return Cells(dealt.drop("angle"), pivots, radius, count)


def home(queries: DataFrame, cells: Cells) -> DataFrame:
    """(item_id, vector, cell): the cell of each query's nearest pivot that has points."""
    return _routed(queries.select("item_id", "vector"), cells, None)


def others(queries: DataFrame, cells: Cells) -> DataFrame:
    """(item_id, vector, cell): the further cells that can hold a point as near as ``kth`` of queries (item_id, vector,
    cell, kth)."""
    return _routed(queries.select("item_id", "vector", "cell", "kth"), cells, "kth")


def _routed(queries: DataFrame, cells: Cells, kth: str | None) -> DataFrame:
    pivots, radius, held = cells.pivots, cells.radius, cells.count > 0
    types = {f.name: f.dataType.simpleString() for f in queries.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, _SIMS // len(pivots))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                far = _angles(unit_rows(part.column("vector")), pivots)
                if kth is None:
                    cell = np.where(held, far, np.inf).argmin(axis=1)
                    row = np.arange(len(cell))
                else:
                    bound = np.cos(np.maximum(0.0, far - radius - _SLACK))
                    able = (bound >= part.column(kth).to_numpy()[:, None] - 1e-9) & held
                    able[np.arange(len(far)), part.column("cell").to_numpy()] = False
                    row, cell = np.nonzero(able)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(row)), part.column("vector").take(pa.array(row)), pa.array(cell, pa.int32())],
                    ["item_id", "vector", "cell"])

    return queries.mapInArrow(run, f"item_id {types['item_id']}, vector {types['vector']}, cell int")


def _best(r: np.ndarray, c: np.ndarray, s: np.ndarray, take: int) -> tuple[np.ndarray, ...]:
    """Of (row, point, similarity) the ``take`` highest of each row, ties to the first point."""
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < take
    return r[keep], c[keep], s[keep]


def _reaching(q: np.ndarray, p: np.ndarray, take: int) -> tuple[np.ndarray, ...]:
    """(row, point, similarity) of some points that hold each row's ``take`` nearest; rows and points have no NaN.

    Tiles are multiplied as 32-bit numbers. Of a tile only the points are looked at that reach, but for rounding, the
    ``take``-th highest of the maxima of its groups, or of an earlier tile's: no fewer points reach that. Those few are
    multiplied again as they are."""
    slack = 4 * (p.shape[1] + 4) * 2.0 ** -24 + 2 * 10.0 ** -_DIGITS  # both sides of a comparison err by half of that at most
    floor, found, groups, short = np.full(len(q), -np.inf), [], _TOPS * take, q.astype(np.float32)
    for at in range(0, len(p), _WIDE):
        sims = short @ p[at:at + _WIDE].astype(np.float32).T
        n, tops = sims.shape[1], sims
        if n >= 2 * groups:
            tops = sims[:, : n // groups * groups].reshape(len(sims), -1, groups).max(axis=1)
        if n >= take:
            floor = np.maximum(floor, np.partition(tops, tops.shape[1] - take, axis=1)[:, tops.shape[1] - take])
        # (compared as 32-bit numbers, so the bound is rounded downwards)
        least = np.nextafter((floor - slack).astype(np.float32), np.float32(-np.inf))
        r, c = np.divmod(np.flatnonzero(sims >= least[:, None]), n)
        s = np.empty(len(r))
        for lo in range(0, len(r), _AGAIN):
            part = slice(lo, lo + _AGAIN)
            s[part] = (q[r[part]] * p[c[part] + at]).sum(axis=1)
        found.append(_best(r, c + at, np.round(s, _DIGITS), take))
    return tuple(np.concatenate(x) for x in zip(*found))


def _of_all(q: np.ndarray, p: np.ndarray, take: int) -> tuple[np.ndarray, ...]:
    """The same where a component may be no number."""
    sims = np.round(q @ p.T, _DIGITS)
    floor = np.partition(sims, len(p) - take, axis=1)[:, len(p) - take]
    r, c = np.nonzero(sims >= floor[:, None])
    return r, c, sims[r, c]


def _nearest(k: int):
    def kernel(queries: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("point_id")
        r, c, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(queries) and len(points):
            p, q = unit_rows(points.column("vector")), unit_rows(queries.column("vector"))
            finite = bool(np.isfinite(p).all() and np.isfinite(q).all())
            among, wide = (_reaching, min(len(p), _WIDE)) if finite else (_of_all, len(p))
            take, step, parts = min(k, len(p)), max(1, _SIMS // wide), []
            for lo in range(0, len(q), step):
                # rounding makes equal points equal whatever tile the product is computed in
                r, c, s = _best(*among(q[lo:lo + step], p, take), take)
                parts.append((r + lo, c, s))
            r, c, s = (np.concatenate(x) for x in zip(*parts))
        return pa.table({
            "item_id": queries.column("item_id").take(pa.array(r)), "point_id": points.column("point_id").take(pa.array(c)),
            "ref_id": points.column("ref_id").take(pa.array(c)), "sim": s,
        })

    return kernel


def _numbered(counts: dict[int, int], block: int, default: int = 1) -> Column:
    """Pieces per cell, from a table of the cells that need more than one."""
    many = [(c, -(-n // block)) for c, n in counts.items() if n > block]
    if not many:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in many for x in pair])
    return F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(default))


def _pieces(df: DataFrame, own: str, n_own: Column, other: str, n_other: Column, key: str) -> DataFrame:
    """Each row in one piece of its own side and in every piece of the other."""
    placed = df.withColumn(own, F.pmod(F.xxhash64(key), n_own).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), n_other - 1)))


def search(routed: DataFrame, cells: Cells, k: int, p: CellParams = CellParams(), asked: dict[int, int] | None = None) -> DataFrame:
    """(item_id, point_id, ref_id, sim): the ``k`` nearest points in every cell a query was sent to."""
    if asked is None:
        asked = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}  # a row per cell
    chunks, blocks = _numbered(asked, p.block), _numbered(dict(enumerate(cells.count.tolist())), p.block)
    group = ["cell", "_chunk", "_block"]
    types = {f.name: f.dataType.simpleString() for d in (routed, cells.points) for f in d.schema}
    return (
        _pieces(routed, "_chunk", chunks, "_block", blocks, "item_id").groupBy(*group)
        .cogroup(_pieces(cells.points, "_block", blocks, "_chunk", chunks, "point_id").groupBy(*group))
        .applyInArrow(
            _nearest(k), f"item_id {types['item_id']}, point_id {types['point_id']}, ref_id {types['ref_id']}, sim double")
    )


def top(queries: DataFrame, points: DataFrame, k: int, p: CellParams = CellParams()) -> tuple[DataFrame, DataFrame | None]:
    """The ``k`` nearest points of each query (item_id, vector) with their rank ``rn``, and where more than one cell there
    is, (item_id, cell) of the further cells visited."""
    cells = build(points, p)
    asked = queries.where(F.col("vector").isNotNull()).select("item_id", "vector")
    order = [F.desc("sim"), F.asc("point_id")]
    if len(cells) == 1:
        slots = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = asked.count()
        # one cell: queries are spread over the slots, but not cut finer than pays
        spread = max(-(-n // p.block), min(slots, n // 1024), 1)
        own = search(asked.withColumn("cell", F.lit(0)), cells, k, CellParams(p.rows, p.most, -(-n // spread) or 1), {0: n})
        return first_n(own, ["item_id"], order, k), None
    sent = materialise(home(asked, cells), "cells-home")
    first = materialise(first_n(search(sent, cells, k, p), ["item_id"], order, k).drop("rn"), "cells-first")
    kth = first.groupBy("item_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(-2.0).alias("kth"))
    further = materialise(others(sent.join(kth, "item_id"), cells), "cells-others")
    second = search(further, cells, k, p)
    return first_n(first.unionByName(second), ["item_id"], order, k), further.select("item_id", "cell")
