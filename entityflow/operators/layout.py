"""Item outlines found on a photo: union of detector passes, overlap removal, reading order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.ranking import first_n
from entityflow.functions.scan import ordered_scan

CORNERS = [f"{axis}{i}" for i in range(4) for axis in "xy"]
CENTROID_FRACTION = 0.25
ROW_BAND = 0.15


def union_passes(*passes: DataFrame) -> DataFrame:
    """All outlines of several detector passes; of identical ones the earliest pass and position stays."""
    rows = passes[0].withColumn("pass", F.lit(0))
    for i, df in enumerate(passes[1:], 1):
        rows = rows.unionByName(df.withColumn("pass", F.lit(i)))
    return rows.groupBy("photo_id", *CORNERS).agg(F.min(F.struct("pass", "position")).alias("_at")).select(
        "photo_id", "_at.pass", "_at.position", *CORNERS
    )


_LOOPED = 64  # kept outlines up to which plain numbers are compared


def _geometry(pdf: pd.DataFrame) -> np.ndarray:
    """Centre and mean edge of every outline."""
    q = pdf[CORNERS].to_numpy(dtype=np.float64).reshape(len(pdf), 4, 2)
    edges = np.linalg.norm(q - np.roll(q, -1, axis=1), axis=2).mean(axis=1)
    return np.column_stack([q.mean(axis=1), edges])


def _keep_apart(outlines: np.ndarray, kept: list[list[float]]):
    out = []
    for i, (x, y, e) in enumerate(outlines.tolist()):
        if len(kept) > _LOOPED:
            known = np.array(kept)
            near = (np.hypot(known[:, 0] - x, known[:, 1] - y) < CENTROID_FRACTION * 0.5 * (e + known[:, 2])).any()
        else:
            near = any(math.hypot(a - x, b - y) < CENTROID_FRACTION * 0.5 * (e + f) for a, b, f in kept)
        if not near:
            kept.append([x, y, e])
            out.append(i)
    return out, kept


def drop_near(quads: DataFrame) -> DataFrame:
    """Greedy in (pass, position) order: drop an outline whose centre is closer to a kept one's than a quarter
    of their mean edge.

    The state of a photo is its kept outlines, whose number the photo's area bounds. Feed it from
    ``union_passes``, which has removed identical outlines already.
    """
    order = ["pass", "position"]
    marked = ordered_scan(quads.select("photo_id", *order, *CORNERS), ["photo_id"], order, "kept", _keep_apart, list, _geometry)
    return marked.where("kept").drop("kept")


def _mean(axis: str) -> Column:
    total = F.col(f"{axis}0")
    for i in range(1, 4):
        total = total + F.col(f"{axis}{i}")
    return total / F.lit(4.0)


def reading_order(quads: DataFrame, most: int = 30) -> DataFrame:
    """Ordinal by row band, then left to right; the first ``most`` of a photo stay. Needs the photo's ``height``."""
    band = F.floor(_mean("y") / (F.col("height") * F.lit(ROW_BAND)))
    ordered = first_n(
        quads.withColumn("_band", band).withColumn("_cx", _mean("x")), ["photo_id"],
        [F.col("_band"), F.col("_cx"), *[F.col(c) for c in CORNERS]], most,
    )
    return ordered.withColumn("ordinal", F.col("rn") - 1).drop("rn", "_band", "_cx")
