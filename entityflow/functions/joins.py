"""Joins on keys that are often NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = 1024


def left_join_sparse(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str) -> DataFrame:
    """Left join in which rows with a NULL key are spread by another column.

    In a plain shuffled join all rows with a NULL key, which match nothing, meet in one task.
    """
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    salted = left.withColumn("_salt", F.when(missing, F.pmod(F.xxhash64(spread), F.lit(_SPREAD))).otherwise(0))
    # zero for every right row, but not a constant that the optimizer would take out of the join keys
    plain = right.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(1)))
    return salted.join(plain, [*keys, "_salt"], "left").drop("_salt")
