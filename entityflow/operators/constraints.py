"""Checks standing in for key, reference, value and not-null constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.schemas import Table


def _text(columns: Sequence[str]):
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys held by several rows; a key with a NULL part collides with nothing."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    counted = df.where(whole).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return counted.select(F.lit("unique " + ",".join(columns)).alias("rule"), _text(columns).alias("value"), "rows")


def orphan_values(df: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Values of a reference without a parent row; equal values are collapsed before the join."""
    used = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    missing = used.join(parents.select(F.col(parent_key).alias(column)), column, "left_anti")
    return missing.select(F.lit("reference " + column).alias("rule"), F.col(column).cast("string").alias("value"), "rows")


def bad_values(df: DataFrame, table: Table) -> DataFrame:
    """NULLs in required columns and values outside their list, counted in one pass over the rows."""
    faults = [
        F.when(F.col(c).isNull(), F.struct(F.lit("required " + c).alias("rule"), F.lit(None).cast("string").alias("value")))
        for c in (*table.key, *table.required)
    ] + [
        F.when(~F.col(c).isin(*values), F.struct(F.lit("allowed " + c).alias("rule"), F.col(c).cast("string").alias("value")))
        for c, values in table.allowed.items()
    ]
    found = df.select(F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return found.groupBy("rule", "value").agg(F.count(F.lit(1)).alias("rows"))


def violations(df: DataFrame, table: Table, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(rule, value, rows) of everything in ``df`` that breaks the table's constraints.

    References are checked against the parent tables that are given.
    """
    out = bad_values(df, table)
    for columns in (table.key, *table.unique):
        out = out.unionByName(duplicate_keys(df, columns))
    for column, (parent, key) in table.references.items():
        if parents and parent in parents:
            out = out.unionByName(orphan_values(df, column, parents[parent], key))
    return out
