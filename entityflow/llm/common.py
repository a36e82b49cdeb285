"""Small parts the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what separates words in every operator (a Java pattern).
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(df: DataFrame, **own: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` beside the operator's own columns, so that no name can clash."""
    whole = F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns]).alias("row")
    return df.select(whole, *[c.alias(name) for name, c in own.items()])


def unboxed(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns of the boxed rows again, ``changed`` ones replaced."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in names])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_key(doc_id: Column, text: Column) -> dict[str, Column]:
    """Two hashes that name a row by id and text and are never NULL; rows equal in both are one document."""
    return {"h1": F.xxhash64(doc_id, text), "h2": F.xxhash64(text, F.lit("text"), doc_id)}


def bounded(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most ``most`` bytes in ``column``; a longer row is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = end[at] - size[at]
        stop = max(at + 1, int(np.searchsorted(end, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
