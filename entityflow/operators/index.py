"""Build, refresh and cap the fingerprint index and the vector table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from entityflow.functions.fingerprint import bits_from_coefficients, tier_coefficients
from entityflow.functions.ranking import first_n
from entityflow.functions.text import stable_id
from entityflow.functions.vectors import l2_normalise
from entityflow.operators.prices import upsert
from entityflow.params import TIERS, HashParams
from entityflow.sources.storage import materialise

GENERATED = ("reference", "augmented")


def fingerprint_rows(items: DataFrame) -> DataFrame:
    """(ref_id, coef) to the five tier fingerprints as rows; other columns are kept."""
    keep = [c for c in items.columns if c != "coef"]
    return items.select(*keep, F.posexplode(tier_coefficients(F.col("coef"))).alias("_t", "_c")).select(
        *keep, F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("_t") + 1).alias("hash_type"),
        bits_from_coefficients(F.col("_c")).alias("hash_bits"),
    )


def variant_rows(refs: DataFrame, n: int, amplitude: float = 0.02) -> DataFrame:
    """The item itself as ``reference`` and ``n`` shaken copies as ``augmented``: 5 + 5n rows per item.

    The noise of copy v at position i comes from md5(ref-v-i), so every run gives the same rows.
    """
    copies = refs.select("ref_id", "coef", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("variant"))
    noise = F.transform(
        F.sequence(F.lit(0), F.size("coef") - 1),
        lambda i: (
            F.conv(F.substring(F.md5(F.concat_ws("-", F.col("ref_id").cast("string"), F.col("variant").cast("string"), i.cast("string"))), 1, 8), 16, 10)
            .cast("double") / F.lit(4294967296.0) - F.lit(0.5)
        ) * F.lit(amplitude),
    )
    shaken = F.when(F.col("variant") == 0, F.col("coef")).otherwise(F.zip_with("coef", noise, lambda c, e: c + e))
    source = F.when(F.col("variant") == 0, GENERATED[0]).otherwise(GENERATED[1])
    return fingerprint_rows(copies.select("ref_id", "variant", source.alias("source"), shaken.alias("coef")))


def refresh_index(index: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Replace the generated rows of every owner in ``new_rows``; validated rows always stay."""
    owners = new_rows.select("ref_id").distinct()
    mine = index.where(F.col("source").isin(*GENERATED)).join(owners, "ref_id", "left_anti")
    rest = index.where(~F.col("source").isin(*GENERATED))
    return rest.unionByName(mine).unionByName(new_rows)


def create_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Write an index (ref_id, source, hash_type, hash_bits) as a folder partitioned by source and bucket of the owner."""
    _bucketed(index, buckets).write.partitionBy("source", "bucket").parquet(path)


def read_index(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = StructType([*schema.fields, StructField("bucket", IntegerType())])
    return spark.read.schema(full).parquet(path).where(F.col("hash_type").isNotNull()).select(*schema.names)


def write_refresh(path: str, new_rows: DataFrame, buckets: int = 64) -> None:
    """Replace the generated rows of every owner in ``new_rows`` in a stored index.

    The buckets of these owners are staged complete, other owners' rows and rows of both generated sources included, and
    then overwritten in one commit by partition. Run again, also after a failure at any step, it gives the same rows; the
    other buckets and the validated rows are not touched.    """
    spark = new_rows.sparkSession
    new = materialise(_bucketed(new_rows, buckets), "refresh-new")
    held = spark.read.schema(new.schema).parquet(path).where(F.col("source").isin(*GENERATED) & F.col("hash_type").isNotNull())
    touched = held.join(new.select("bucket").distinct(), "bucket", "left_semi")
    others = touched.join(new.select("ref_id").distinct(), "ref_id", "left_anti")
    staged = materialise(others.unionByName(new), "refresh-staged")
    # a (source, bucket) that is left without rows would not be overwritten: it keeps a row without an owner
    kept = staged.select("source", "bucket").distinct()
    bare = touched.select("source", "bucket").distinct().join(kept, ["source", "bucket"], "left_anti")
    empty = bare.select(*[F.col(c) if c in ("source", "bucket") else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns])
    staged.unionByName(empty).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "bucket").parquet(path)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    named = rows.select("ref_id", "source", "hash_type", "hash_bits")
    return named.withColumn("bucket", F.pmod(F.xxhash64("ref_id"), F.lit(buckets)).cast("int"))


def cap_newest(index: DataFrame, cap: int, order: Sequence[str] = ("created_at", "row_id")) -> DataFrame:
    """Keep the newest ``cap`` validated rows per (owner, tier); generated rows are not touched."""
    validated = F.col("source") == "user_validated"
    kept = first_n(index.where(validated), ["ref_id", "hash_type"], [F.desc(c) for c in order], cap).drop("rn")
    return index.where(~validated).unionByName(kept)


def cap_least_used(index: DataFrame, cap: int) -> DataFrame:
    """The specified, never built form of the cap: most recently matched first, then most used."""
    order = [F.desc_nulls_last("last_matched_at"), F.desc("usage_count"), F.desc("row_id")]
    validated = F.col("source") == "user_validated"
    kept = first_n(index.where(validated), ["ref_id", "hash_type"], order, cap).drop("rn")
    return index.where(~validated).unionByName(kept)


def build_index(index: DataFrame, refs: DataFrame, p: HashParams = HashParams()) -> DataFrame:
    """Variants, fingerprints and refresh for the given (ref_id, coef)."""
    rows = variant_rows(refs, p.augmentations).drop("variant")
    return refresh_index(index.select("ref_id", "source", "hash_type", "hash_bits"), rows)


def build_vectors(points: DataFrame | None, refs: DataFrame, namespace: uuid.UUID) -> DataFrame:
    """Unit vectors keyed by a name-based id, merged into ``points`` (None rebuilds from nothing)."""
    new = refs.select(
        stable_id(F.col("ref_id").cast("string"), namespace).alias("point_id"), "ref_id",
        l2_normalise(F.col("vector")).alias("vector"),
    )
    if points is None:
        return new
    return upsert(points, new, ["point_id"], "_new").drop("_new")
