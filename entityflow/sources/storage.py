"""Working folders and object keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared place the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (a ``local`` master, as in tests) uses a temporary folder; any other
    session is refused, as its executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="entityflow-")
    return f"{base.rstrip('/')}/entityflow/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a stage's rows to the shared folder and go on from the file, so that no later branch, and no retry
    after a lost executor, repeats the stage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_assets(spark: SparkSession, path: str, suffix: str = ".png") -> DataFrame:
    """(id, length) of the files below a folder, named by their id; no content is read. Spark may leave out empty files,
    which count as absent anyway."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.left(name, F.length(name) - len(suffix)).alias("id"), "length")


def photo_key(user: Column, batch: Column, photo: Column) -> Column:
    return F.concat_ws("/", user.cast("string"), batch.cast("string"), F.concat(photo.cast("string"), F.lit(".webp")))


def crop_key(user: Column, batch: Column, card: Column) -> Column:
    return F.concat_ws(
        "/", user.cast("string"), batch.cast("string"), F.lit("crops"), F.concat(card.cast("string"), F.lit(".webp"))
    )


def parse_blob_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Add user_id, batch_id, kind (photo or crop) and object_id; all NULL for a key of another shape."""
    shape = r"^([^/]+)/([^/]+)/(crops/)?([^/]+)\.webp$"
    ok = F.regexp_like(F.col(key), F.lit(shape))

    def part(i: int) -> Column:
        return F.when(ok, F.regexp_extract(key, shape, i))

    return df.select(
        "*", part(1).alias("user_id"), part(2).alias("batch_id"),
        F.when(ok, F.when(part(3) == "", "photo").otherwise("crop")).alias("kind"), part(4).alias("object_id"),
    )
