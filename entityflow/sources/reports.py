"""Files in and out: collection CSV, scan report, evaluation manifest and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.functions.money import format_cents

# Fixed value: the columns of the collection export, in order.
CSV_COLUMNS = (
    "name", "set", "number", "finish", "quantity", "price", "price_source", "price_date", "confidence", "batch",
    "image_filename",
)
REPORT_SCHEMA = (
    "file string, cards array<struct<crop_index: int, card_ref_id: bigint, name: string, confidence: int, "
    "accepted_stage: string, rotation: int, methods: array<struct<method: string, card_ref_id: bigint, score: double>>, "
    "candidates: array<bigint>>>"
)
MANIFEST_SCHEMA = (
    "photos array<struct<file: string, scenario: string, cards: array<struct<card_ref_id: string, finish: string, notes: string>>>>"
)


def collection_csv(star: DataFrame) -> DataFrame:
    """The export projection; a missing value and an unknown price are empty, never zero."""
    stamp = F.date_format("price_fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return star.orderBy(F.asc_nulls_last("set_name"), F.asc_nulls_last("number"), "card_id").select(
        "name", F.col("set_name").alias("set"), "number", "finish", F.col("quantity").cast("string").alias("quantity"),
        format_cents(F.col("price_cents")).alias("price"), "price_source", stamp.alias("price_date"),
        F.col("confidence").cast("string").alias("confidence"), F.col("batch_id").cast("string").alias("batch"),
        F.concat(F.col("card_id"), F.lit(".webp")).alias("image_filename"),
    )


def write_collection_csv(star: DataFrame, path: str) -> None:
    collection_csv(star).write.options(
        header=True, lineSep="\r\n", quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def read_collection_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    return spark.read.schema(schema).options(header=True, lineSep="\r\n", quote='"', escape='"').csv(path)


def scan_report(idents: DataFrame, refs: DataFrame) -> DataFrame:
    """Decisions (file, crop_index, ref_id, ...) to one nested row per photo, names from one join.

    A photo has at most as many items as ``reading_order`` keeps. Only the refs of a photo travel to the names and back, not
    its items, which stay where they were dealt by photo.
    """
    methods = F.transform(
        "methods", lambda m: F.struct(m["method"].alias("method"), m["ref_id"].alias("card_ref_id"), m["score"].alias("score"))
    )
    card = F.struct(
        "crop_index", F.col("ref_id").alias("card_ref_id"), "name", "confidence", F.col("stage").alias("accepted_stage"),
        (F.col("rotation") if "rotation" in idents.columns else F.lit(0)).alias("rotation"), methods.alias("methods"), "candidates",
    )
    # whole items are collected, so that Spark deals them by photo once, for their refs and for the report
    photos = idents.groupBy("file").agg(F.collect_list(F.struct(*idents.columns)).alias("items"))
    wanted = photos.select(F.col("file").alias("_file"), F.explode(F.array_distinct("items.ref_id")).alias("_ref"))
    found = wanted.join(refs.select(F.col("id").alias("_ref"), "name"), "_ref")
    # dealt as plain rows: collected lists take more room
    names = found.repartition("_file").groupBy("_file").agg(F.collect_list(F.struct("_ref", "name")).alias("_names"))
    file, none = F.col("file"), F.col("file").isNull()
    # a plain key needs no second deal of the items; items without a file are one photo
    whole = idents.where(~none).join(names, file == F.col("_file"), "left").unionByName(
        idents.where(none).join(names, file.eqNullSafe(F.col("_file")), "left"))
    named = F.explode_outer(F.transform(F.filter("_names", lambda r: r["_ref"] == F.col("ref_id")), lambda r: r["name"])).alias("name")
    return whole.select(*idents.columns, named).groupBy("file").agg(F.sort_array(F.collect_list(card)).alias("cards"))


def read_manifest(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Expected items, one row each with its position on the photo."""
    photos = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=one_per_file).select(F.explode("photos").alias("p"))
    return photos.select(
        F.col("p.file").alias("file"), F.coalesce("p.scenario", F.lit("unknown")).alias("scenario"), F.posexplode("p.cards").alias("pos", "c")
    ).select("file", "scenario", "pos", F.col("c.card_ref_id").alias("expected"), F.coalesce("c.finish", F.lit("unknown")).alias("finish"))


def write_run(rows: DataFrame, metrics: DataFrame, path: str, baseline_path: str | None = None) -> bool:
    """Write rows (gzip) and metrics; with ``baseline_path`` also the new baseline, unless an item was wrongly accepted.

    ``rows`` should be a written table (as ``evaluate`` gives them), as both outputs read it. Returns whether the baseline was written.
    """
    rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/rows")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    if baseline_path is None:
        return False
    written = rows.sparkSession.read.schema(metrics.schema).json(f"{path}/metrics")
    total = written.where(F.col("split") == "all")
    if total.where(F.col("wrong") == 0).isEmpty():
        return False
    total.select("auto_accept_rate", "hash_tier_hit_rate").write.mode("overwrite").json(baseline_path)
    return True
