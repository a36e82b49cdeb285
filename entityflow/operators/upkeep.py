"""Jobs that are specified for the data but have no implementation to compare with: retention, orphan sweep,
budget mode, triage, population report, specular hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.ranking import running_total

# How long each class of rows is kept.
KEEP_HOURS = {"anonymous": 24, "abandoned": 48, "source_photo": 7 * 24, "price": 30 * 24}


def past(ts: Column, as_of: Column, kind: str) -> Column:
    return ts <= as_of - F.make_dt_interval(hours=F.lit(KEEP_HOURS[kind]))


def retention(batches: DataFrame, users: DataFrame, photos: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """(kind, id) of everything due for deletion. An anonymous owner's batches go first, whatever their state."""
    owned = batches.join(users.select("user_id", "tier"), "user_id")
    anonymous = (F.col("tier") == "anon") & past(F.col("created_at"), as_of, "anonymous")
    abandoned = F.col("status").isin("pending", "failed") & past(F.col("created_at"), as_of, "abandoned")
    kind = F.when(anonymous, "anonymous").when(abandoned, "abandoned")
    due = owned.withColumn("kind", kind)
    gone = due.where(F.col("kind").isNotNull()).select("kind", F.col("batch_id").cast("string").alias("id"))
    done = due.where(F.col("kind").isNull() & (F.col("status") == "complete") & past(F.col("created_at"), as_of, "source_photo"))
    source = photos.join(done.select("batch_id"), "batch_id", "left_semi").select(F.lit("source_photo").alias("kind"), F.col("photo_id").alias("id"))
    stale = prices.where(past(F.col("fetched_at"), as_of, "price")).select(
        F.lit("price").alias("kind"), F.concat_ws("/", F.col("card_ref_id").cast("string"), "finish").alias("id")
    )
    return gone.unionByName(source).unionByName(stale)


def orphans(objects: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of objects without a row and of rows without an object."""
    o = objects.select("key", F.lit(True).alias("_o"))
    r = rows.select("key", F.lit(True).alias("_r"))
    kind = F.when(F.col("_r").isNull(), "object without row").when(F.col("_o").isNull(), "row without object")
    return o.join(r, "key", "full_outer").select("key", kind.alias("kind")).where(F.col("kind").isNotNull())


def budget_mode(spend: DataFrame, daily_cents: int, user_cents: int) -> DataFrame:
    """Mode at each paid call (user_id, day, ts, request_id, cents), from what was spent before it that day.

    From 80% of the budget calls degrade to review, from 100% work queues; a user at the own limit degrades alone.
    """
    order, cents = ["ts", "request_id"], F.col("cents").cast("bigint")
    total = running_total(spend, ["day"], order, cents, "_day")
    both = running_total(total, ["user_id", "day"], order, cents, "_user")
    before, mine = F.col("_day") - cents, F.col("_user") - cents
    mode = (
        F.when(before >= daily_cents, "queue").when(before * 100 >= daily_cents * 80, "degrade")
        .when(mine >= user_cents, "user degrade").otherwise("normal")
    )
    return both.withColumn("mode", mode).drop("_day", "_user")


def triage(star: DataFrame, sell_cents: int, grade_cents: int) -> DataFrame:
    """Collection per owner in grade, sell and bulk buckets with quantities and value."""
    c = F.coalesce("price_cents", F.lit(0)).cast("bigint")
    bucket = F.when(c >= grade_cents, "grade").when(c >= sell_cents, "sell").otherwise("bulk")
    return star.groupBy("user_id", bucket.alias("bucket")).agg(
        F.sum(F.col("quantity").cast("bigint")).alias("cards"), F.sum(c * F.col("quantity")).alias("value_cents")
    )


def population(star: DataFrame, edges: tuple[int, ...], smallest: int) -> DataFrame:
    """Cards, owners and value bands per set; a cell with fewer than ``smallest`` owners is left out.

    Owners are counted over distinct (set, band, owner) rows, so the count itself stays mergeable.
    """
    band = F.lit(0)
    for e in edges:
        band = band + F.when(F.col("price_cents") >= e, 1).otherwise(0)
    cells = star.groupBy("set_name", F.when(F.col("price_cents").isNotNull(), band).alias("band"), "user_id").agg(
        F.sum(F.col("quantity").cast("bigint")).alias("cards")
    )
    summed = cells.groupBy("set_name", "band").agg(F.sum("cards").alias("cards"), F.count(F.lit(1)).alias("owners"))
    return summed.where(F.col("owners") >= smallest)


def specular_hint(pixels: DataFrame, saturation_var: float, brightness_var: float) -> DataFrame:
    """(item, saturation, brightness) rows of a region to a suggested variant; a hint, never an acceptance."""
    v = pixels.groupBy("item_id").agg(F.var_pop("saturation").alias("sat"), F.var_pop("brightness").alias("bright"))
    hint = (
        F.when((F.col("sat") >= saturation_var) & (F.col("bright") >= brightness_var), "holofoil")
        .when(F.col("bright") >= brightness_var, "reverseHolofoil").otherwise("normal")
    )
    return v.select("item_id", hint.alias("suggested"))
