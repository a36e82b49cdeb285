"""Catalog and listing documents: nested JSON to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.functions.money import cents_from_market
from entityflow.operators.prices import upsert

# Fixed value: the layout of a catalog page.
_PRICES = "struct<prices: map<string, struct<market: double>>>"
PAGE_SCHEMA = (
    "data array<struct<id: string, name: string, number: string, rarity: string, "
    "images: struct<small: string, large: string>, set: struct<id: string, name: string, printedTotal: int>, "
    f"tcgplayer: {_PRICES}>>"
)


def read_pages(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Pages stored one document per file, or one document per line."""
    return spark.read.schema(PAGE_SCHEMA).json(path, multiLine=one_per_file)


def flatten_catalog(pages: DataFrame) -> DataFrame:
    """One row per entity; variants sorted, missing blocks NULL, empty text or an empty list."""
    e = pages.select(F.explode("data").alias("e")).select("e.*")
    none = F.array().cast("array<string>")
    return e.select(
        "id", "name",
        F.coalesce(F.col("set.id"), F.lit("")).alias("set_id"),
        F.coalesce(F.col("set.name"), F.lit("")).alias("set_name"),
        "number",
        F.col("set.printedTotal").cast("string").alias("printed_total"),
        "rarity",
        F.col("images.large").alias("image_url"),
        F.coalesce(F.sort_array(F.map_keys("tcgplayer.prices")), none).alias("finishes"),
    )


def select_refs(refs: DataFrame, sets: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entities of the given sets in id order."""
    chosen = refs.where(F.col("set_id").isin(*sets)) if sets else refs
    ordered = chosen.orderBy("id")
    return ordered if limit is None else ordered.limit(limit)


def upsert_catalog(catalog: DataFrame, rows: DataFrame, synced_at: Column) -> DataFrame:
    """Merge by id, the new row winning on every column and stamped with the sync time."""
    return upsert(catalog, rows.withColumn("synced_at", synced_at), ["id"], "_new").drop("_new")


def with_assets(refs: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) by a listing of (id, length): an absent or empty asset skips the entity."""
    present = listing.where(F.col("length") > 0).select("id").distinct()
    return refs.join(present, "id", "left_semi"), refs.join(present, "id", "left_anti")


def market_cents(document: Column, finish: Column) -> Column:
    """Market price of one variant in a card document, in cents; any missing level gives NULL."""
    doc = F.from_json(document, f"data struct<tcgplayer: {_PRICES}>")
    entry = F.try_element_at(doc["data"]["tcgplayer"]["prices"], finish)
    return cents_from_market(entry["market"])


def listing_links(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, link) of a thread (``[0].data.children[].data.url``) or album (``data.images[].link``) document."""
    thread = F.from_json(F.col(column), "array<struct<data: struct<children: array<struct<data: struct<url: string>>>>>>")
    album = F.from_json(F.col(column), "data struct<images: array<struct<link: string>>>")
    urls = F.transform(F.try_element_at(thread, F.lit(1))["data"]["children"], lambda c: c["data"]["url"])
    links = F.transform(album["data"]["images"], lambda i: i["link"])
    is_thread = F.ltrim(F.col(column)).startswith("[")
    found = F.filter(F.when(is_thread, urls).otherwise(links), lambda u: u.isNotNull() & (u != ""))
    return documents.select(key, F.posexplode(found).alias("pos", "link"))
