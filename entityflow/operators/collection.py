"""Owner-scoped collection queries: star join, filters, pages, totals, per-batch lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.functions.joins import left_join_sparse
from entityflow.functions.money import export_price_display, format_cents
from entityflow.functions.ranking import first_n, oldest
from entityflow.params import RESOLVED, ExportParams


@dataclass(frozen=True)
class CollectionFilters:
    batch_id: object = None
    set_id: str | None = None
    finish: str | None = None
    source: str | None = None  # "auto" or "corrected"

    @classmethod
    def parse(cls, options: Mapping[str, str]) -> CollectionFilters:
        """From request text: empty options are absent, an unknown source is ignored."""
        source = options.get("source")
        return cls(
            options.get("batch") or None, options.get("set") or None, options.get("finish") or None,
            source if source in ("auto", "corrected") else None,
        )


def collection_filter(df: DataFrame, f: CollectionFilters = CollectionFilters()) -> DataFrame:
    """Resolved items only, narrowed by whichever options are given."""
    keep = F.col("status").isin(*RESOLVED)
    if f.batch_id is not None:
        keep = keep & (F.col("batch_id") == F.lit(f.batch_id))
    if f.set_id:
        keep = keep & (F.col("set_id") == f.set_id)
    if f.finish:
        keep = keep & (F.col("finish") == f.finish)
    if f.source == "auto":
        keep = keep & (F.col("status") == "auto")
    elif f.source == "corrected":
        keep = keep & F.col("status").isin("validated", "corrected")
    return df.where(keep)


def collection(
    cards: DataFrame, batches: DataFrame, refs: DataFrame, prices: DataFrame, photos: DataFrame | None = None
) -> DataFrame:
    """Items with owner, reference entity and price. ``has_price_row`` tells a known miss from no price row.

    With ``photos`` the header is reached through the photo, else by the item's own ``batch_id``. Where the items carry
    ``crop_storage_key``, so does the result.
    """
    if photos is not None:
        cards = cards.drop("batch_id").join(photos.select("photo_id", "batch_id"), "photo_id")
    price = prices.select(
        F.col("card_ref_id"), F.col("finish"), "price_cents",
        F.col("source").alias("price_source"), F.col("fetched_at").alias("price_fetched_at"),
        F.lit(True).alias("_priced"),
    )
    ref = refs.select(F.col("id").alias("card_ref_id"), "name", "set_id", "set_name", "number")
    crop = [c for c in ("crop_storage_key",) if c in cards.columns]
    return (
        cards.select(
            "card_id", "batch_id", "card_ref_id", "finish", "quantity", "confidence", "status", "created_at", *crop
        )
        .join(batches.select("batch_id", "user_id"), "batch_id")
        .join(ref, "card_ref_id")
        .join(price, ["card_ref_id", "finish"], "left")
        .select(
            "card_id", "card_ref_id", "name", "set_id", "set_name", "number", "finish", "quantity", "confidence",
            "status", "price_cents", "price_source", "price_fetched_at", "batch_id", "user_id", "created_at",
            F.coalesce("_priced", F.lit(False)).alias("has_price_row"), *crop,
        )
    )


def collection_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over a filtered star; ``priced_fraction`` counts rows, not quantity."""
    rows = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("quantity").cast("bigint")), F.lit(0)).alias("total_cards"),
        F.coalesce(
            F.sum(F.coalesce(F.col("price_cents"), F.lit(0)).cast("bigint") * F.col("quantity")), F.lit(0)
        ).alias("total_value_cents"),
        F.when(rows == 0, 0.0).otherwise(F.count("price_cents") / rows).alias("priced_fraction"),
        F.min("price_fetched_at").alias("oldest_price_at"),
    )


def _value() -> Column:
    return F.col("price_cents").cast("bigint") * F.col("quantity")


SORTS: dict[str, tuple] = {
    "value_desc": (lambda: _value().desc_nulls_last(),),
    "name_asc": (lambda: F.col("name").asc_nulls_last(),),
    "set_asc": (lambda: F.col("set_name").asc_nulls_last(), lambda: F.col("number").asc_nulls_last()),
}


def sort_order(sort: str) -> list[Column]:
    """Columns of a whitelisted sort, unknown names falling back to value; ``card_id`` breaks ties."""
    return [make() for make in SORTS.get(sort, SORTS["value_desc"])] + [F.col("card_id").asc()]


def page(df: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """One page of a collection. A full page is taken to have a successor (``has_next``)."""
    rows = df.orderBy(*sort_order(sort)).offset(max(0, number - 1) * size).limit(size)
    on_page = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))  # at most ``size`` rows are left here
    return rows.withColumn("has_next", on_page == size)


def owner_scope(df: DataFrame, batches: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows whose header belongs to one of ``owners`` (user_id), with the owner attached."""
    owned = batches.select("batch_id", "user_id").join(owners.select("user_id").distinct(), "user_id", "left_semi")
    return df.join(owned, "batch_id")


def search_refs(refs: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Name prefix (any case) or exact number, by name. Empty text finds nothing."""
    q = text.strip()
    hit = F.lower("name").startswith(q.lower()) | (F.col("number") == q)
    found = refs.where(hit if q else F.lit(False))
    return found.select("id", "name", "set_name", "number").orderBy(F.asc_nulls_last("name"), "id").limit(limit)


def result_order() -> list[Column]:
    """The order of a batch's results: most certain first, then by name."""
    return [F.desc("confidence"), F.asc_nulls_last("name"), F.col("card_id")]


def batch_results(cards: DataFrame, refs: DataFrame) -> DataFrame:
    """Resolved items per batch, best first; an item whose entity is unknown keeps its row."""
    ref = refs.select(F.col("id").alias("card_ref_id"), "name", "set_name", "number")
    return (
        cards.where(F.col("status").isin(*RESOLVED))
        .select("batch_id", "card_id", "card_ref_id", "finish", "confidence", "quantity", "status")
        .transform(left_join_sparse, ref, ["card_ref_id"], "card_id")
        .orderBy("batch_id", *result_order())
    )


def batch_totals(cards: DataFrame) -> DataFrame:
    resolved = F.col("status").isin(*RESOLVED)
    return cards.groupBy("batch_id").agg(
        F.sum(F.when(resolved, F.col("quantity").cast("bigint")).otherwise(0)).alias("total"),
        F.count_if(F.col("status") == "validation").alias("remaining"),
    )


def truncate_per_owner(df: DataFrame, owner: str, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per owner with the owner's full row count and how many rows were left out."""
    totals = df.groupBy(owner).agg(F.count(F.lit(1)).alias("owner_rows"))
    return (
        first_n(df, [owner], order, n)
        .join(totals, owner)
        .withColumn("dropped", F.greatest(F.col("owner_rows") - n, F.lit(0)))
    )


def export_manifest(star: DataFrame, exports: DataFrame, p: ExportParams = ExportParams()) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of the exports asked for, as (export_id, user_id, requested_at).

    The rows are the first ``max_cards`` of each owner by set and number, and the totals are over those rows.
    """
    order = [F.asc_nulls_last("set_name"), F.asc_nulls_last("number"), F.col("card_id")]
    rows = truncate_per_owner(star, "user_id", order, p.max_cards).select(
        "user_id", F.col("rn").alias("position"), "card_id",
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("set_name", F.lit("")).alias("set_name"),
        F.coalesce("number", F.lit("")).alias("number"),
        F.coalesce("finish", F.lit("")).alias("finish"),
        "quantity", "price_cents", export_price_display(F.col("price_cents")).alias("price_display"), "dropped",
    )
    totals = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("card_count"),
        F.sum(F.col("quantity").cast("bigint")).alias("total_cards"),
        F.sum(F.coalesce(F.col("price_cents"), F.lit(0)).cast("bigint") * F.col("quantity")).alias("value"),
        F.max("dropped").alias("dropped"),
    )
    zero = F.lit(0).cast("bigint")
    summary = exports.join(totals, "user_id", "left").select(
        "export_id", "user_id",
        *[F.coalesce(c, zero).alias(c) for c in ("card_count", "total_cards", "dropped")],
        F.coalesce("value", zero).alias("total_value_cents"),
        format_cents(F.coalesce("value", zero)).alias("total_value_display"),
        F.concat_ws("/", F.lit(p.prefix), F.col("user_id").cast("string"), F.concat(F.col("export_id").cast("string"), F.lit(".pdf"))).alias("storage_key"),
        (F.col("requested_at") + F.make_dt_interval(hours=F.lit(p.retention_hours))).alias("expires_at"),
    )
    return rows, summary


def progress_snapshot(batches: DataFrame, photos: DataFrame, cards: DataFrame) -> DataFrame:
    """Counters per batch, each child table read once."""
    photo = photos.groupBy("batch_id").agg(F.count_if(F.col("status") == "done").alias("photos_done"))
    s = F.col("status")
    card = cards.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("cards_total"),
        F.count_if(s.isin(*RESOLVED)).alias("cards_identified"),
        F.count_if(s == "validation").alias("cards_validation"),
        F.count_if(s == "unreadable").alias("cards_unreadable"),
    )
    counts = ["photos_done", "cards_total", "cards_identified", "cards_validation", "cards_unreadable"]
    return (
        batches.select("batch_id", "status")
        .join(photo, "batch_id", "left")
        .join(card, "batch_id", "left")
        .select("batch_id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    )


def ticker(cards: DataFrame, refs: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` last changed items of each batch, with their names."""
    last = first_n(cards, ["batch_id"], [F.desc("updated_at"), F.desc("card_id")], n)
    ref = refs.select(F.col("id").alias("card_ref_id"), "name")
    return left_join_sparse(last, ref, ["card_ref_id"], "card_id").select("batch_id", "rn", "card_id", "name", "confidence", "status")


def next_review(cards: DataFrame) -> DataFrame:
    """The earliest item of each batch that waits for a person."""
    waiting = cards.where(F.col("status") == "validation").select("batch_id", "card_id", "card_ref_id", "confidence", "created_at")
    return oldest(waiting, ["batch_id"], ["created_at", "card_id"])


def completed_batches(
    batches: DataFrame, photos: DataFrame, cards: DataFrame, terminal_photo_states: Sequence[str] = ("done",)
) -> DataFrame:
    """Processing batches that have an item, no unfinished photo and no pending item."""
    open_photos = photos.where(~F.col("status").isin(*terminal_photo_states)).select("batch_id").distinct()
    by_card = cards.groupBy("batch_id").agg(F.count_if(F.col("status") == "pending").alias("_pending"))
    return (
        batches.where(F.col("status") == "processing")
        .join(open_photos, "batch_id", "left_anti")
        .join(by_card.where(F.col("_pending") == 0).select("batch_id"), "batch_id", "left_semi")
    )


def child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return parents.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def lookup_in_order(ids: DataFrame, refs: DataFrame, limit: int = 3) -> DataFrame:
    """(item, ids[]) to the first ``limit`` distinct ids with their entity, in order; unknown ids drop out."""
    distinct = ordered_distinct(F.col("ids"), limit)
    ref = refs.select(F.col("id").alias("ref_id"), "name", "set_name", "number")
    return ids.select("item_id", F.posexplode(distinct).alias("pos", "ref_id")).join(ref, "ref_id")


def ordered_distinct(ids: Column, limit: int = 3) -> Column:
    return F.slice(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())), 1, limit)


def storage_used(photos: DataFrame, batches: DataFrame) -> DataFrame:
    """Bytes per owner from the photo rows, summed per batch before the join."""
    per_batch = photos.groupBy("batch_id").agg(F.sum("bytes").alias("bytes"))
    return per_batch.join(batches.select("batch_id", "user_id"), "batch_id").groupBy("user_id").agg(
        F.sum("bytes").alias("storage_bytes")
    )


def collection_report(
    cards: DataFrame, batches: DataFrame, refs: DataFrame, prices: DataFrame,
    filters: CollectionFilters = CollectionFilters(), sort: str = "value_desc", number: int = 1, size: int = 60,
) -> tuple[DataFrame, DataFrame]:
    """(page, totals) of one filtered star."""
    star = collection_filter(collection(cards, batches, refs, prices), filters)
    return page(star, sort, number, size), collection_stats(star)
