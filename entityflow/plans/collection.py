"""Collection queries over the bound tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from entityflow.operators import collection as op
from entityflow.params import ExportParams
from entityflow.plans.bindings import Tables, lit_ts
from entityflow.plans.registry import query

_STAR = (
    "card_id, card_ref_id, name, set_id, set_name, number, finish, quantity, confidence, status, price_cents, "
    "price_source, price_fetched_at, batch_id, user_id, created_at, has_price_row"
)
_STATS = """CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_cards,
    CAST(coalesce(sum(coalesce(price_cents, 0)::BIGINT * quantity), 0) AS BIGINT) AS total_value_cents,
    CASE WHEN count(*) = 0 THEN 0 ELSE count(price_cents)::DOUBLE / count(*) END AS priced_fraction,
    min(price_fetched_at) AS oldest_price_at"""


def star(t: Tables):
    return op.collection_filter(op.collection(t.cards, t.batches, t.refs, t.prices))


# the header is reached through the photo; items of every seventh entity have no crop yet
@query("join_collection_star", "v_cards v_photos v_batches v_refs v_prices", """
    SELECT c.card_id, c.card_ref_id, r.name, r.set_id, r.set_name, r.number, c.finish, c.quantity, c.confidence, c.status,
           p.price_cents, p.source AS price_source, p.fetched_at AS price_fetched_at, ph.batch_id, b.user_id, c.created_at,
           p.card_ref_id IS NOT NULL AS has_price_row,
           CASE WHEN c.card_ref_id % 7 <> 0 THEN 'crops/' || c.photo_id || '/' || c.card_id || '.webp' END AS crop_storage_key
    FROM v_cards c JOIN v_photos ph ON ph.photo_id = c.photo_id JOIN v_batches b ON b.batch_id = ph.batch_id
    JOIN v_refs r ON r.id = c.card_ref_id LEFT JOIN v_prices p ON p.card_ref_id = c.card_ref_id AND p.finish = c.finish
    WHERE c.status IN ('auto', 'validated', 'corrected')""")
def star_of_photos(t: Tables):
    crop = F.concat(F.lit("crops/"), "photo_id", F.lit("/"), "card_id", F.lit(".webp"))
    cards = t.cards.withColumn("crop_storage_key", F.when(F.col("card_ref_id") % 7 != 0, crop))
    return op.collection_filter(op.collection(cards, t.batches, t.refs, t.prices, t.photos))


@query("agg_collection_stats", "v_star", f"SELECT user_id, {_STATS} FROM v_star GROUP BY user_id")
def _(t):
    return op.collection_stats(star(t), ["user_id"])


@query("flt_collection", "v_star", f"""
    SELECT {_STAR} FROM v_star WHERE finish = 'holofoil' AND status IN ('validated', 'corrected')""")
def _(t):
    picked = op.CollectionFilters(finish="holofoil", source="corrected")
    return op.collection_filter(op.collection(t.cards, t.batches, t.refs, t.prices), picked)


@query("flt_owner_scope", "v_cards v_batches v_users", """
    SELECT c.card_id, c.batch_id, b.user_id, c.status FROM v_cards c JOIN v_batches b USING (batch_id)
    JOIN v_users u ON u.user_id = b.user_id WHERE u.status = 'active'""")
def _(t):
    owners = t.users.where(F.col("status") == "active")
    return op.owner_scope(t.cards.select("card_id", "batch_id", "status"), t.batches, owners)


@query("flt_prefix_search", "v_refs", """
    SELECT id, name, set_name, number FROM v_refs WHERE starts_with(lower(name), 'red') OR number = 'red'
    ORDER BY name NULLS LAST, id LIMIT 10""")
def _(t):
    return op.search_refs(t.refs, " Red ")


@query("join_results_outer", "v_cards v_refs", """
    SELECT c.batch_id, c.card_id, c.card_ref_id, c.finish, c.confidence, c.quantity, c.status, r.name, r.set_name, r.number
    FROM (SELECT * REPLACE (CASE WHEN confidence >= 10 THEN card_ref_id END AS card_ref_id) FROM v_cards) c
    LEFT JOIN v_refs r ON r.id = c.card_ref_id WHERE c.status IN ('auto', 'validated', 'corrected')""")
def _(t):
    cards = t.cards.withColumn("card_ref_id", F.when(F.col("confidence") >= 10, F.col("card_ref_id")))
    return op.batch_results(cards, t.refs)


@query("sort_confidence_name", "v_star", """
    SELECT batch_id, card_id, confidence, name, row_number() OVER (PARTITION BY batch_id ORDER BY confidence DESC, name ASC NULLS LAST, card_id) AS place
    FROM v_star""", types={"place": "INTEGER"})
def _(t):
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy(*op.result_order()))
    return op.batch_results(t.cards, t.refs).select("batch_id", "card_id", "confidence", "name", place.alias("place"))


@query("sort_set_number", "v_star", """
    SELECT user_id, set_name, number, card_id, row_number() OVER (PARTITION BY user_id ORDER BY set_name ASC NULLS LAST, number ASC NULLS LAST, card_id) AS place
    FROM v_star""", types={"place": "INTEGER"})
def _(t):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*op.sort_order("set_asc")))
    return star(t).select("user_id", "set_name", "number", "card_id", place.alias("place"))


@query("topk_value_page", "v_star", """
    SELECT card_id, name, set_name, price_cents, quantity, count(*) OVER () = 60 AS has_next
    FROM (SELECT * FROM v_star ORDER BY price_cents::BIGINT * quantity DESC NULLS LAST, card_id LIMIT 60 OFFSET 60)""")
def _(t):
    return op.page(star(t), "no such sort", 2, 60).select(
        "card_id", "name", "set_name", "price_cents", "quantity", "has_next"
    )


@query("topk_per_owner", "v_star", """
    SELECT user_id, card_id, rn, owner_rows, greatest(owner_rows - 3, 0) AS dropped
    FROM (SELECT user_id, card_id, count(*) OVER (PARTITION BY user_id) AS owner_rows,
                 row_number() OVER (PARTITION BY user_id ORDER BY set_name NULLS LAST, number NULLS LAST, card_id) AS rn
          FROM v_star) WHERE rn <= 3""", types={"rn": "INTEGER"})
def _(t):
    return op.truncate_per_owner(star(t).select("user_id", "card_id", "set_name", "number"), "user_id", op.sort_order("set_asc"), 3).select(
        "user_id", "card_id", "rn", "owner_rows", "dropped"
    )


def _exports(t: Tables):
    return t.users.select(
        (F.col("user_id") + 1000000).alias("export_id"), "user_id", lit_ts("2024-05-01 12:00:00").alias("requested_at")
    )


@query("sink_export_manifest", "v_star v_users", """
    SELECT u.user_id + 1000000 AS export_id, u.user_id, coalesce(card_count, 0) AS card_count,
           coalesce(total_cards, 0) AS total_cards, coalesce(dropped, 0) AS dropped, coalesce(value, 0) AS total_value_cents,
           '$' || (coalesce(value, 0) // 100) || '.'
               || lpad(CAST(coalesce(value, 0) % 100 AS VARCHAR), 2, '0') AS total_value_display,
           'exports/' || u.user_id || '/' || (u.user_id + 1000000) || '.pdf' AS storage_key,
           TIMESTAMP '2024-05-03 12:00:00' AS expires_at
    FROM v_users u LEFT JOIN (
      SELECT user_id, count(*) AS card_count, CAST(sum(quantity) AS BIGINT) AS total_cards,
             CAST(sum(coalesce(price_cents, 0)::BIGINT * quantity) AS BIGINT) AS value, max(greatest(n - 12, 0)) AS dropped
      FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
                   row_number() OVER (PARTITION BY user_id ORDER BY set_name NULLS LAST, number NULLS LAST, card_id) AS rn
            FROM v_star) WHERE rn <= 12 GROUP BY user_id) s ON s.user_id = u.user_id""")
def _(t):
    return op.export_manifest(star(t), _exports(t), ExportParams(max_cards=12))[1]


@query("collection_report", "v_star", f"""
    SELECT 'page' AS part, card_id, price_cents::BIGINT * quantity AS value_cents, NULL::DOUBLE AS priced_fraction
    FROM (SELECT * FROM v_star ORDER BY name NULLS LAST, card_id LIMIT 60)
    UNION ALL
    SELECT 'total', NULL, total_value_cents, priced_fraction FROM (SELECT {_STATS} FROM v_star)""")
def _(t):
    page, totals = op.collection_report(t.cards, t.batches, t.refs, t.prices, sort="name_asc")
    return page.select(
        F.lit("page").alias("part"), "card_id",
        (F.col("price_cents").cast("bigint") * F.col("quantity")).alias("value_cents"),
        F.lit(None).cast("double").alias("priced_fraction"),
    ).unionByName(
        totals.select(
            F.lit("total").alias("part"), F.lit(None).cast("string").alias("card_id"),
            F.col("total_value_cents").alias("value_cents"), "priced_fraction",
        )
    )


@query("agg_progress_snapshot", "v_batches v_photos v_cards", """
    SELECT b.batch_id, b.status, coalesce(photos_done, 0) AS photos_done, coalesce(cards_total, 0) AS cards_total,
           coalesce(cards_identified, 0) AS cards_identified, coalesce(cards_validation, 0) AS cards_validation,
           coalesce(cards_unreadable, 0) AS cards_unreadable
    FROM v_batches b
    LEFT JOIN (SELECT batch_id, count(*) FILTER (status = 'done') AS photos_done FROM v_photos GROUP BY 1) p USING (batch_id)
    LEFT JOIN (SELECT batch_id, count(*) AS cards_total,
                      count(*) FILTER (status IN ('auto', 'validated', 'corrected')) AS cards_identified,
                      count(*) FILTER (status = 'validation') AS cards_validation,
                      count(*) FILTER (status = 'unreadable') AS cards_unreadable FROM v_cards GROUP BY 1) c USING (batch_id)""")
def _(t):
    return op.progress_snapshot(t.batches, t.photos, t.cards)


@query("agg_batch_totals", "v_cards", """
    SELECT batch_id, CAST(coalesce(sum(quantity) FILTER (status IN ('auto', 'validated', 'corrected')), 0) AS BIGINT) AS total,
           count(*) FILTER (status = 'validation') AS remaining FROM v_cards GROUP BY batch_id""")
def _(t):
    return op.batch_totals(t.cards)


@query("win_ticker", "v_cards v_refs", """
    SELECT batch_id, rn, card_id, name, confidence, status
    FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at DESC, card_id DESC) AS rn FROM v_cards) c
    LEFT JOIN v_refs r ON r.id = c.card_ref_id WHERE rn <= 20""", types={"rn": "INTEGER"})
def _(t):
    return op.ticker(t.cards.withColumnRenamed("created_at", "updated_at"), t.refs)


@query("win_next_review", "v_cards", """
    SELECT batch_id, card_id, card_ref_id, confidence, created_at FROM v_cards WHERE status = 'validation'
    QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY created_at, card_id) = 1""")
def _(t):
    return op.next_review(t.cards)


@query("join_batch_complete", "v_batches v_photos v_cards", """
    SELECT batch_id, user_id FROM v_batches b WHERE status = 'processing'
      AND NOT EXISTS (SELECT 1 FROM v_photos p WHERE p.batch_id = b.batch_id AND p.status <> 'done')
      AND NOT EXISTS (SELECT 1 FROM v_cards c WHERE c.batch_id = b.batch_id AND c.status = 'pending')
      AND EXISTS (SELECT 1 FROM v_cards c WHERE c.batch_id = b.batch_id)""")
def _(t):
    return op.completed_batches(t.batches, t.photos, t.cards).select("batch_id", "user_id")


@query("agg_child_counts", "v_batches v_photos v_cards", """
    SELECT 'batch' AS parent, CAST(b.batch_id AS VARCHAR) AS parent_id, count(p.photo_id) AS n
    FROM v_batches b LEFT JOIN v_photos p USING (batch_id) GROUP BY 1, 2
    UNION ALL
    SELECT 'photo', p.photo_id, count(c.card_id) FROM v_photos p LEFT JOIN v_cards c USING (photo_id) GROUP BY 1, 2""")
def _(t):
    photos = op.child_counts(t.batches, t.photos, "batch_id")
    cards = op.child_counts(t.photos, t.cards, "photo_id")
    return photos.select(
        F.lit("batch").alias("parent"), F.col("batch_id").cast("string").alias("parent_id"), "n"
    ).unionByName(cards.select(F.lit("photo").alias("parent"), F.col("photo_id").alias("parent_id"), "n"))


def _choices(t: Tables):
    k = F.col("card_ref_id")
    alternates = F.array(k, F.when(F.col("ordinal") < 5, k), k + F.col("ordinal"), k + 1, k + 2)
    return t.cards.where(F.col("status") == "validation").select(F.col("card_id").alias("item_id"), alternates.alias("ids"))


_CHOICES = """(SELECT card_id AS item_id, [card_ref_id, CASE WHEN ordinal < 5 THEN card_ref_id END,
    card_ref_id + ordinal, card_ref_id + 1, card_ref_id + 2] AS ids FROM v_cards WHERE status = 'validation')"""
# the distinct ids of up to five slots, in order
_ORDERED = f"""(SELECT item_id, list_transform(list_filter(range(1, 6), lambda i: ids[i] IS NOT NULL
    AND list_position(ids, ids[i]) = i), lambda i: ids[i])[1:3] AS uniq FROM {_CHOICES})"""


@query("join_id_lookup", "v_cards v_refs", f"""
    SELECT item_id, pos - 1 AS pos, ref_id, name, set_name, number
    FROM (SELECT item_id, unnest(range(1, len(uniq) + 1)) AS pos, unnest(uniq) AS ref_id FROM {_ORDERED})
    JOIN v_refs ON id = ref_id""", types={"pos": "INTEGER"})
def _(t):
    return op.lookup_in_order(_choices(t), t.refs)


@query("set_ordered_distinct", "v_cards", f"""
    SELECT item_id, array_to_string(uniq, ',') AS ids FROM {_ORDERED}""")
def _(t):
    picked = F.transform(op.ordered_distinct(F.col("ids")), lambda i: i.cast("string"))
    return _choices(t).select("item_id", F.array_join(picked, ",").alias("ids"))


@query("agg_storage_used", "v_photos v_batches", """
    SELECT user_id, CAST(sum(bytes) AS BIGINT) AS storage_bytes FROM v_photos JOIN v_batches USING (batch_id) GROUP BY 1""")
def _(t):
    return op.storage_used(t.photos, t.batches)
