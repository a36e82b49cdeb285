"""Price and variant queries over the bound tables."""

from pyspark.sql import functions as F

from entityflow.functions import money
from entityflow.operators import prices as op
from entityflow.params import FINISHES, PriceParams
from entityflow.plans.bindings import Tables, lit_ts
from entityflow.plans.collection import star
from entityflow.plans.registry import query

AS_OF = "2000-06-01 00:00:00"
TTL = 24 * 365
_FRESH = "fetched_at > TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 8760 HOUR"
_ORDER = ("primary", "secondary")

# review state of the cards: stage and flag from the item's numbers
_REVIEW = """(SELECT card_id, card_ref_id, finish, status, quantity,
    (['h', 'multi', 'llm', 'validation', 'unreadable'])[suppkey % 5 + 1] AS accepted_stage,
    (ordinal % 2 = 0) AS finish_needs_confirmation FROM v_cards)"""


def review_cards(t: Tables):
    stages = F.array(*[F.lit(s) for s in ("h", "multi", "llm", "validation", "unreadable")])
    return t.cards.select(
        "card_id", "card_ref_id", "finish", "status", "quantity",
        F.element_at(stages, (F.col("suppkey") % 5 + 1).cast("int")).alias("accepted_stage"),
        (F.col("ordinal") % 2 == 0).alias("finish_needs_confirmation"),
    )


# a book whose variants lie close together, so that narrowing happens: cents per ref with a small step per variant
def _close_book(t: Tables):
    return t.refs.select(
        F.col("id").alias("card_ref_id"), F.posexplode(F.array(*[F.lit(f) for f in FINISHES])).alias("pos", "finish"), "retail"
    ).where((F.col("card_ref_id") + F.col("pos")) % 9 != 0).select(
        "card_ref_id", "finish",
        F.when((F.col("card_ref_id") + F.col("pos")) % 8 != 0,
               (F.rint(F.col("retail")) + F.col("pos") * (F.col("card_ref_id") % 13) * 10).cast("int")).alias("price_cents"),
    )


_CLOSE = f"""(SELECT id AS card_ref_id, ({list(FINISHES)})[pos + 1] AS finish,
     CASE WHEN (id + pos) % 8 <> 0 THEN CAST(round_even(retail, 0) + pos * (id % 13) * 10 AS INTEGER) END AS price_cents
     FROM v_refs, (SELECT unnest(range(3)) AS pos) WHERE (id + pos) % 9 <> 0)"""


def _spread_sql(book: str) -> str:
    return f"""(SELECT *, CASE WHEN narrow THEN
                     list_filter({list(FINISHES)}, lambda f: list_contains(finishes, f))[1] END AS chosen
        FROM (SELECT card_ref_id, any_value(finishes) AS finishes, count(*) AS n_finishes, count(price_cents) AS n_priced,
               min(price_cents) AS min_cents, max(price_cents) AS max_cents,
               coalesce(count(*) = count(price_cents) AND min(price_cents) > 0 AND
                 (max(price_cents)::DOUBLE - min(price_cents)) / min(price_cents) * 100 <= 15, false) AS narrow
        FROM (SELECT w.card_ref_id, w.finishes, b.price_cents
              FROM (SELECT id AS card_ref_id, finishes, unnest(finishes) AS finish FROM v_refs) w
              LEFT JOIN {book} b ON b.card_ref_id = w.card_ref_id AND b.finish = w.finish)
        GROUP BY card_ref_id))"""


@query("flt_price_fresh", "v_prices v_refs", f"""
    SELECT w.card_ref_id, w.finish, coalesce(p.fetched_at IS NOT NULL, false) AS fresh, p.price_cents
    FROM (SELECT id AS card_ref_id, unnest(finishes) AS finish FROM v_refs) w
    LEFT JOIN (SELECT * FROM v_prices WHERE {_FRESH}) p ON p.card_ref_id = w.card_ref_id AND p.finish = w.finish""")
def _(t):
    keys = t.refs.select(F.col("id").alias("card_ref_id"), F.explode("finishes").alias("finish"))
    return op.fresh_prices(t.prices, keys, lit_ts(AS_OF), TTL)


@query("join_stale_price_worklist", "v_cards v_refs v_prices", f"""
    SELECT DISTINCT card_ref_id, finish
    FROM (SELECT c.card_ref_id, unnest(r.finishes) AS finish FROM v_cards c JOIN v_refs r ON r.id = c.card_ref_id
          WHERE c.status IN ('auto', 'validated', 'corrected')) w
    WHERE NOT EXISTS (SELECT 1 FROM v_prices p WHERE p.card_ref_id = w.card_ref_id AND p.finish = w.finish AND {_FRESH})""")
def _(t):
    resolved = t.cards.where(F.col("status").isin("auto", "validated", "corrected"))
    return op.price_worklist(resolved, t.refs, t.prices, lit_ts(AS_OF), TTL)


_RESOLVED = """(SELECT card_ref_id, finish, cents AS price_cents, source, observed_at AS fetched_at FROM v_obs
    WHERE obs_status = 'ok' QUALIFY row_number() OVER (PARTITION BY card_ref_id, finish
      ORDER BY CASE source WHEN 'primary' THEN 1 ELSE 2 END, observed_at DESC, obs_id DESC) = 1)"""


@query("price_resolve", "v_obs", f"""
    SELECT card_ref_id, finish, price_cents, source, 'resolved' AS outcome FROM {_RESOLVED}
    UNION ALL
    SELECT card_ref_id, finish, NULL, NULL, 'retry' FROM v_obs GROUP BY 1, 2 HAVING count(*) FILTER (obs_status = 'ok') = 0""")
def _(t):
    done, retry = op.resolve_prices(t.observations, _ORDER)
    return done.select("card_ref_id", "finish", "price_cents", "source", F.lit("resolved").alias("outcome")).unionByName(
        retry.select(
            "card_ref_id", "finish", F.lit(None).cast("int").alias("price_cents"),
            F.lit(None).cast("string").alias("source"), F.lit("retry").alias("outcome"),
        )
    )


@query("agg_finish_spread", "v_refs", f"""
    SELECT card_ref_id, n_finishes, n_priced, min_cents, max_cents, narrow, chosen FROM {_spread_sql(_CLOSE)}""")
def _(t):
    return op.variant_spread(t.refs, _close_book(t), PriceParams().spread_pct)


_IDENTS = """(SELECT card_id, CASE WHEN confidence >= 15 THEN card_ref_id END AS card_ref_id, status FROM v_cards)"""


@query("variant_gate", "v_cards v_refs", f"""
    SELECT i.card_id, i.card_ref_id, CASE WHEN len(r.finishes) = 1 THEN r.finishes[1] END AS finish,
           coalesce(len(r.finishes) > 1, false) AS finish_needs_confirmation,
           CASE WHEN len(r.finishes) > 1 AND i.status = 'auto' THEN 'validation' ELSE i.status END AS status
    FROM {_IDENTS} i LEFT JOIN v_refs r ON r.id = i.card_ref_id""")
def _(t):
    idents = t.cards.select("card_id", F.when(F.col("confidence") >= 15, F.col("card_ref_id")).alias("card_ref_id"), "status")
    return op.variant_gate(idents, t.refs)


def _narrow_sql(book: str) -> str:
    return f"""SELECT c.card_id, c.card_ref_id, c.accepted_stage, c.quantity,
       CASE WHEN go THEN chosen ELSE c.finish END AS finish, CASE WHEN go THEN 'auto' ELSE c.status END AS status,
       c.finish_needs_confirmation AND NOT go AS finish_needs_confirmation
    FROM (SELECT r.*, s.chosen, coalesce(r.status = 'validation' AND r.finish_needs_confirmation
              AND r.accepted_stage IN ('h', 'multi', 'llm') AND s.chosen IS NOT NULL, false) AS go
          FROM {_REVIEW} r LEFT JOIN {_spread_sql(book)} s ON s.card_ref_id = r.card_ref_id) c"""


@query("variant_narrow", "v_cards v_refs", _narrow_sql(_CLOSE))
def _(t):
    return op.variant_narrow(review_cards(t), t.refs, _close_book(t), PriceParams().spread_pct)


_WORK = f"""(SELECT DISTINCT w.card_ref_id, w.finish
    FROM (SELECT c.card_ref_id, unnest(r.finishes) AS finish FROM v_cards c JOIN v_refs r ON r.id = c.card_ref_id) w
    WHERE NOT EXISTS (SELECT 1 FROM v_prices p WHERE p.card_ref_id = w.card_ref_id AND p.finish = w.finish AND {_FRESH}))"""
_BOOK = f"""(SELECT card_ref_id, finish, price_cents, source, TIMESTAMP '2000-06-01 00:00:00' AS fetched_at
             FROM {_RESOLVED} SEMI JOIN {_WORK} w USING (card_ref_id, finish)
      UNION ALL
      SELECT card_ref_id, finish, price_cents, source, fetched_at FROM v_prices
      ANTI JOIN (SELECT card_ref_id, finish FROM {_RESOLVED} SEMI JOIN {_WORK} w USING (card_ref_id, finish)) x
        USING (card_ref_id, finish))"""


@query("price_refresh", "v_cards v_refs v_prices v_obs", f"""
    SELECT 'price' AS part, card_ref_id || '/' || finish AS id, price_cents AS cents, source AS detail FROM {_BOOK}
    UNION ALL SELECT 'card', card_id, NULL, status || '/' || coalesce(finish, '') FROM ({_narrow_sql(_BOOK)})
    UNION ALL SELECT 'retry', card_ref_id || '/' || finish, NULL, NULL FROM {_WORK} ANTI JOIN {_RESOLVED} r USING (card_ref_id, finish)""")
def _(t):
    params = PriceParams(source_order=_ORDER, ttl_hours=TTL)
    book, cards, retry = op.price_refresh(review_cards(t), t.refs, t.prices, t.observations, lit_ts(AS_OF), params)
    key = F.concat_ws("/", F.col("card_ref_id").cast("string"), "finish")
    none_int, none_text = F.lit(None).cast("int").alias("cents"), F.lit(None).cast("string").alias("detail")
    return (
        book.select(F.lit("price").alias("part"), key.alias("id"), F.col("price_cents").alias("cents"), F.col("source").alias("detail"))
        .unionByName(cards.select(
            F.lit("card").alias("part"), F.col("card_id").alias("id"), none_int,
            F.concat(F.col("status"), F.lit("/"), F.coalesce("finish", F.lit(""))).alias("detail")))
        .unionByName(retry.select(F.lit("retry").alias("part"), key.alias("id"), none_int, none_text))
    )


_MONEY = "CASE WHEN price_cents IS NULL THEN NULL ELSE '$' || (price_cents // 100) || '.' || lpad(CAST(price_cents % 100 AS VARCHAR), 2, '0') END"


@query("fn_format_cents", "v_prices", f"SELECT card_ref_id, finish, {_MONEY} AS price FROM v_prices")
def _(t):
    return t.prices.select("card_ref_id", "finish", money.format_cents(F.col("price_cents")).alias("price"))


@query("fn_price_display", "v_star", f"""
    SELECT card_id, CASE WHEN NOT has_price_row THEN 'pending price' WHEN price_cents IS NULL THEN 'no price data' ELSE {_MONEY} END AS display,
           coalesce({_MONEY}, 'no price data') AS export_display FROM v_star""")
def _(t):
    c = F.col("price_cents")
    return star(t).select(
        "card_id", money.price_display(F.col("has_price_row"), c).alias("display"),
        money.export_price_display(c).alias("export_display"),
    )
