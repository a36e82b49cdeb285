"""Price book: freshness, ordered sources, refresh worklist, and the variant rules that read prices.

A NULL price is a known miss and counts as an answer; an absent row was never fetched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.joins import left_join_sparse
from entityflow.functions.ranking import newest
from entityflow.params import ACCEPT_STAGES, FINISHES, PriceParams
from entityflow.sources.storage import materialise

KEY = ["card_ref_id", "finish"]


def is_fresh(fetched_at: Column, as_of: Column, ttl_hours: int) -> Column:
    return fetched_at > as_of - F.make_dt_interval(hours=F.lit(ttl_hours))


def fresh_prices(prices: DataFrame, keys: DataFrame, as_of: Column, ttl_hours: int) -> DataFrame:
    """(fresh, price_cents) for every asked key; stale and absent keys are not fresh and carry no price."""
    live = prices.where(is_fresh(F.col("fetched_at"), as_of, ttl_hours)).select(
        *KEY, "price_cents", F.lit(True).alias("fresh")
    )
    return keys.select(*KEY).join(live, KEY, "left").select(
        *KEY, F.coalesce("fresh", F.lit(False)).alias("fresh"), "price_cents"
    )


def price_worklist(idents: DataFrame, refs: DataFrame, prices: DataFrame, as_of: Column, ttl_hours: int) -> DataFrame:
    """Distinct (ref, variant) of resolved items that have no fresh price row."""
    wanted = wanted_keys(idents, refs)
    fresh = prices.where(is_fresh(F.col("fetched_at"), as_of, ttl_hours)).select(*KEY)
    return wanted.join(fresh, KEY, "left_anti")


def wanted_keys(idents: DataFrame, refs: DataFrame) -> DataFrame:
    # distinct entities first: popular ones collapse before the join
    seen = idents.where(F.col("card_ref_id").isNotNull()).select("card_ref_id").distinct()
    return seen.join(refs.select(F.col("id").alias("card_ref_id"), "finishes"), "card_ref_id").select(
        "card_ref_id", F.explode(F.array_distinct("finishes")).alias("finish")
    )


def resolve_prices(observations: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(resolved, retry): per key the first source in ``order`` that answered, and the keys nobody answered.

    Observations carry (card_ref_id, finish, source, obs_status, cents, observed_at, obs_id); of one source's
    answers the latest counts. Sources outside ``order`` are ignored.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    known = observations.where(F.col("source").isin(*order))
    answered = F.col("obs_status") == "ok"
    # one pass: the winner by (priority, latest) among answers, or none
    best = known.groupBy(*KEY).agg(
        F.max_by(
            F.struct("cents", "source", "observed_at"),
            F.when(answered, F.struct(-rank, F.col("observed_at"), F.col("obs_id"))),
        ).alias("win"),
        F.count_if(answered).alias("answers"),
        F.max("observed_at").alias("last_try"),
    )
    resolved = best.where(F.col("answers") > 0).select(
        *KEY, F.col("win.cents").alias("price_cents"), F.col("win.source").alias("source"),
        F.col("win.observed_at").alias("fetched_at"),
    )
    return resolved, best.where(F.col("answers") == 0).select(*KEY, "last_try")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], version: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Keyed merge, new rows winning on every column; of several new rows the greatest ``order_by`` wins.

    ``version`` names the column both sides get the stamp in: 0 for kept rows, 1 for written ones.
    """
    old = target.withColumn(version, F.lit(0))
    new = source.withColumn(version, F.lit(1))
    return newest(old.unionByName(new), keys, [version, *order_by])


def upsert_prices(prices: DataFrame, resolved: DataFrame) -> DataFrame:
    return upsert(prices, resolved, KEY, "_new", ["fetched_at"]).drop("_new")


def variant_spread(refs: DataFrame, prices: DataFrame, pct: float) -> DataFrame:
    """Per entity: may its variants be treated as one price, and which variant stands for them.

    Needs every variant priced, a positive minimum, and (max - min) / min * 100 at most ``pct``.
    """
    wanted = refs.select(F.col("id").alias("card_ref_id"), "finishes", F.explode("finishes").alias("finish"))
    priced = wanted.join(prices.select(*KEY, "price_cents"), KEY, "left")
    c = F.col("price_cents")
    g = priced.groupBy("card_ref_id").agg(
        F.first("finishes").alias("finishes"),
        F.count(F.lit(1)).alias("n_finishes"),
        F.count(c).alias("n_priced"),
        F.min(c).alias("min_cents"),
        F.max(c).alias("max_cents"),
    )
    canonical = F.filter(F.array(*[F.lit(f) for f in FINISHES]), lambda f: F.array_contains(F.col("finishes"), f))
    lo, hi = F.col("min_cents").cast("double"), F.col("max_cents").cast("double")
    narrow = (F.col("n_priced") == F.col("n_finishes")) & (F.col("min_cents") > 0) & (F.try_divide(hi - lo, lo) * 100.0 <= F.lit(float(pct)))
    return g.select(
        "card_ref_id", "n_finishes", "n_priced", "min_cents", "max_cents",
        F.coalesce(narrow, F.lit(False)).alias("narrow"),
        F.when(narrow, F.try_element_at(canonical, F.lit(1))).alias("chosen"),
    )


def variant_gate(idents: DataFrame, refs: DataFrame) -> DataFrame:
    """Several variants: confirmation needed and ``auto`` becomes ``validation``; exactly one: taken; none: left."""
    known = refs.select(F.col("id").alias("card_ref_id"), F.size("finishes").alias("_n"), F.try_element_at("finishes", F.lit(1)).alias("_only"))
    many = F.coalesce(F.col("_n") > 1, F.lit(False))
    return (
        left_join_sparse(idents, known, ["card_ref_id"], "card_id")
        .withColumn("finish", F.when(F.col("_n") == 1, F.col("_only")))
        .withColumn("finish_needs_confirmation", many)
        .withColumn("status", F.when(many & (F.col("status") == "auto"), "validation").otherwise(F.col("status")))
        .drop("_n", "_only")
    )


def variant_narrow(cards: DataFrame, refs: DataFrame, prices: DataFrame, pct: float) -> DataFrame:
    """Close review rows that wait only for a variant whose price hardly matters; all others pass unchanged."""
    choice = variant_spread(refs, prices, pct).where(F.col("chosen").isNotNull()).select("card_ref_id", "chosen")
    open_row = (
        (F.col("status") == "validation")
        & F.col("finish_needs_confirmation")
        & F.col("accepted_stage").isin(*ACCEPT_STAGES)
        & F.col("chosen").isNotNull()
    )
    return (
        left_join_sparse(cards, choice, ["card_ref_id"], "card_id")
        .withColumn("_go", F.coalesce(open_row, F.lit(False)))
        .withColumn("finish", F.when(F.col("_go"), F.col("chosen")).otherwise(F.col("finish")))
        .withColumn("status", F.when(F.col("_go"), "auto").otherwise(F.col("status")))
        .withColumn("finish_needs_confirmation", F.col("finish_needs_confirmation") & ~F.col("_go"))
        .drop("_go", "chosen")
    )


def price_refresh(
    cards: DataFrame, refs: DataFrame, prices: DataFrame, observations: DataFrame, as_of: Column,
    p: PriceParams = PriceParams(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prices, cards, retry): fetch what is stale, merge it, then narrow every card, fresh entities included. What is
    wanted and not resolved is tried again, whether it was observed or not."""
    work = materialise(price_worklist(cards, refs, prices, as_of, p.ttl_hours), "price-worklist")
    resolved, _ = resolve_prices(observations.join(work, KEY, "left_semi"), p.source_order)
    resolved = materialise(resolved, "price-resolved")
    retry = work.join(resolved.select(*KEY), KEY, "left_anti")
    book = upsert_prices(prices, resolved.withColumn("fetched_at", as_of))
    return book, variant_narrow(cards, refs, book, p.spread_pct), retry
