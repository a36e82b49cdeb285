"""Decision cascade: fuse method votes into a confidence and accept, send to review or reject."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.ranking import first_n
from entityflow.functions.text import json_block
from entityflow.operators.resolve import resolve
from entityflow.params import ACCEPT_STAGES, CascadeParams
from entityflow.sources.storage import materialise

METHODS = ("h", "a", "b", "c")
_EVIDENCE = "array<struct<method:string,ref_id:{0},score:double>>"


def wide_methods(methods: DataFrame) -> DataFrame:
    """One row per item from (item, method, ref, score, margin, agreement) rows, in one aggregation."""
    def of(m: str, c: str) -> Column:
        return F.max(F.when(F.col("method") == m, F.col(c)))

    aggs = []
    for m in METHODS:
        aggs += [of(m, "ref_id").alias(f"{m}_ref"), of(m, "score").alias(f"{m}_score")]
    return methods.groupBy("item_id").agg(*aggs, of("h", "margin").alias("margin"), of("h", "agreement").alias("agreement"))


def _evidence(names: str, ref_type: str) -> Column:
    rows = [
        F.when(
            F.col(f"{m}_score").isNotNull(),
            F.struct(F.lit(m).alias("method"), F.col(f"{m}_ref").alias("ref_id"), F.col(f"{m}_score").alias("score")),
        )
        for m in names
    ]
    return F.filter(F.array(*rows), lambda r: r.isNotNull()).cast(_EVIDENCE.format(ref_type))


def top_refs(evidence: Column, n: int = 3) -> Column:
    """Distinct refs of an evidence array by their best score; equal scores keep the array's order."""
    named = F.filter(evidence, lambda r: r["ref_id"].isNotNull())
    refs = F.array_distinct(F.transform(named, lambda r: r["ref_id"]))
    ranked = F.transform(
        refs,
        lambda ref, i: F.struct(
            (-F.array_max(F.transform(F.filter(named, lambda r: r["ref_id"] == ref), lambda r: r["score"]))).alias("k"),
            i.alias("i"), ref.alias("ref"),
        ),
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda x: x["ref"])


def _stage_h(p: CascadeParams) -> tuple[Column, Column]:
    confidence = F.lit(85) + F.least(F.col("margin"), F.lit(10))
    ok = F.col("h_ref").isNotNull() & (F.col("agreement") >= p.hash_agreement) & (confidence >= p.hash_only_accept)
    return F.coalesce(ok, F.lit(False)), confidence


def _stage_multi() -> tuple[Column, Column, Column]:
    """Refs are shared by at most one group among three methods; its mean runs over all members."""
    h, a, b = (F.col(f"{m}_ref") for m in "hab")
    hs, as_, bs = (F.col(f"{m}_score") for m in "hab")
    ha, hb, ab = h == a, h == b, a == b
    ref = F.when(ha | hb, h).when(ab, a)
    mean = (
        F.when(ha & hb, (hs + as_ + bs) / F.lit(3.0))
        .when(ha, (hs + as_) / F.lit(2.0))
        .when(hb, (hs + bs) / F.lit(2.0))
        .when(ab, (as_ + bs) / F.lit(2.0))
    )
    return ref.isNotNull(), ref, mean


def _stage_model() -> tuple[Column, Column]:
    c = F.col("c_ref")
    partner = F.coalesce(*[F.when(F.col(f"{m}_ref") == c, F.col(f"{m}_score")) for m in "hab"])
    mean = (F.col("c_score") + partner) / F.lit(2.0)
    return partner.isNotNull(), F.least(F.lit(85), F.greatest(F.lit(0), F.lit(70) + F.rint(mean * 15).cast("int")))


def decide_wide(wide: DataFrame, p: CascadeParams = CascadeParams()) -> DataFrame:
    """Decision of every wide row. Evidence holds only the methods that run before the item leaves."""
    ref_type = wide.schema["h_ref"].dataType.simpleString()
    is_h, h_conf = _stage_h(p)
    is_multi, multi_ref, multi_mean = _stage_multi()
    is_model, model_conf = _stage_model()
    staged = (
        wide.withColumn("_exit", F.when(is_h, "h").when(is_multi, "multi").when(is_model, "model").otherwise("none"))
        .withColumn("_multi_ref", multi_ref)
        .withColumn("_multi_conf", F.least(F.lit(100), F.greatest(F.lit(0), F.lit(90) + F.rint(multi_mean * 10).cast("int"))))
        .withColumn("_model_conf", model_conf)
        .withColumn("_h_conf", h_conf.cast("int"))
        .withColumn(
            "_best_conf",
            F.least(F.lit(60), F.rint(F.greatest(*[F.coalesce(F.col(f"{m}_score"), F.lit(0.0)) for m in METHODS]) * 100).cast("int")),
        )
    )
    e = F.col("_exit")
    confidence = (
        F.when(e == "h", F.col("_h_conf")).when(e == "multi", F.col("_multi_conf"))
        .when(e == "model", F.col("_model_conf")).otherwise(F.col("_best_conf"))
    )
    stage = (
        F.when(e.isin("h", "multi"), e)
        .when(e == "model", F.when(F.col("_model_conf") >= p.auto_accept, "llm").otherwise("validation"))
        .otherwise(F.when(F.col("_best_conf") < p.unreadable_below, "unreadable").otherwise("validation"))
    )
    ref = F.when(e == "h", F.col("h_ref")).when(e == "multi", F.col("_multi_ref")).when(e == "model", F.col("c_ref"))
    evidence = (
        F.when(e == "h", _evidence("h", ref_type)).when(e == "multi", _evidence("hab", ref_type))
        .otherwise(_evidence("habc", ref_type))
    )
    keep = [c for c in wide.columns if not any(c == f"{m}_{x}" for m in METHODS for x in ("ref", "score"))]
    return staged.select(
        *keep, ref.alias("ref_id"), confidence.alias("confidence"), stage.alias("stage"), evidence.alias("methods")
    ).withColumn("candidates", top_refs(F.col("methods")))


def decide(methods: DataFrame, p: CascadeParams = CascadeParams()) -> DataFrame:
    return decide_wide(wide_methods(methods), p).select(
        "item_id", "ref_id", "confidence", "stage", "candidates", "methods"
    )


def vote(methods: DataFrame) -> DataFrame:
    """Refs named by two or more methods of an item: the one with the highest mean score, earliest on a tie."""
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    groups = methods.where(F.col("ref_id").isNotNull()).groupBy("item_id", "ref_id").agg(
        F.count(F.lit(1)).alias("votes"), F.avg("score").alias("mean_score"), F.min(order).alias("_first")
    )
    won = F.max_by(F.struct("ref_id", "votes", "mean_score"), F.struct(F.round("mean_score", 12), -F.col("_first")))
    return groups.where(F.col("votes") >= 2).groupBy("item_id").agg(won.alias("w")).select("item_id", "w.*")


def top_candidates(methods: DataFrame, n: int = 3) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    # dealt once, by item: the refs of an item and their order are found where its few rows lie
    best = methods.where(F.col("ref_id").isNotNull()).select("item_id", "ref_id", "score", order.alias("_at")).repartition(
        "item_id").groupBy("item_id", "ref_id").agg(
        F.max("score").alias("score"), F.min("_at").alias("_first")
    )
    return first_n(best, ["item_id"], [F.desc("score"), F.asc("_first")], n).drop("_first")


def stage_status(stage: Column) -> Column:
    return F.when(stage.isin(*ACCEPT_STAGES), "auto").when(stage == "validation", "validation").otherwise("unreadable")


def quality_gate(items: DataFrame, quality: str, minimum: float) -> tuple[DataFrame, DataFrame]:
    """(readable, decisions of the unreadable): too poor an item gets confidence 0 and no further work."""
    ok = F.coalesce(F.col(quality) >= minimum, F.lit(False))
    poor = items.where(~ok).select("item_id", F.lit("unreadable").alias("stage"), F.lit(0).alias("confidence"))
    return items.where(ok), poor


Matcher = Callable[[DataFrame], DataFrame]


def identify(
    items: DataFrame, matchers: Mapping[str, Matcher], p: CascadeParams = CascadeParams(), quality: str | None = None,
    orient: Matcher | None = None,
) -> DataFrame:
    """Run the matchers in order of cost, each only on the items still open.

    ``orient`` takes the readable items and returns (item_id, rotation), which is settled before any matcher runs: the
    items that matchers get carry ``rotation`` (0 where none was found), and so does the result (0 for unreadable items).

    A matcher takes items and returns (item_id, ref_id, score), ``h`` also margin and agreement; an absent name
    is a skipped stage. ``h`` sees every readable item, ``a`` and ``b`` what ``h`` leaves open, ``c`` the rest.
    Each stage's votes are written once, as the next stage and the decision both read them.
    """
    poor = None
    if quality:
        items, poor = quality_gate(items, quality, p.quality_min)
    if orient is not None:
        turned = orient(items).select("item_id", F.col("rotation").alias("_turn"))
        items = items.join(turned, "item_id", "left").withColumn("rotation", F.coalesce("_turn", F.lit(0))).drop("_turn")
        items = materialise(items, "oriented")
    rotation = [] if orient is None else ["rotation"]
    votes = matchers["h"](items)
    ref_type = votes.schema["ref_id"].dataType.simpleString()
    wide = materialise(
        items.select("item_id", *rotation).join(
            votes.select("item_id", F.col("ref_id").alias("h_ref"), F.col("score").alias("h_score"), "margin", "agreement"),
            "item_id", "left",
        ).withColumn("h_score", F.coalesce("h_score", F.lit(0.0))),
        "votes-h",
    )

    def add_votes(wide: DataFrame, names: str, still_open: Column) -> DataFrame:
        left = items.join(wide.where(still_open).select("item_id"), "item_id", "left_semi")
        for m in names:
            if m in matchers:
                found = matchers[m](left).select("item_id", F.col("ref_id").alias(f"{m}_ref"), F.col("score").alias(f"{m}_score"))
                wide = wide.join(found, "item_id", "left")
            else:
                wide = wide.withColumn(f"{m}_ref", F.lit(None).cast(ref_type)).withColumn(f"{m}_score", F.lit(None).cast("double"))
        return wide

    by_hash = _stage_h(p)[0]
    wide = materialise(add_votes(wide, "ab", ~by_hash), "votes-hab")
    agreed = F.coalesce(_stage_multi()[0], F.lit(False))
    wide = add_votes(wide, "c", ~by_hash & ~agreed)
    out = decide_wide(wide, p).select("item_id", "ref_id", "confidence", "stage", "candidates", "methods", *rotation)
    if poor is not None:
        out = out.unionByName(poor.select(
            "item_id", F.lit(None).cast(ref_type).alias("ref_id"), "confidence", "stage",
            F.array().cast(f"array<{ref_type}>").alias("candidates"), F.array().cast(_EVIDENCE.format(ref_type)).alias("methods"),
            *[F.lit(0).alias(c) for c in rotation],
        ))
    return out


def cached_votes(items: DataFrame, cache: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Method ``c`` from stored answers: (votes, items whose answer has to be asked for).

    Items need ``content_key``; the cache holds (content_key, response). The answer's JSON block names ``name``, ``number``
    and ``confidence`` (0 to 100); the score is that confidence times the exactness of the entity that name and number
    resolve to. An answer without a block is a vote for nothing with score 0, and so is a confidence that is no number.
    """
    hits = items.select("item_id", "content_key").join(cache.select("content_key", "response"), "content_key", "left")
    missing = items.join(cache.select("content_key"), "content_key", "left_anti")
    block = json_block(F.col("response"))
    said = hits.where(F.col("response").isNotNull()).select("item_id", block.alias("_block")).select(
        "item_id", F.get_json_object("_block", "$.name").alias("name"), F.get_json_object("_block", "$.number").alias("number"),
        F.coalesce(F.get_json_object("_block", "$.confidence").try_cast("double"), F.lit(0.0)).alias("_sure"),
    )
    said = materialise(said, "answers")
    found = resolve(said.select("item_id", "name", "number"), refs)
    votes = found.join(said.select("item_id", "_sure"), "item_id").select(
        "item_id", "ref_id", (F.col("_sure") / F.lit(100.0) * F.col("exactness")).alias("score"))
    return votes, missing


def model_calls(idents: DataFrame, by: list[str]) -> DataFrame:
    """Items whose evidence holds method ``c``, per key: one call each."""
    calls = F.size(F.filter("methods", lambda m: m["method"] == "c"))
    return idents.groupBy(*by).agg(F.sum(calls.cast("bigint")).alias("llm_calls"))
