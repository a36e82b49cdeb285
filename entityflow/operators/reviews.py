"""Review feedback: applying decisions, merging duplicates, feeding corrections into the index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entityflow.functions.ranking import first_n
from entityflow.operators.index import cap_newest, fingerprint_rows
from entityflow.params import RESOLVED, HashParams
from entityflow.sources.storage import materialise

_GROUP = ["batch_id", "card_ref_id", "finish"]


def _same_group(a: str, b: str):
    """Equal batch and entity, and variants equal or both missing."""
    return (
        (F.col(f"{a}.batch_id") == F.col(f"{b}.batch_id"))
        & (F.col(f"{a}.card_ref_id") == F.col(f"{b}.card_ref_id"))
        & F.col(f"{a}.finish").eqNullSafe(F.col(f"{b}.finish"))
    )


def dup_candidates(cards: DataFrame) -> DataFrame:
    """For each item the earliest other resolved item of its batch with the same entity and variant.

    Only the two earliest of a group can be anybody's target, so no group is joined with itself.
    """
    resolved = cards.where(F.col("status").isin(*RESOLVED) & F.col("card_ref_id").isNotNull())
    two = first_n(resolved.select(*_GROUP, "card_id", "created_at"), _GROUP, [F.col("created_at"), F.col("card_id")], 2)
    heads = two.groupBy(*_GROUP).agg(
        F.max(F.when(F.col("rn") == 1, F.col("card_id"))).alias("_first"),
        F.max(F.when(F.col("rn") == 2, F.col("card_id"))).alias("_second"),
    )
    target = F.when(F.col("_first") != F.col("card_id"), F.col("_first")).otherwise(F.col("_second"))
    return (
        cards.alias("c").join(heads.alias("g"), _same_group("c", "g"))
        .select("c.card_id", target.alias("target_id")).where(F.col("target_id").isNotNull())
    )


def merge_duplicates(cards: DataFrame) -> DataFrame:
    """Collapse resolved items of one batch, entity and variant into the earliest: it gains one per merged item."""
    resolved = F.col("status").isin(*RESOLVED) & F.col("card_ref_id").isNotNull()
    groups = cards.where(resolved).groupBy(*_GROUP).agg(
        F.min_by("card_id", F.struct("created_at", "card_id")).alias("_keep"), F.count(F.lit(1)).alias("_n")
    )
    return _collapse(cards, groups.where(F.col("_n") > 1), resolved, F.lit(True))


def _collapse(cards: DataFrame, groups: DataFrame, member, mergeable) -> DataFrame:
    """Give ``_keep`` one unit per merged row and turn the group's other mergeable rows into ``merged`` with 0."""
    flagged = cards.withColumn("_member", member).withColumn("_mergeable", mergeable)
    joined = flagged.alias("c").join(groups.alias("g"), _same_group("c", "g") & F.col("c._member"), "left")
    kept = F.coalesce(F.col("g._keep") == F.col("c.card_id"), F.lit(False))
    gone = F.coalesce((F.col("g._keep") != F.col("c.card_id")) & F.col("c._mergeable"), F.lit(False))
    added = (F.col("g._n") - 1).cast("int")
    quantity = F.when(kept, F.col("c.quantity") + added).when(gone, F.lit(0)).otherwise(F.col("c.quantity"))
    status = F.when(gone, F.lit("merged")).otherwise(F.col("c.status"))
    columns = {"quantity": quantity, "status": status}
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(f"c.{c}") for c in cards.columns])


def apply_reviews(cards: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, corrections) after reviews (card_id, chosen_ref, chosen_finish, reviewed_at) of waiting items.

    The chosen entity equal to the predicted one validates, another corrects; a given variant is set and clears
    the flag. Then each reviewed item joins the earliest resolved item of its batch with the same entity and
    variant: an item that was resolved before, else the one reviewed first. Each review is
    compared with the choice before it and gives a correction; the last one decides the item, and a variant once given
    stays until another is given.
    """
    line = Window.partitionBy("card_id").orderBy("reviewed_at")
    stepped = reviews.select(
        "card_id", "chosen_ref", "reviewed_at", F.lag(F.struct("chosen_ref")).over(line).alias("_before"),
        F.last("chosen_finish", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("chosen_finish"),
        F.lit(True).alias("_step"), F.lead(F.lit(True)).over(line).isNull().alias("_last"),
    )
    # one row per item and review, read by the corrections, the groups and the result
    joined = materialise(cards.join(stepped, "card_id", "left"), "reviewed-items")
    seen = F.col("reviewed_at").isNotNull()
    predicted = F.when(F.col("_before").isNotNull(), F.col("_before.chosen_ref")).otherwise(F.col("card_ref_id"))
    right = F.col("chosen_ref").eqNullSafe(predicted)
    given = seen & F.col("chosen_finish").isNotNull()
    updated = joined.where(F.col("_step").isNull() | F.col("_last")).select(
        *[c for c in cards.columns if c not in ("card_ref_id", "status", "finish", "finish_needs_confirmation")],
        "reviewed_at",
        F.when(seen, F.col("chosen_ref")).otherwise(F.col("card_ref_id")).alias("card_ref_id"),
        F.when(seen & right, "validated").when(seen, "corrected").otherwise(F.col("status")).alias("status"),
        F.when(given, F.col("chosen_finish")).otherwise(F.col("finish")).alias("finish"),
        (F.col("finish_needs_confirmation") & ~given).alias("finish_needs_confirmation"),
    )
    corrections = joined.where(F.col("_step")).select(
        "card_id", predicted.alias("predicted_ref_id"), F.col("chosen_ref").alias("actual_ref_id"), "reviewed_at"
    )
    member = F.col("status").isin(*RESOLVED) & F.col("card_ref_id").isNotNull()
    order = F.struct(seen, F.coalesce("reviewed_at", "created_at"), F.col("card_id"))
    groups = materialise(updated.where(member).groupBy(*_GROUP).agg(
        F.min_by("card_id", order).alias("_keep"), (F.count_if(seen) + F.when(F.min(seen), 0).otherwise(1)).alias("_n"),
    ).where(F.col("_n") > 1), "review-groups")
    # only the kept item of a group and its reviewed ones change: they are found by group and sent to the rows by item, so
    # that the rows themselves are dealt by item only
    gone = updated.where(member & seen).alias("c").join(groups.alias("g"), _same_group("c", "g")).where(
        F.col("g._keep") != F.col("c.card_id")).select("c.card_id", *[f"c.{k}" for k in _GROUP], F.lit(None).cast("bigint").alias("_n"))
    kept = groups.select(F.col("_keep").alias("card_id"), *_GROUP, "_n")
    changes = kept.unionByName(gone).groupBy("card_id").agg(F.collect_set(F.struct(*_GROUP, "_n")).alias("_changes"))
    mine = F.filter("_changes", lambda x: (
        (x["batch_id"] == F.col("batch_id")) & (x["card_ref_id"] == F.col("card_ref_id")) & x["finish"].eqNullSafe(F.col("finish"))))
    merged = updated.join(changes, "card_id", "left").withColumn("_change", F.when(member, F.get(mine, F.lit(0))))
    keeps, goes = F.col("_change._n").isNotNull(), F.col("_change").isNotNull() & F.col("_change._n").isNull() & seen
    changed = {
        "quantity": F.when(keeps, F.col("quantity") + (F.col("_change._n") - 1).cast("int")).when(goes, F.lit(0)).otherwise(F.col("quantity")),
        "status": F.when(goes, F.lit("merged")).otherwise(F.col("status")),
    }
    return merged.select(*[changed.get(c, F.col(c)).alias(c) for c in cards.columns]), corrections


def correction_rows(corrections: DataFrame, crops: DataFrame, index: DataFrame, p: HashParams = HashParams()) -> tuple[DataFrame, DataFrame]:
    """(log, index): one log row per correction with the crop's content hash, five validated fingerprints each,
    and the index cut back to the newest ``cap`` per (owner, tier).

    ``crops`` has (card_id, crop_hash, coef); a correction without its crop is dropped.
    """
    corrections = materialise(corrections, "corrections")
    ids = corrections.select("card_id")
    # hashes and coefficients are wide: only crops that a correction names get a hash, and few need their coefficients
    named = crops.join(ids, "card_id", "left_semi").select("card_id", "crop_hash")
    log = materialise(corrections.join(named, "card_id").select(
        "card_id", "crop_hash", "predicted_ref_id", "actual_ref_id", F.col("reviewed_at").alias("created_at")), "correction-log")
    # only an owner's newest corrections can stay in any tier, so only theirs are computed
    new = corrections.join(log.select("card_id"), "card_id", "left_semi").select(
        F.col("actual_ref_id").alias("ref_id"), F.lit("user_validated").alias("source"),
        F.col("reviewed_at").alias("created_at"), F.col("card_id").alias("row_id"),
    )
    new = materialise(first_n(new, ["ref_id"], [F.desc("created_at"), F.desc("row_id")], p.user_validated_cap).drop("rn"), "corrections-newest")
    wanted = crops.select(F.col("card_id").alias("row_id"), "coef").join(new.select("row_id"), "row_id", "left_semi")
    return log, cap_newest(index.unionByName(fingerprint_rows(new.join(wanted, "row_id").select(*new.columns, "coef"))), p.user_validated_cap)


# Status events of exports and of items, as event -> (allowed current states, new state).
EXPORT_EVENTS = {
    "claim": (("queued",), "rendering"),
    "ready": (("rendering",), "ready"),
    "fail": (("rendering",), "failed"),
}
ITEM_EVENTS = {
    "skip": (("validation",), "skipped"),
    "not_card": (("validation",), "not_card"),
    "broken": (("pending", "validation"), "unreadable"),
}


def _longest_chain(machine: Mapping[str, tuple[Sequence[str], str]]) -> int:
    def steps(state: str, path: tuple[str, ...]) -> int:
        if state in path:
            raise ValueError("the status machine has a cycle")
        nxt = {to for allowed, to in machine.values() if state in allowed}
        return max((1 + steps(to, path + (state,)) for to in nxt), default=0)

    return max(steps(s, ()) for allowed, _ in machine.values() for s in allowed)


def apply_events(
    ledger: DataFrame, events: DataFrame, machine: Mapping[str, tuple[Sequence[str], str]], carry: Sequence[str] = ()
) -> DataFrame:
    """Ledger (key, status, since, ...) after the events (key, ts, event_id, event, ...), whatever the status was.

    The last known event of a key decides its status; each ``carry`` column takes its last value that is not NULL.
    One partial aggregate and one join.
    """
    order = F.struct("ts", "event_id")
    last = events.where(F.col("event").isin(*machine)).groupBy("key").agg(
        F.max_by(F.struct("event", "ts"), order).alias("_e"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in carry],
    )
    status = F.col("status")
    for event, (_guard, to) in machine.items():
        status = F.when(F.col("_e.event") == event, to).otherwise(status)
    changed = {"status": status, "since": F.coalesce("_e.ts", "since"), **{c: F.coalesce(f"_{c}", c) for c in carry}}
    return ledger.join(last, "key", "left").select(*[changed.get(c, F.col(c)).alias(c) for c in ledger.columns])


def apply_transitions(
    ledger: DataFrame, events: DataFrame, machine: Mapping[str, tuple[Sequence[str], str]], carry: Sequence[str] = ()
) -> DataFrame:
    """Ledger (key, status, since, ...) after the events (key, ts, event_id, event, ...) in order.

    An event whose guard does not hold at its time does nothing. Each round finds the next event that applies to
    every key at once, and an acyclic machine is done after as many rounds as its longest chain, so no key's
    events are ever gathered. ``carry`` columns of an applied event replace the ledger's where not NULL.
    """
    known = events.where(F.col("event").isin(*machine)).select("key", "ts", "event_id", "event", *carry)
    state = ledger.withColumn("_seen", F.struct(F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(None).cast("bigint").alias("i")))
    rounds = _longest_chain(machine)
    for done in range(rounds):
        allowed = F.lit(False)
        for event, (guard, _to) in machine.items():
            allowed = allowed | ((F.col("event") == event) & F.col("status").isin(*guard))
        after = F.col("_seen.t").isNull() | (F.struct(F.col("ts").alias("t"), F.col("event_id").alias("i")) > F.col("_seen"))
        nxt = known.join(state.select("key", "status", "_seen"), "key").where(allowed & after).groupBy("key").agg(
            F.min_by(F.struct("event", "ts", "event_id", *carry), F.struct("ts", "event_id")).alias("_e")
        )
        new_status = F.lit(None).cast("string")
        for event, (_guard, to) in machine.items():
            new_status = F.when(F.col("_e.event") == event, to).otherwise(new_status)
        hit = F.col("_e").isNotNull()
        changed = {
            "status": F.coalesce(new_status, "status"), "since": F.coalesce("_e.ts", "since"),
            "_seen": F.when(hit, F.struct(F.col("_e.ts").alias("t"), F.col("_e.event_id").alias("i"))).otherwise(F.col("_seen")),
            **{c: F.coalesce(f"_e.{c}", c) for c in carry},
        }
        state = state.join(nxt, "key", "left").select(*[changed.get(c, F.col(c)).alias(c) for c in state.columns])
        if done + 1 < rounds:
            state = materialise(state, "transitions")  # the next round reads it twice
    return state.drop("_seen")
