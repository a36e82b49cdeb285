"""A time-varying curriculum over sources.

Each source has a weight schedule over training time 0..1, piecewise linear between knots. Its integral is the source's
weight in the mix: the sources share all words by weight, each stopping at ``most`` times its own size, the excess
shared again among the rest by weight. Over time a source is demanded in proportion to its schedule; inverting that
cumulative demand gives each document, met in the order of a hash of its id, its training position. Sources that are
asked for more than they have are repeated, each round in the same order.

Everything is a Spark expression. The running sum within a source goes over slots of the hash, so a source with a third
of all rows is summed by as many tasks as there are slots. Edge cases: a NULL text has size 0 and is taken 0 times; a
NULL source is a source of its own, last in order; repeated rows are documents each; an empty table or only empty texts
give targets of 0; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.llm.common import boxed, words
from entityflow.sources.storage import materialise

Knots = Sequence[tuple[float, float]]
# Schedules (time, weight) that the sources take in turn, in order of their names; the integrals are 5, 2 and 1.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0)),
)
_SLOT_DIGITS = 3  # hex digits of the hash: 4,096 slots a source


def integral(knots: Knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def _position(which: Column, u: Column, schedules: Sequence[Knots]) -> Column:
    """The time at which the share ``u`` of the demand of schedule number ``which`` is reached."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        whole, done, inner = integral(knots), 0.0, F.lit(knots[-1][0])
        pieces = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            slope = (w1 - w0) / (t1 - t0)
            rest = u * whole - done
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest))
            # the root of w0 x + slope x^2 / 2 = rest that also holds where the slope is 0
            x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (w0 + root))
            done += (t1 - t0) * (w0 + w1) / 2
            pieces.append((done, F.least(F.lit(t1), t0 + x)))
        for end, at in reversed(pieces):
            inner = F.when(u * whole <= end, at).otherwise(inner)
        out = F.when(which == k, inner).otherwise(out)
    return out


def targets(totals: DataFrame, schedules: Sequence[Knots] = SCHEDULES, most: int = 3) -> DataFrame:
    """``totals`` (source, source_size) with ``schedule``, ``weight`` and ``target``. One row per source."""
    weights = F.array(*[F.lit(float(integral(k))) for k in schedules])
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("schedule", ((F.row_number().over(turn) - 1) % len(schedules)).cast("int")).withColumn(
        "weight", F.get(weights, F.col("schedule")))
    # Sources are capped in the order of what they have per weight: each is offered the level that is left when those
    # before it are capped, and the highest such level is the one at which nobody above the cap is left.
    capped = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(capped), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(capped), F.lit(0.0))
    level = ranked.withColumn("level", left / weight_left).withColumn("level", F.max("level").over(everything))
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.col("level") * F.col("weight"))
    return level.withColumn("target", F.greatest(F.lit(0.0), target)).drop("level")


def allocate(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    schedules: Sequence[Knots] = SCHEDULES, most: int = 3, keep_rows: bool = True,
) -> DataFrame:
    """Every row, boxed (only the id unless ``keep_rows``), with ``source``, ``size``, ``source_size``, ``target``,
    ``schedule``, ``before`` (words of its source before it), ``taken`` (its words in the mix, repeats counted; the
    document at the end of a target is taken in part) and ``goal`` (the source's target in whole words)."""
    size = F.size(words(F.col(text))).cast("long")
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("name")  # never NULL
    whole = boxed(df, source=F.col(source), name=named, size=size, order=F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")))
    if not keep_rows:
        whole = whole.withColumn("row", F.struct(F.col("row").getField(doc_id).alias(doc_id)))
    sized = materialise(whole.withColumn("slot", F.substring("order", 1, _SLOT_DIGITS)), "mix-sizes")
    slots = materialise(sized.groupBy("source", "name", "slot").agg(F.sum("size").alias("slot_size")), "mix-slots")
    sources = targets(slots.groupBy("source", "name").agg(F.sum("slot_size").alias("source_size")), schedules, most)
    before = Window.partitionBy("name").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.withColumn("start", F.coalesce(F.sum("slot_size").over(before), F.lit(0).cast("long"))).join(
        sources.drop("source"), "name").select("name", "slot", "start", "source_size", "target", "schedule")
    # the window and the join are dealt by the same keys, so rows move once
    within = Window.partitionBy("name", "slot").orderBy("order", F.col("row").getField(doc_id), "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))).join(
        starts, ["name", "slot"])
    goal = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    last = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("goal") - F.col("rounds") * F.col("source_size") - F.col("before")))
    return (
        placed.select("row", "source", "size", "source_size", "target", "schedule", (F.col("start") + F.col("inside")).alias("before"),
                      goal.alias("goal"), rounds.cast("long").alias("rounds"))
        .withColumn("taken", F.col("rounds") * F.col("size") + last).drop("rounds")
    )


def positioned(allocated: DataFrame, schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """One row per copy of a document that the mix takes, with ``copy`` (from 0), ``words`` (of the copy in the mix) and
    ``position`` (0..1, of the copy's middle word)."""
    copies = F.ceil(F.col("taken") / F.when(F.col("size") > 0, F.col("size")))
    each = allocated.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    part = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    middle = F.col("copy") * F.col("source_size") + F.col("before") + part / 2
    return each.withColumn("words", part).withColumn(
        "position", _position(F.col("schedule"), F.least(F.lit(1.0), middle / F.col("goal")), schedules)
    ).withColumn("copy", F.col("copy").cast("int"))


def ordered(copies: DataFrame, doc_id: str) -> DataFrame:
    """Placed copies in training order, dealt by ranges of it."""
    order = ["position", F.col("row").getField(doc_id), "copy"]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
        schedules: Sequence[Knots] = SCHEDULES, most: int = 3) -> DataFrame:
    """The documents of the mix in training order: whole copies (one at a target's end is in if at least half of it is),
    range-sorted by position, with the columns of ``df``."""
    placed = positioned(allocate(df, text, doc_id, source, schedules, most), schedules)
    return ordered(placed.where("2 * words >= size"), doc_id).select("row.*")


def takes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
          schedules: Sequence[Knots] = SCHEDULES, most: int = 3) -> DataFrame:
    """Every document, boxed with its id alone, with ``size``, ``source_size``, ``target`` and ``taken``: the words that its
    copies have in the mix. The mix is written in training order first, and what is taken is read from there."""
    placed = materialise(allocate(df, text, doc_id, source, schedules, most, keep_rows=False), "mix-placed")
    mixed = materialise(ordered(positioned(placed, schedules), doc_id), "mix-order")
    # within a source the words before it name a document that has any
    own = mixed.groupBy("source", "before").agg(F.sum("words").alias("found")).select(
        F.col("source").alias("of"), F.col("before").alias("at"), "found")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.when(F.col("size") > 0, F.col("before")) == F.col("at"))
    return placed.drop("taken").join(own, same, "left").select(
        "row", "size", "source_size", "target", F.coalesce("found", F.lit(0).cast("long")).alias("taken"))
