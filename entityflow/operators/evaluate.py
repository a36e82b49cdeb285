"""Accuracy evaluation against a manifest of expected items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.params import ACCEPT_STAGES
from entityflow.sources.storage import materialise


def score_items(manifest: DataFrame, idents: DataFrame) -> DataFrame:
    """Expected items against identifications at the same (file, pos); a missing one is a missed detection."""
    got = idents.select("file", "pos", F.col("ref_id").alias("got"), F.col("stage").alias("accepted_stage"))
    stage = F.col("accepted_stage")
    outcome = (
        F.when(stage.isNull(), "missed_detection").when(stage == "unreadable", "unreadable")
        .when(stage.isin(*ACCEPT_STAGES) & F.col("got").eqNullSafe(F.col("expected")), "auto_accepted_correct")
        .when(stage.isin(*ACCEPT_STAGES), "auto_accepted_WRONG")
        .otherwise("sent_to_validation")
    )
    return manifest.join(got, ["file", "pos"], "left").select(
        "file", "pos", F.coalesce("scenario", F.lit("unknown")).alias("scenario"),
        F.coalesce("finish", F.lit("unknown")).alias("finish"), "expected", "got", "accepted_stage", outcome.alias("outcome"),
    )


def metrics(rows: DataFrame) -> DataFrame:
    """Totals and rates overall and split by scenario, variant and exit stage. Without rows the overall row has total 0
    and rates 0.0."""
    staged = rows.withColumn("stage", F.coalesce("accepted_stage", F.lit("none")))
    accepted = F.col("outcome").isin("auto_accepted_correct", "auto_accepted_WRONG")
    # counted once by all three: both aggregates below read the same few counts, so the rows are not scored twice
    counts = staged.groupBy("scenario", "finish", "stage").agg(
        F.count(F.lit(1)).alias("_total"), F.count_if(accepted).alias("_accepted"),
        F.count_if(F.col("outcome") == "auto_accepted_WRONG").alias("_wrong"), F.count_if(F.col("accepted_stage") == "h").alias("_hits"),
    )
    n = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    total = n("_total")
    rate = lambda c: F.coalesce(F.bround(n(c) / F.when(total > 0, total), 4), F.lit(0.0))
    split = F.when(F.grouping("scenario") == 0, "scenario").when(F.grouping("finish") == 0, "finish").otherwise("stage")
    figures = [
        total.alias("total"), n("_accepted").alias("auto_accepted"), n("_wrong").alias("wrong"),
        rate("_accepted").alias("auto_accept_rate"), rate("_hits").alias("hash_tier_hit_rate"),
    ]
    sets = [[F.col("scenario")], [F.col("finish")], [F.col("stage")]]
    parts = counts.groupingSets(sets, "scenario", "finish", "stage").agg(split.alias("split"), *figures)
    # grouping sets over no rows give no row, so the overall row is an aggregate of its own
    whole = counts.agg(*figures).select(F.lit("all").alias("split"), F.lit("all").alias("value"), "*")
    return whole.unionByName(parts.select("split", F.coalesce("scenario", "finish", "stage").alias("value"), *whole.columns[2:]))


def wrong_accepts(rows: DataFrame) -> DataFrame:
    """The scored rows that were accepted with another entity than expected."""
    return rows.where(F.col("outcome") == "auto_accepted_WRONG").select("file", "pos", "expected", "got", "accepted_stage")


def gate(summary: DataFrame, baseline_rate: float, tolerance: float = 0.01, rows: DataFrame | None = None, named: int = 20) -> DataFrame:
    """Pass or fail of a metrics table: any wrong accept fails, and so does a rate too far below the baseline.

    With the scored ``rows``, ``detail`` names the first ``named`` wrong accepts by file and position, or the two rates;
    ``wrong`` counts them all and ``wrong_accepts`` lists them.
    """
    low = F.col("auto_accept_rate") < F.lit(baseline_rate - tolerance)
    reason = F.when(F.col("wrong") > 0, "wrong auto-accept").when(low, "auto-accept rate below baseline").otherwise("ok")
    verdict = summary.where(F.col("split") == "all").select(
        (reason == "ok").alias("passed"), reason.alias("reason"), "auto_accept_rate", "wrong"
    )
    if rows is None:
        return verdict
    told = F.concat(F.col("file").cast("string"), F.lit("#"), F.col("pos").cast("string"), F.lit(" "),
                    F.coalesce(F.col("expected").cast("string"), F.lit("none")), F.lit("->"), F.coalesce(F.col("got").cast("string"), F.lit("none")))
    worst = wrong_accepts(rows).select("file", "pos", told.alias("told")).orderBy("file", "pos", "told").limit(named)
    names = worst.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "pos", "told"))), lambda x: x["told"]), ", ").alias("_names"))
    rates = F.concat(F.lit("auto_accept_rate "), F.col("auto_accept_rate").cast("string"), F.lit(f" < baseline {baseline_rate} - {tolerance}"))
    detail = F.when(F.col("wrong") > 0, F.col("_names")).when(~F.col("passed"), rates).otherwise("")
    # both sides are one row
    return verdict.withColumn("_one", F.lit(1)).join(names.withColumn("_one", F.lit(1)), "_one").withColumn("detail", detail).drop("_one", "_names")


def evaluate(manifest: DataFrame, idents: DataFrame, baseline_rate: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored rows, metrics, gate)."""
    rows = materialise(score_items(manifest, idents), "scored-items")  # read by the metrics, the gate and the caller
    summary = metrics(rows)
    return rows, summary, gate(summary, baseline_rate, rows=rows)
