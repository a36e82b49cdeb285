"""Risk-controlled quality rules.

A rule rejects a text whose statistic exceeds a cutoff. Cutoffs are chosen on labelled holdout texts, per stratum: going
from the loosest cutoff to stricter ones, a cutoff stands as long as an exact binomial test shows that it rejects at most
a share ``risk`` of good texts. Going in a fixed order needs no correction between the cutoffs of one rule; between rules
and strata the level is divided (Bonferroni), and the risk of a stratum is divided among its rules, so that with
probability ``1 - level`` no stratum loses more than ``risk`` of its good texts to the learned rules. Among cutoffs that
stand, the one that rejects most bad texts is taken, good texts counting against it. No evidence, no rejection.

Everything is a Spark expression. Edge cases: a NULL text has no words; a NULL or unlisted stratum value belongs to the
stratum ``other``; labels of unknown documents, NULL labels and repeated labels are ignored (a document with both labels
counts as bad); repeated rows are judged alike; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from entityflow.llm.common import boxed, let, unboxed, words
from entityflow.sources.storage import materialise

SYMBOLS = "#*$%&|<>"
UPPER = "A-Z"
# Up to this many different repeated windows a text's windows are looked up in a list, beyond it they are sorted.
_FEW = 48


@dataclass(frozen=True)
class QualityParams:
    strata: tuple[str, ...] = ("de", "en", "es", "fr")  # values with a stratum of their own
    risk: float = 0.05  # most good texts a stratum may lose to the learned rules
    level: float = 0.05  # probability that any stratum loses more
    price: float = 10.0  # bad texts that must go for one good text lost
    min_words: int = 50
    max_repeat: int = 50  # per cent of words in repeated windows
    # statistic -> cutoffs, loosest first
    cutoffs: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("symbol_share", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
        ("dup_line_share", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
        ("repeat_share", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
        ("upper_share", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15)),
    )


def _count_of(text: Column, chars: str) -> Column:
    """Characters of a Java character class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _repeat_words(w: Column) -> Column:
    """Words that stand in a 3-word window occurring twice or more. Windows are compared by their 64-bit hash."""

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def by_sorting(h: Column) -> Column:
        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(pairs, starts), covered)

    def by_lookup(h: Column, twice: Column) -> Column:
        at = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i).otherwise(-1)), lambda i: i >= 0)
        return let(at, covered)

    def any_repeat(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))))
        return let(twice, lambda d: F.when(F.size(d) <= _FEW, by_lookup(h, d)).otherwise(by_sorting(h)))

    windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(
        let(F.slice(windows, F.lit(1), F.size(w) - 2), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(any_repeat(h)))
    )


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Boxed rows with the word, symbol, line and repetition counts of the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    split = boxed(df, text=body, words=words(body), lines=lines)
    one = split.select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(F.col("text"), UPPER).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))

    return one.select(
        "*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"),
    )


def base_failed(p: QualityParams) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat * F.col("n_words"))


def _ln_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n + 9, stepped down; exact to about 1e-12."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    product = F.lit(1.0)
    for j in range(1, 9):
        product = product * (n + j)
    return series - F.log(product)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) with k below n * p, from above: the terms fall from k downwards, and what
    follows the last one added is bounded by a geometric series. 1 where k is not below n * p."""
    n, k = n.cast("long"), k.cast("long")
    top = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    terms = F.least(k, F.lit(20_000))
    summed = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(0).cast("long"), terms - 1)).otherwise(F.array().cast("array<bigint>")), start, step
    )
    ratio = (k - terms) * (1 - p) / ((n - k + terms) * p)
    rest = F.when(k > terms, summed["term"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * (summed["sum"] + rest)))


def _stratum(value: Column, p: QualityParams) -> Column:
    return F.when(value.isin(*p.strata), value).otherwise("other")


def select_cutoffs(stats: DataFrame, stratum: Column, labels: DataFrame, doc_id: Column, p: QualityParams) -> DataFrame:
    """(stratum, rule, cutoff, n_good, lost_good, rejected_bad, tail): the chosen cutoff of each stratum and rule, where
    one stands. Texts that fail the base rules are no evidence: the learned rules never see them."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col("doc_id").alias("marked")).agg((F.min("quality") > 0).alias("good"))
    held = (
        stats.where(~base_failed(p)).select(doc_id.alias("doc"), stratum.alias("stratum"), *[r for r, _ in p.cutoffs])
        .join(marks, F.col("doc") == F.col("marked"))
    )
    counts = [
        F.count_if(F.col(rule).__gt__(c) & (F.col("good") == good)).alias(f"{rule}_{i}_{name}")
        for rule, cuts in p.cutoffs for i, c in enumerate(cuts) for good, name in ((True, "good"), (False, "bad"))
    ]
    table = held.groupBy("stratum").agg(F.count_if("good").alias("n_good"), *counts)
    each = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"),
                 F.col(f"{rule}_{i}_good").alias("lost_good"), F.col(f"{rule}_{i}_bad").alias("rejected_bad"))
        for rule, cuts in p.cutoffs for i, c in enumerate(cuts)
    ])).alias("c")
    rules, strata = len(p.cutoffs), len(p.strata) + 1
    tested = table.select("stratum", "n_good", each).select("stratum", "n_good", "c.*").withColumn(
        "tail", binomial_tail(F.col("n_good"), F.col("lost_good"), p.risk / rules))
    sofar = Window.partitionBy("stratum", "rule").orderBy("step")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("worth"), "step")
    return (
        tested.withColumn("stands", F.max("tail").over(sofar) <= p.level / (rules * strata))
        .withColumn("worth", F.col("rejected_bad") - p.price * F.col("lost_good"))
        .where("stands and worth > 0").withColumn("n", F.row_number().over(best)).where("n = 1")
        .select("stratum", "rule", "cutoff", "n_good", "lost_good", "rejected_bad", "tail")
    )


def judge(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang",
    p: QualityParams = QualityParams(), keep_rows: bool = True,
) -> DataFrame:
    """Every row, boxed (only ``doc_id`` in the box unless ``keep_rows``), with its statistics, ``base_failed``,
    ``failed_rules`` (of the learned ones) and ``kept``.

    The statistics are written once to the shared folder; the cutoffs are at most strata x rules rows and are broadcast.
    """
    stats = statistics(df, text)
    named = stats.select(
        stats["row"] if keep_rows else F.struct(stats["row"][doc_id].alias(doc_id)).alias("row"),
        _stratum(stats["row"][stratum], p).alias("stratum"), *[c for c in stats.columns if c != "row"],
    )
    stats = materialise(named, "quality-statistics")
    chosen = select_cutoffs(stats, F.col("stratum"), labels, F.col("row")[doc_id], p)
    wide = chosen.groupBy(F.col("stratum").alias("of")).pivot("rule", [r for r, _ in p.cutoffs]).agg(F.first("cutoff"))
    wide = wide.select("of", *[F.col(r).alias(f"max_{r}") for r, _ in p.cutoffs])
    failed = F.array_compact(F.array(*[
        F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r, _ in p.cutoffs
    ]))
    joined = stats.join(F.broadcast(wide), F.col("stratum") == F.col("of"), "left")
    return (
        joined.withColumn("base_failed", base_failed(p)).withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("of", *[f"max_{r}" for r, _ in p.cutoffs])
    )


def keep_good(df: DataFrame, labels: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``df`` that pass, unchanged."""
    return unboxed(judge(df, labels, **kwargs).where("kept"), df.columns)
