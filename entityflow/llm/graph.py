"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.sources.storage import materialise


def _least(both: DataFrame) -> DataFrame:
    """Per node the least of it and its neighbours."""
    return both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    m = _least(down)
    moved = down.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) of every node with an edge (columns a, b; longs) that is not the least of its component: ``b`` is the least.

    Large-star and small-star steps alternate until nothing changes. Each round is written to the shared folder; rounds
    grow with the logarithm of the longest chain. No step collects a neighbourhood: minima are partial aggregates, and
    joins on a star's centre are split by Spark.
    """
    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "components")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark.n == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        now = materialise(_small_star(_large_star(now)), "components")
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, the least node of a component too; ``root`` is that least node."""
    now = stars(edges)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
