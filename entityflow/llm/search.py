"""Exact top-k inner-product search with ball trees.

Vectors are dealt to shards of bounded size and queries to blocks of bounded size; a task searches one shard for one
block. It builds a ball tree (each node a centre and a radius) and opens nodes in the order of their upper bounds
q . centre + |q| radius, dropping a node for every query whose current kth score is above the bound. Each block first
searches one shard; the kth scores found there go with it to all other shards, which start from them.

Of equal vectors only the ``k + 1`` smallest ids can be in any answer, so copies are cut to those before shards are made.
Scores are exact integers: products are summed in doubles only where every sum stays below 2 ** 53, else in longs.

Edge cases: vectors that are NULL or hold a NULL or non-finite component, and rows without an id, take no part; vectors
of another length than the query's are no candidates; rows equal in id and vector count once; ties go to the smaller id;
fewer candidates than k give all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.ranking import first_n
from entityflow.sources.storage import materialise

_NONE = -(2**63) + 1  # below every score, and its negative is a long too


@dataclass(frozen=True)
class SearchParams:
    k: int = 5
    shard: int = 32_768  # vectors of a shard, about
    block: int = 4_096  # queries of a block, about
    leaf: int = 128


def scaled(vector: Column, scale: float = 256.0) -> Column:
    """Components as integers: floor(scale * x), x as double; NULL for a vector that takes no part."""
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None  # of a leaf
    children: tuple["Node", ...] = ()


def ball_tree(x: np.ndarray, leaf: int) -> Node:
    """Splits by the side of two far points that a row is nearer to; equal halves where that separates nothing."""

    def node(rows: np.ndarray) -> Node:
        own = x[rows]
        centre = own.mean(axis=0)
        far = np.sqrt(((own - centre) ** 2).sum(axis=1))
        made = Node(centre, float(far.max()), rows)
        if len(rows) > leaf:
            a = own[far.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            side = own @ (a - b)
            half = np.argsort(side, kind="stable")
            made = Node(centre, made.radius, None)
            waiting.append((made, rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]))
        return made

    waiting: list = []
    root = node(np.arange(len(x)))
    while waiting:
        parent, left, right = waiting.pop()
        parent.children = (node(left), node(right))
    return root


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, p: SearchParams):
    """(query row, id, score) of each query's best in this shard: at most k, none below ``floor``."""
    peak = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    exact = peak < 2**53
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    norm = np.sqrt((qf * qf).sum(axis=1))
    best = np.full((len(q), p.k), _NONE, np.int64)
    who = np.full((len(q), p.k), np.iinfo(np.int64).max, np.int64)
    kth = floor.copy()

    def bound(n: Node, rows: np.ndarray) -> np.ndarray:
        reach = norm[rows] * n.radius
        return qf[rows] @ n.centre + reach + 1e-9 * (reach + norm[rows] * np.sqrt((n.centre**2).sum()) + 1)

    def look(n: Node, rows: np.ndarray) -> None:
        s = (qf[rows] @ xf[n.rows].T).astype(np.int64) if exact else q[rows] @ x[n.rows].T
        own = ids[n.rows]
        hit = (s >= kth[rows][:, None]) & (query_ids[rows][:, None] != own[None, :])
        r, c = np.nonzero(hit)
        if not len(r):
            return
        touched = np.unique(r)
        of = np.concatenate([r, np.repeat(touched, p.k)])
        score = np.concatenate([s[r, c], best[rows[touched]].ravel()])
        name = np.concatenate([own[c], who[rows[touched]].ravel()])
        order = np.lexsort((name, -score, of))
        of, score, name = of[order], score[order], name[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of, side="left")
        keep = rank < p.k
        best[rows[touched]] = score[keep].reshape(-1, p.k)
        who[rows[touched]] = name[keep].reshape(-1, p.k)
        kth[rows[touched]] = np.maximum(kth[rows[touched]], best[rows[touched], -1])

    if len(x) and len(q):
        everyone = np.arange(len(q))
        root, turn = ball_tree(xf, p.leaf), 0
        heap = [(0.0, turn, root, everyone, bound(root, everyone))]
        while heap:
            _, _, n, rows, upper = heapq.heappop(heap)
            rows = rows[upper >= kth[rows]]
            if not len(rows):
                continue
            if n.rows is not None:
                look(n, rows)
            for child in n.children:
                turn += 1
                reach = bound(child, rows)
                heapq.heappush(heap, (-float(reach.max()), turn, child, rows, reach))
    found = np.nonzero(best > _NONE)
    return found[0], who[found], best[found]


def _cells(vectors: DataFrame, queries: DataFrame, p: SearchParams) -> DataFrame:
    """(query_key, query_id, vec_id, score) for shards and blocks that meet in a (shard, block) cell."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, block in right.groupby(right["v"].str.len()):
            own = left[left["v"].str.len() == width]
            if len(own):
                r, ids, scores = search_shard(
                    own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_numpy()).astype(np.int64),
                    block["query_id"].to_numpy(np.int64), np.stack(block["v"].to_numpy()).astype(np.int64),
                    block["floor"].to_numpy(np.int64), p)
                picked = block.iloc[r]
                out.append(pd.DataFrame({"query_key": picked["query_key"].to_numpy(), "query_id": picked["query_id"].to_numpy(),
                                         "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_key", "query_id", "vec_id", "score")})

    return vectors.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(
        run, "query_key bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, vec_id: Column, vector: Column, is_query: Column, p: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``p.k`` other rows of every query row. ``vector`` is an array of longs,
    ``is_query`` may use the columns vec_id and v."""
    rows = df.select(vec_id.cast("bigint").alias("vec_id"), vector.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = materialise(rows.distinct(), "search-rows")
    # copies: an answer needs k of them, and one more as the query's own row does not count
    few = first_n(rows, ["v"], [F.col("vec_id")], p.k + 1).drop("rn")
    few = materialise(few.withColumn("query_key", F.xxhash64("v", "vec_id")), "search-vectors")
    queries = materialise(rows.where(is_query).select(
        F.col("vec_id").alias("query_id"), "v", F.xxhash64("v", "vec_id").alias("query_key")), "search-queries")
    shards, blocks = (max(1, -(-d.count() // n)) for d, n in ((few, p.shard), (queries, p.block)))
    numbered = few.drop("query_key").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)).cast("int"))

    def spread(d: DataFrame, name: str, where: Column) -> DataFrame:
        n = shards if name == "shard" else blocks
        return d.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(where)

    home = F.col("shard") == F.col("block") % shards
    first = _cells(spread(numbered, "block", home),
                   asked.withColumn("shard", (F.col("block") % shards).cast("int")).withColumn("floor", F.lit(_NONE)), p)
    if shards > 1:
        first = materialise(first, "search-first")
        known = first.groupBy("query_key").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(
            F.col("query_key").alias("k"), F.when(F.col("n") >= p.k, F.col("least")).alias("least"))
        again = asked.join(known, F.col("query_key") == F.col("k"), "left").withColumn("floor", F.coalesce("least", F.lit(_NONE))).drop("k", "least")
        first = first.union(_cells(spread(numbered, "block", ~home), spread(again, "shard", ~home), p))
    ranked = first_n(first, ["query_key", "query_id"], [F.desc("score"), F.col("vec_id")], p.k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
