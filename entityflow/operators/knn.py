"""Exact nearest-owner search over 64-bit fingerprints and over vectors.

Fingerprints: a distance within a known reach is found by pigeonhole bands (``radius``). The four minor tiers of a match
only ask whether the full tier's owner leads within the accepted distance, so they are searched by bands alone, and only
where that owner is near enough. The full tier needs the distance of the next owner however far: an index large enough
for the next owner to lie within the bands' reach is searched by bands first, and what they leave open by a grid of
(query chunk, index block) cells, each a bounded Arrow group reduced by a numpy kernel.

Vectors: points lie in cells round pivots, with a centre and a radius. Every query is answered in its own cell first, and
then sent only to the cells that can hold a point as near as its kth so far.

Nothing of the data is broadcast, no pair is ever a Spark row, and equal queries and equal index rows are collapsed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.ranking import first_n
from entityflow.operators import cells
from entityflow.operators.cells import CellParams
from entityflow.operators.radius import BANDS, Bands, met_owners
from entityflow.params import TIERS, HashParams
from entityflow.sources.storage import materialise

_QUERY_ROWS, _INDEX_ROWS = 131_072, 65_536
_CELLS = 32  # of a tier and slot, at most, while the sides stay below these rows
_TILE = 262_144  # pairs compared at a time, which stay in a core's cache
NO_DISTANCE = 64  # reported where there is no (second) owner


@dataclass(frozen=True)
class Grid:
    """Most rows of one cell side; the cell counts follow from the table sizes."""

    query_rows: int = _QUERY_ROWS
    index_rows: int = _INDEX_ROWS
    least_rows: int = 1_024  # queries are not cut finer than this for the sake of parallelism
    # rows of a tier from which on a query's two nearest owners are expected within the bands' reach: about 2 ** 64 over
    # the number of fingerprints within 11 bits, times two
    bands_from: int = 32_000_000

    def chunks(self, queries: int, index: int, slots: int) -> tuple[int, int]:
        """(query chunks, index blocks): as few as the row bounds allow, but enough cells to use every slot. Bounds finer
        than the defaults hold while that makes at most ``_CELLS`` cells a slot; larger tables get larger cells."""
        blocks = max(1, -(-index // self.index_rows))
        bounded = -(-queries // self.query_rows)
        over = blocks * bounded / (_CELLS * max(1, slots))
        if over > 1:
            # a cell costs a group of its own and each side is sent once per piece of the other, so their number is bounded
            blocks = max(math.ceil(blocks / over ** 0.5), -(-index // max(self.index_rows, _INDEX_ROWS)))
            bounded = max(math.ceil(bounded / over ** 0.5), -(-queries // max(self.query_rows, _QUERY_ROWS)))
        spread = min(-(-slots // blocks), queries // self.least_rows)
        return max(1, bounded, spread), blocks


def load_index(df: DataFrame) -> DataFrame:
    """The three columns of a fingerprint index; rows of unknown tiers and rows without a fingerprint are ignored."""
    return df.where(F.col("hash_type").isin(*TIERS) & F.col("hash_bits").isNotNull()).select("ref_id", "hash_type", "hash_bits")


def _spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int, key: str) -> DataFrame:
    """Place each row in one chunk of its own side and in every chunk of the other side."""
    placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _slots(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sizes(queries: DataFrame, index: DataFrame, by: Column) -> tuple[int, int]:
    """Rows of the largest group on each side, counted in one job."""
    sides = queries.select(F.lit(0).alias("side"), by.alias("by")).unionByName(index.select(F.lit(1).alias("side"), by.alias("by")))
    counts = sides.groupBy("side", "by").count().groupBy("side").agg(F.max("count").alias("n"))
    found = {r["side"]: r["n"] for r in counts.collect()}
    return found.get(0, 0), found.get(1, 0)


def _hamming_cell(queries: pa.Table, index: pa.Table) -> pa.Table:
    """Nearest owner and nearest other owner of every query in one cell."""
    index = index.sort_by("ref_id")
    owners = index.column("ref_id").combine_chunks()
    if not len(owners):
        queries = queries.slice(0, 0)
    codes = owners.dictionary_encode().indices.to_numpy()
    bits = index.column("bits").to_numpy().view(np.uint64)
    asked = queries.column("hash_bits").to_numpy().view(np.uint64)
    # an owner's rows lie side by side
    begin, end = (np.searchsorted(codes, np.arange(codes[-1] + 1 if len(codes) else 0), side) for side in ("left", "right"))
    n, step = len(asked), max(1, _TILE // max(1, len(bits)))
    best, second = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    best_d, second_d = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
    for lo in range(0, n, step):
        dist = np.bitwise_count(asked[lo:lo + step, None] ^ bits[None, :])
        rows = np.arange(len(dist))
        first = dist.argmin(axis=1)
        best[lo:lo + step], best_d[lo:lo + step] = first, dist[rows, first]
        own = codes[first]
        for row, a, b in zip(dist, begin[own].tolist(), end[own].tolist()):
            row[a:b] = NO_DISTANCE + 1
        nxt = dist.argmin(axis=1)
        second[lo:lo + step], second_d[lo:lo + step] = nxt, dist[rows, nxt]
    lone = second_d > NO_DISTANCE
    return pa.table({
        "hash_type": queries.column("hash_type"), "hash_bits": queries.column("hash_bits"),
        "ref_id": owners.take(pa.array(best)), "dist": best_d,
        "second_ref": owners.take(pa.array(second, mask=lone)), "second_dist": np.where(lone, NO_DISTANCE, second_d).astype(np.int32),
    })


def hamming_knn(
    queries: DataFrame, index: DataFrame, grid: Grid = Grid(), bands: Bands = Bands(), sizes: tuple[int, int] | None = None
) -> DataFrame:
    """Per (item, tier): nearest owner, its distance and the distance of the nearest other owner.

    Equal distances go to the lowest ref_id. An empty tier, or a query without a fingerprint, gives no owner and 64, 64.
    """
    keys = ["hash_type", "hash_bits"]
    index = load_index(index)
    sizes = sizes or _sizes(queries, index, F.col("hash_type"))
    rows, asked = _distinct_rows(index), queries.select(*keys).where(F.col("hash_bits").isNotNull()).distinct()
    settled = None
    if sizes[1] >= grid.bands_from:
        near = met_owners(asked.withColumn("errors", F.lit(bands.errors)), rows, sizes[1], bands)
        # two owners within the reach: nothing that the bands did not meet can be nearer
        settled = materialise(_merge_blocks(near, keys).where(F.col("second_dist") <= bands.reach), "knn-bands")
        asked = materialise(asked.join(settled.select(*keys), keys, "left_anti"), "knn-left")
        sizes = asked.groupBy("hash_type").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], sizes[1]
    found = _on_grid(asked, rows, *grid.chunks(*sizes, _slots(queries)))
    best = found if settled is None else found.unionByName(settled)
    best = best.select(*keys, F.col("ref_id").alias("best_ref"), F.col("dist").alias("best_dist"), "second_dist")
    far = F.lit(NO_DISTANCE)
    return queries.join(best, keys, "left").select(
        "item_id", *keys, "best_ref",
        F.coalesce("best_dist", far).alias("best_dist"), F.coalesce("second_dist", far).alias("second_dist"),
    )


def _distinct_rows(index: DataFrame) -> DataFrame:
    """Index rows as (tier, bits, ref_id); of equal fingerprints only the two lowest owners can ever be reported."""
    # (renamed: queries are often derived from the index itself)
    return first_n(index.distinct(), ["hash_type", "hash_bits"], [F.col("ref_id")], 2).select(
        F.col("hash_type").alias("tier"), F.col("hash_bits").alias("bits"), "ref_id"
    )


def _on_grid(asked: DataFrame, rows: DataFrame, n_q: int, n_i: int) -> DataFrame:
    """(hash_type, hash_bits, ref_id, dist, second_dist) of distinct queries, by comparing every pair."""
    ref_type = rows.schema["ref_id"].dataType.simpleString()
    found = (
        _spread(asked, "_chunk", n_q, "_block", n_i, "hash_bits").groupBy("hash_type", "_chunk", "_block")
        .cogroup(_spread(rows, "_block", n_i, "_chunk", n_q, "bits").groupBy("tier", "_chunk", "_block"))
        .applyInArrow(
            _hamming_cell,
            f"hash_type string, hash_bits bigint, ref_id {ref_type}, dist int, second_ref {ref_type}, second_dist int",
        )
    )
    keys = ["hash_type", "hash_bits"]
    return _merge_blocks(found, keys) if n_i > 1 else found.select(*keys, "ref_id", "dist", "second_dist")


def _merge_blocks(found: DataFrame, keys: list[str]) -> DataFrame:
    """Best and second owner over all blocks; every block has sent its own best two."""
    pair = F.explode(F.array(
        F.struct(F.col("ref_id").alias("r"), F.col("dist").alias("d")),
        F.struct(F.col("second_ref").alias("r"), F.col("second_dist").alias("d")),
    ))
    per_owner = (
        found.repartition(*keys).select(*keys, pair.alias("p")).where(F.col("p.r").isNotNull())
        .groupBy(*keys, F.col("p.r").alias("r")).agg(F.min("p.d").alias("d"))
    )
    top = first_n(per_owner, keys, [F.col("d"), F.col("r")], 2)
    one = F.col("rn") == 1
    return top.groupBy(*keys).agg(
        F.max(F.when(one, F.col("r"))).alias("ref_id"),
        F.max(F.when(one, F.col("d"))).alias("dist"),
        F.max(F.when(~one, F.col("d"))).alias("second_dist"),
    )


def hash_score(distance: Column, margin: Column, agreement: Column, accept: int) -> Column:
    raw = (
        F.lit(0.5) * (F.lit(1) - distance.cast("double") / F.lit(float(accept)))
        + F.lit(0.3) * F.least(margin / F.lit(10.0), F.lit(1.0))
        + F.lit(0.2) * (agreement / F.lit(5.0))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def hamming_match(
    queries: DataFrame, index: DataFrame, p: HashParams = HashParams(), grid: Grid = Grid(), bands: Bands = Bands()
) -> DataFrame:
    """Five-tier vote. The full tier names the candidate; ``agreement`` counts tiers led by it within reach."""
    full = F.col("hash_type") == TIERS[0]
    index = load_index(index)
    sizes = _sizes(queries, index, F.col("hash_type"))
    lead = hamming_knn(queries.where(full), index.where(full), grid, bands, sizes).drop("hash_type", "hash_bits")
    lead = materialise(lead, "match-full")
    votes = minor_votes(queries.where(~full & F.col("hash_bits").isNotNull()), index.where(~full), lead, sizes[1], p, bands)
    own = F.when(F.col("best_ref").isNotNull() & (F.col("best_dist") <= p.accept_distance), 1).otherwise(0)
    items = queries.select("item_id").distinct().join(lead, "item_id", "left").join(votes, "item_id", "left")
    far = F.lit(NO_DISTANCE)
    return judged(items.select(
        "item_id", F.col("best_ref").alias("candidate"), F.coalesce("best_dist", far).alias("distance"),
        (F.coalesce("second_dist", far) - F.coalesce("best_dist", far)).alias("margin"),
        (own + F.coalesce("votes", F.lit(0))).cast("int").alias("agreement"),
    ), p)


def minor_votes(queries: DataFrame, index: DataFrame, lead: DataFrame, size: int, p: HashParams, bands: Bands) -> DataFrame:
    """(item, votes): how many minor tiers the item's candidate leads within the accepted distance.

    The candidate's own rows are looked up by their id. Where it is near enough, the bands tell whether any other owner is
    nearer; a candidate at distance d needs ``d // 4`` flips.
    """
    keys = ["hash_type", "hash_bits"]
    wanted = queries.join(lead.select("item_id", F.col("best_ref").alias("ref_id")).where("ref_id is not null"), "item_id")
    held = index.select("ref_id", "hash_type", F.col("hash_bits").alias("_bits"))
    apart = F.bit_count(F.col("hash_bits").bitwiseXOR(F.col("_bits")))
    own = wanted.join(held, ["ref_id", "hash_type"]).groupBy("item_id", *keys, "ref_id").agg(F.min(apart).alias("dist"))
    own = materialise(own.where(F.col("dist") <= min(p.accept_distance, bands.reach)), "match-minor")
    asked = own.groupBy(*keys).agg(F.max(F.floor(F.col("dist") / BANDS)).cast("int").alias("errors"))
    rows = _distinct_rows(index)
    near = _merge_blocks(met_owners(asked, rows, size, bands), keys).select(*keys, F.col("ref_id").alias("_best"))
    led = own.join(near, keys).where(F.col("_best") == F.col("ref_id"))
    return led.groupBy("item_id").agg(F.count(F.lit(1)).alias("votes"))


def judged(scored: DataFrame, p: HashParams = HashParams()) -> DataFrame:
    """Match or no match of (item, candidate, distance, margin, agreement)."""
    ok = (
        (F.col("agreement") >= p.min_agreement)
        & (F.col("distance") <= p.accept_distance)
        & (F.col("margin") >= p.min_margin)
        & F.col("candidate").isNotNull()
    )
    score = hash_score(F.col("distance"), F.col("margin"), F.col("agreement"), p.accept_distance)
    return scored.select(
        "item_id", F.when(ok, F.col("candidate")).alias("ref_id"),
        F.when(ok, score).otherwise(F.lit(0.0)).alias("score"),
        "distance", "margin", "agreement",
    )


def best_alternative(alternatives: DataFrame, index: DataFrame, grid: Grid = Grid(), bands: Bands = Bands()) -> DataFrame:
    """(item, alternative, bits) to the alternative nearest to any full-tier row; ties and no index give the lowest.

    An item with an alternative within the bands' reach is settled by them, as the others are further; the rest goes to
    the grid.
    """
    keys = ["hash_type", "hash_bits"]
    full = load_index(index).where(F.col("hash_type") == "full")
    asked = materialise(alternatives.select("item_id", "alternative", F.lit("full").alias("hash_type"), "hash_bits"), "alternatives")
    sizes = _sizes(asked, full, F.col("hash_type"))
    rows = _distinct_rows(full)
    bits = asked.select(*keys).where(F.col("hash_bits").isNotNull()).distinct()
    near = _merge_blocks(met_owners(bits.withColumn("errors", F.lit(bands.errors)), rows, sizes[1], bands), keys)
    near = materialise(asked.join(near.where(F.col("dist") <= bands.reach).select(*keys, "dist"), keys, "left"), "alternatives-near")
    closed = near.groupBy("item_id").agg(F.count("dist").alias("n"))
    left = near.join(closed.where("n = 0").select("item_id"), "item_id", "left_semi").drop("dist")
    far = _on_grid(left.select(*keys).where(F.col("hash_bits").isNotNull()).distinct(), rows, *grid.chunks(*sizes, _slots(asked)))
    far = left.join(far.select(*keys, "dist"), keys, "left")
    both = near.join(closed.where("n > 0").select("item_id"), "item_id", "left_semi").unionByName(far)
    return both.groupBy("item_id").agg(
        F.coalesce(
            F.min_by("alternative", F.when(F.col("dist").isNotNull(), F.struct("dist", "alternative"))), F.lit(0)
        ).alias("alternative"),
        F.min("dist").alias("distance"),
    )


def cosine_top(queries: DataFrame, points: DataFrame, k: int = 5, p: CellParams = CellParams()) -> DataFrame:
    """The ``k`` nearest points of every item with rank; equal similarity goes to the lowest point id. Items and points
    without a vector take no part."""
    return cells.top(queries, points, k, p)[0]


def cosine_match(
    queries: DataFrame, points: DataFrame, k: int = 5, margin_scale: float = 0.05, p: CellParams = CellParams()
) -> DataFrame:
    """Owner of the nearest point; the score grows with the gap to the first other owner among the ``k``."""
    top = cosine_top(queries, points, k, p)
    hits = top.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rn", "ref_id", "sim"))).alias("h"))
    first = F.col("h")[0]
    other = F.filter("h", lambda x: x["ref_id"] != F.col("h")[0]["ref_id"])
    second = F.try_element_at(other, F.lit(1))
    gap = F.coalesce((F.lit(1.0) - second["sim"]) - (F.lit(1.0) - first["sim"]), F.lit(0.0))
    factor = F.lit(0.5) + F.lit(0.5) * F.least(F.greatest(gap, F.lit(0.0)) / F.lit(margin_scale), F.lit(1.0))
    scored = hits.select("item_id", first["ref_id"].alias("ref_id"), (first["sim"] * factor).alias("score"))
    return queries.select("item_id").join(scored, "item_id", "left").select(
        "item_id", "ref_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )
