"""Exact search within a Hamming radius by pigeonhole bands.

A 64-bit fingerprint is four bands of 16 bits. Two fingerprints that differ in at most 4 e + 3 bits differ in at most e
bits of some band, so a query that looks, band by band, at the index rows whose band differs from its own in at most e
bits meets every row of that radius. The index is stored four times, once by each band, whatever its size; a query goes to
the cells of a band whose leading bits are within e flips of its own, and there only to the keys within e flips. Pairs met
are reduced to the two nearest owners inside the cell and are never Spark rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS, BITS = 4, 16
_PAIRS = 400_000  # compared at a time: about 100 bytes each while they are


@dataclass(frozen=True)
class Bands:
    errors: int = 2  # flips searched in a band: every row within ``reach`` bits is met
    rows: int = 65_536  # index rows of a cell, about
    most_prefix: int = 12  # leading bits of a band that name a cell, at most

    @property
    def reach(self) -> int:
        return BANDS * self.errors + BANDS - 1

    def prefix(self, index_rows: int) -> int:
        return min(self.most_prefix, max(0, (max(1, index_rows) - 1) // self.rows).bit_length())


def flips(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, bits set) of all masks of ``bits`` bits with at most ``most`` set, the fewest first."""
    return [(sum(1 << i for i in chosen), n) for n in range(min(most, bits) + 1) for chosen in combinations(range(bits), n)]


def _ordered(row: np.ndarray, owner: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, ...]:
    """The three by row, distance and owner; as one number each, where they fit, they are sorted many times as fast."""
    low = int(owner.max(initial=0)).bit_length()
    high = low + int(dist.max(initial=0)).bit_length()
    if high + int(row.max(initial=0)).bit_length() > 63:
        order = np.lexsort((owner, dist, row))
        return row[order], owner[order], dist[order]
    one = (row.astype(np.int64) << high) | (dist.astype(np.int64) << low) | owner.astype(np.int64)
    one.sort()
    return one >> high, one & ((1 << low) - 1), (one >> low) & ((1 << (high - low)) - 1)


def best_two(row: np.ndarray, owner: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per row number its nearest owner and distance, and the nearest other owner (-1 if none) and its distance. Equal
    distances go to the smaller owner."""
    row, owner, dist = _ordered(row, owner, dist)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    group = np.cumsum(np.diff(row, prepend=-1) != 0) - 1
    other = owner != owner[first][group]
    at = np.flatnonzero(other)
    at = at[np.diff(group[at], prepend=-1) != 0]
    second, second_dist = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int32)
    second[group[at]], second_dist[group[at]] = owner[at], dist[at]
    return row[first], owner[first], dist[first].astype(np.int32), second, second_dist


def _cell(queries: pa.Table, index: pa.Table) -> pa.Table:
    """The two nearest owners among the index rows a query meets in one cell, and how many rows it met."""
    index = index.sort_by("ref_id")
    owners = index.column("ref_id").combine_chunks()
    found: list[tuple[np.ndarray, ...]] = []
    if len(queries) and len(index):
        shift = np.uint64(BITS * queries.column("band")[0].as_py())
        low = np.uint64((1 << BITS) - 1)
        codes = owners.dictionary_encode().indices.to_numpy()
        at = np.unique(codes, return_index=True)[1]  # one place of each owner
        bits = index.column("bits").to_numpy().view(np.uint64)
        key = ((bits >> shift) & low).astype(np.int64)
        order = np.argsort(key, kind="stable")
        bits, codes = bits[order], codes[order]
        start = np.searchsorted(key[order], np.arange((1 << BITS) + 1))
        asked = queries.column("hash_bits").to_numpy().view(np.uint64)
        errors = queries.column("errors").to_numpy()
        for e in np.unique(errors).tolist():
            mine = np.flatnonzero(errors == e)
            masks = np.array([m for m, _ in flips(BITS, e)], np.int64)
            step = max(1, _PAIRS // len(masks))
            for lo in range(0, len(mine), step):
                rows = mine[lo : lo + step]
                keys = ((asked[rows] >> shift) & low).astype(np.int64)[:, None] ^ masks
                count = start[keys + 1] - start[keys]
                total = count.sum(axis=1)
                cuts = np.searchsorted(np.cumsum(total), np.arange(_PAIRS, total.sum() + _PAIRS, _PAIRS), side="left") + 1
                for part in np.split(np.arange(len(rows)), np.unique(np.minimum(cuts, len(rows)))):
                    n = count[part].ravel()
                    if not n.sum():
                        continue
                    ends = np.cumsum(n)
                    place = np.repeat(start[keys[part]].ravel() - (ends - n), n) + np.arange(ends[-1])
                    row = np.repeat(rows[part], total[part])
                    dist = np.bitwise_count(asked[row] ^ bits[place])
                    found.append((*best_two(row, codes[place], dist), total[part][total[part] > 0]))
        if found:
            row, best, dist, second, second_dist, met = (np.concatenate(x) for x in zip(*found))
    if not found:
        row = best = met = at = np.zeros(0, np.int64)
        second, dist, second_dist = best, best.astype(np.int32), best.astype(np.int32)
    lone = second < 0
    pick = np.append(at, 0)
    return pa.table({
        "hash_type": queries.column("hash_type").take(pa.array(row)), "hash_bits": queries.column("hash_bits").take(pa.array(row)),
        "ref_id": owners.take(pa.array(pick[best])), "dist": dist,
        "second_ref": owners.take(pa.array(pick[second], mask=lone)), "second_dist": second_dist, "compared": met,
    })


def met_owners(asked: DataFrame, index: DataFrame, index_rows: int, p: Bands = Bands()) -> DataFrame:
    """(hash_type, hash_bits, ref_id, dist, second_ref, second_dist, compared) per query and cell, for distinct queries
    (hash_type, hash_bits, errors) and index rows (tier, bits, ref_id); ``index_rows`` are those of the largest tier."""
    prefix = p.prefix(index_rows)

    def lead(bits, band):
        if not prefix:
            return F.lit(0)
        top = F.call_function("shiftrightunsigned", bits, band * BITS + (BITS - prefix))
        return top.bitwiseAND(F.lit((1 << prefix) - 1)).cast("int")

    bands = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    near = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n).alias("n")) for m, n in flips(prefix, p.errors)])
    placed = asked.select("hash_type", "hash_bits", "errors", bands.alias("band")).select(
        "*", F.explode(F.filter(near, lambda x: x["n"] <= F.col("errors"))).alias("near"))
    placed = placed.select(
        "hash_type", "hash_bits", "errors", "band", lead(F.col("hash_bits"), F.col("band")).bitwiseXOR(F.col("near.mask")).alias("cell"))
    rows = index.select("tier", "bits", "ref_id", bands.alias("band")).withColumn("cell", lead(F.col("bits"), F.col("band")))
    ref_type = index.schema["ref_id"].dataType.simpleString()
    return (
        placed.groupBy("hash_type", "band", "cell").cogroup(rows.groupBy("tier", "band", "cell"))
        .applyInArrow(_cell, f"hash_type string, hash_bits bigint, ref_id {ref_type}, dist int, second_ref {ref_type}, second_dist int, compared bigint")
    )
