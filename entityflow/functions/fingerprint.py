"""64-bit fingerprints from coefficient arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def bits_from_coefficients(c: Column) -> Column:
    """Bit i (most significant first) is set iff i > 0 and c[i] exceeds the median of c[1..63].

    Slot 0 never counts, so the value is a non-negative bigint.
    """
    median = F.sort_array(F.slice(c, 2, BITS - 1))[31]
    # fold over (value, median) pairs so that the median is computed once per row
    marked = F.zip_with(
        F.slice(c, 2, BITS - 1),
        F.array_repeat(median, BITS - 1),
        lambda v, m: F.when(v > m, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
    )
    return F.aggregate(marked, F.lit(0).cast("bigint"), lambda acc, b: acc * 2 + b)


def ring_difference(c: Column, n: int) -> Column:
    """c[i+1] - c[i], the last one wrapping around."""
    rolled = F.concat(F.slice(c, 2, n - 1), F.slice(c, 1, 1))
    return F.zip_with(rolled, c, lambda nxt, cur: nxt - cur)


def tier_coefficients(c: Column) -> Column:
    """Five coefficient arrays of one item: whole, derivative, and three regions with their derivative."""
    regions = []
    for start in (1, 17, 33):
        part = F.slice(c, start, 32)
        regions.append(F.concat(part, ring_difference(part, 32)))
    return F.array(c, ring_difference(c, BITS), *regions)


def flip_mask(offset: Column, count: Column) -> Column:
    """Mask of ``count`` (0-18) bits, the j-th at position 1 + (offset + 3j) mod 63 from the top."""
    js = F.filter(F.sequence(F.lit(0), F.lit(18)), lambda j: j < count)
    return F.aggregate(
        js,
        F.lit(0).cast("bigint"),
        lambda acc, j: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(62) - (offset + j * 3) % 63)),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(21,0)")


def signed64(unsigned: Column) -> Column:
    """Unsigned 64-bit value as decimal(20,0) to the bigint with the same bits."""
    u = unsigned.cast("decimal(20,0)")
    return F.when(u >= _whole(1 << 63), u - _whole(1 << 64)).otherwise(u).cast("bigint")


def unsigned64(signed: Column) -> Column:
    s = signed.cast("decimal(20,0)")
    return F.when(s < 0, s + _whole(1 << 64)).otherwise(s).cast("decimal(20,0)")
