"""Vector arithmetic on double arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def l2_normalise(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    # the norm is spread over an array so that it is computed once per row, not once per element
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: F.when(n > 0, x / n).otherwise(x))


def mean_pool(tokens: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    first = tokens[0]
    zero = F.transform(first, lambda x: F.lit(0.0))
    total = F.aggregate(tokens, zero, lambda acc, tok: F.zip_with(acc, tok, lambda a, b: a + b))
    return F.zip_with(total, F.array_repeat(F.size(tokens), F.size(total)), lambda s, n: s / n)
