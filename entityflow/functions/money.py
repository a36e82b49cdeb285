"""Money text. Amounts are integer cents; NULL means known to have no price."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_cents(cents: Column) -> Column:
    """``$12.34``, no grouping; NULL stays NULL."""
    return F.concat(F.lit("$"), (cents.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)").cast("string"))


def price_display(has_row: Column, cents: Column) -> Column:
    return F.when(~has_row, "pending price").when(cents.isNull(), "no price data").otherwise(format_cents(cents))


def export_price_display(cents: Column) -> Column:
    return F.coalesce(format_cents(cents), F.lit("no price data"))


def cents_from_market(market: Column) -> Column:
    """Dollars as double to cents, half to even, rounded once."""
    return F.rint(market * 100).cast("int")
