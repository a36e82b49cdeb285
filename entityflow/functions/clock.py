"""Whole hours and seconds of a timestamp without zone, whatever the session's time zone does."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _days(ts: Column) -> Column:
    return F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")


def hour_number(ts: Column) -> Column:
    return _days(ts) * 24 + F.hour(ts)


def second_number(ts: Column) -> Column:
    return hour_number(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
