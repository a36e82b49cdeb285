"""Domain block lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Throw-away mail domains.
DISPOSABLE_DOMAINS = """
mailinator.com guerrillamail.com 10minutemail.com tempmail.com throwaway.email trashmail.com yopmail.com getnada.com
mailnesia.com dispostable.com maildrop.cc fakeinbox.com sharklasers.com guerrillamailblock.com grr.la spam4.me
temp-mail.org mohmal.com emailondeck.com mailcatch.com mytemp.email tempinbox.com 33mail.com tempr.email mailtemp.net
inboxbear.com burnermail.io moakt.com luxusmail.org harakirimail.com
""".split()


def parse_blocklist(lines: DataFrame) -> DataFrame:
    """(value) lines to distinct ``domain`` rows: lower case, no blanks, no ``#`` lines."""
    d = F.lower(F.trim(F.regexp_replace("value", r"\r$", "")))
    return lines.select(d.alias("domain")).where((F.col("domain") != "") & ~F.col("domain").startswith("#")).distinct()


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocklist(spark.read.text(path))


def default_blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DISPOSABLE_DOMAINS], "domain string")
