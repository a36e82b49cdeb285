"""Text rules: printed numbers, names, e-mail, JSON answers, keys and identifiers."""

from __future__ import annotations

import difflib
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The patterns of printed numbers and of the hit-point run in a name line.
SLASH_NUMBER = r"(\d{1,3})\s*/\s*(\d{1,3})"
PROMO_NUMBER = r"([A-Z]{2,4}\d{1,3})"
HP_RUN = r"(?i)(\b\d+\s*HP\b|\bHP\s*\d+\b|\bHP\b)"
EMAIL_SHAPE = r"^[a-z0-9_'+.-]*[a-z0-9_+-]@([a-z0-9][a-z0-9-]*\.)+[a-z]{2,}$"
MAX_FIELD = 1000


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, i))


def parse_number(text: Column) -> Column:
    """First ``N/M`` anywhere, else the first promo code, else NULL."""
    slash = F.concat(_group(text, SLASH_NUMBER, 1), F.lit("/"), _group(text, SLASH_NUMBER, 2))
    return F.coalesce(slash, _group(text, PROMO_NUMBER, 1))


def clean_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, HP_RUN, " "), r"\s+", " "))


def strip_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=.)", "")


def split_number(number: Column) -> tuple[Column, Column]:
    """(number, total) of a whole ``N/M`` text without leading zeros; NULLs for anything else."""
    whole = rf"^{SLASH_NUMBER}$"
    return tuple(strip_zeros(_group(F.trim(number), whole, i)) for i in (1, 2))


def norm_number(number: Column) -> Column:
    n, m = split_number(number)
    return F.coalesce(F.concat(n, F.lit("/"), m), number)


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two lower-cased names."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def json_value(text: Column) -> Column:
    """The variant of a text that holds exactly one JSON value, else NULL.

    (The parser itself stops after the first value, so the text is read as the only element of a list.)
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(wrapped, "$[0]", "variant"))


def json_block(text: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` if it is a JSON object, else NULL."""
    block = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.json_object_keys(block).isNotNull() & json_value(block).isNotNull(), block)


def sanitize(value: Column) -> Column:
    return F.substring(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""), 1, MAX_FIELD)


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def stable_seed(text: Column) -> Column:
    """First eight bytes of the SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_id(name: Column, namespace: uuid.UUID) -> Column:
    """Name-based UUID (version 5)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def norm_email(raw: Column) -> tuple[Column, Column]:
    """(normalised address, is it well formed)."""
    email = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    ok = (
        F.regexp_like(email, F.lit(EMAIL_SHAPE)) & (F.length(email) <= 254)
        & ~email.startswith(".") & ~email.contains("..")
    )
    return email, F.coalesce(ok, F.lit(False))
