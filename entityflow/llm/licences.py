"""Licence texts by canonical digest.

A text is put in canonical form: ASCII letters in lower case, lines that only state a copyright left out, equivalent
spellings unified, everything but letters and digits turned into single spaces. Two texts are one if their forms are
equal; the forms' SHA-256 digests are joined with those of known licences. The whole text is looked up, and each of its
lines, as notices stand on lines of their own.

The known texts are a table (licence, text) that can be given, digested by the same expressions; the built-in ones are the
``KNOWN`` ones below and the full texts in ``licence_texts``, named by their files. Lines are joined one by one, found licences are
the only rows grouped again. Edge cases: a NULL text, and one whose canonical form is empty, has no digest
and no licence; repeated rows are looked up each (they come out once per row); an empty table gives an empty result;
other columns are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.llm.common import boxed

# Licence id and a known text of it.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TEXTS = Path(__file__).with_name("licence_texts")
_FILES = [(f.stem, f.read_text("utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
# Titles that the files of these licences carry or leave out.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",),
}
BUILT_IN = (*KNOWN, *_FILES, *[
    (name, f"{title}\n\n{text}") for name, text in (*KNOWN, *_FILES) if "\n" in text for title in TITLES.get(name, ())])
# Lines that state a copyright (in lower case): the word or mark, then a mark, a year or a place for one. A
# wrapped line of running text that happens to begin with the word stays. And spellings with what they become, as whole words.
COPYRIGHT = (
    r"^[^a-z0-9\n]*(copyright[ \t:]*(\(c\)|©|[0-9]|[<\[{])|(\(c\)|©)[ \t]*(copyright|[0-9]|[<\[{]))[^\n]*$"
    r"|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
)
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("http", "https"), ("v", "version"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hint(known) -> str | None:
    """A pattern that every line with the canonical form of a known text has a match of: words, in each spelling that
    becomes them, such that every known text has one. None if that takes many words."""
    forms = []
    for _, text in known:
        form = re.sub("(?m)" + COPYRIGHT, "", text.translate(str.maketrans(UPPER, LOWER)))
        form = f" {re.sub('[^a-z0-9\x80-\U0010ffff]+', ' ', form)} "
        for variant, usual in SPELLINGS:
            form = form.replace(f" {variant} ", f" {usual} ")
        if form.strip():
            words = set(form.split())
            forms.append({w for w in words if len(w) > 6} or {max(words, key=len)})
    chosen = []
    while forms and len(chosen) < 32:
        counts = Counter(w for form in forms for w in form)
        chosen.append(max(counts, key=lambda w: (counts[w], len(w), w)))
        forms = [form for form in forms if chosen[-1] not in form]
    spelled = sorted({x for w in chosen for x in (w, *[v.split()[0] for v, u in SPELLINGS if u == w])})
    return None if forms else "(?i)" + "|".join(map(re.escape, spelled))


HINT = hint(BUILT_IN)


def canonical(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    form = F.regexp_replace(low, "(?md)" + COPYRIGHT, "")
    form = F.concat(F.lit(" "), F.regexp_replace(form, "[^a-z0-9\\x{80}-\\x{10FFFF}]+", " "), F.lit(" "))
    for variant, usual in SPELLINGS:
        form = F.replace(form, F.lit(f" {variant} "), F.lit(f" {usual} "))
    return F.trim(form)


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_digests(spark: SparkSession, known=BUILT_IN) -> DataFrame:
    """(licence, known): one row per digest. ``known``: pairs, or a DataFrame with the columns licence and text."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "licence string, text string")
    texts = rows.select("licence", digest(F.col("text")).alias("known")).where("known is not null")
    return texts.groupBy("known").agg(F.min("licence").alias("licence"))


def known_table(spark: SparkSession, known) -> DataFrame:
    table = known_digests(spark, known)
    return table if isinstance(known, DataFrame) else F.broadcast(table)


def scan(df: DataFrame, text: str = "text", known=BUILT_IN) -> DataFrame:
    """Every row, boxed, with ``digest`` and ``licence`` of the whole text (NULL where unknown)."""
    table = known_table(df.sparkSession, known)
    rows = boxed(df, digest=digest(F.col(text)))
    return rows.join(table, F.col("digest") == F.col("known"), "left").drop("known")


def scan_lines(df: DataFrame, text: str = "text", known=BUILT_IN, **keys: Column) -> DataFrame:
    """The key columns and ``notices``: the licences, sorted, whose known text is a whole line of the row's text. Rows
    without a notice are left out; rows with equal keys come out once."""
    table = known_table(df.sparkSession, known)
    lines = df.select(*[c.alias(k) for k, c in keys.items()], F.explode(F.split(F.col(text), "\n")).alias("line"))
    needs = None if isinstance(known, DataFrame) else HINT if known is BUILT_IN else hint(known)
    if needs is not None:
        lines = lines.where(F.rlike("line", F.lit(needs)))  # no other line can be a known text
    found = lines.select(*keys, digest(F.col("line")).alias("digest")).join(table, F.col("digest") == F.col("known"))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("licence")).alias("notices"))
