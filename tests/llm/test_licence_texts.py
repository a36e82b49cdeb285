"""Full licence texts, given tables of them, and the line filter."""

import textwrap

import pytest
from pyspark.sql import functions as F

from entityflow.llm import licences

BSD2 = (licences.TEXTS / "BSD-2-Clause.txt").read_text()


def test_full_texts(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    rows = [(n, "Copyright (c) 2020 Someone\n\n" + (licences.TEXTS / f"{n}.txt").read_text().upper()) for n in names]
    got = licences.scan(spark.createDataFrame(rows, "name string, text string")).select("row.name", "licence").collect()
    assert len(got) == len(names) and all(r.name == r.licence for r in got)


@pytest.mark.parametrize("table", [False, True])
def test_given_texts_of_other_words(spark, table):
    known = [("BSD-2-Clause", BSD2), ("own", "Do as you like."), ("org", "Ask the organization"), ("none", "...")]
    known = spark.createDataFrame(known, "licence string, text string") if table else known
    rows = [(1, "x\n" + " ".join(BSD2.split()) + "\ny"), (2, "DO AS YOU LIKE"), (3, "a\nask the organisation!"), (4, "MIT License"), (5, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.notices for r in licences.scan_lines(docs, known=known, id=F.col("doc_id")).collect()}
    assert got == {1: ["BSD-2-Clause"], 2: ["own"], 3: ["org"]}
    whole = {r.doc_id: r.licence for r in licences.scan(docs, known=known).select("row.doc_id", "licence").collect()}
    assert whole == {1: None, 2: "own", 3: None, 4: None, 5: None}


MIT = next(t for name, t in licences.KNOWN if name == "MIT" and "\n" in t)
FILE = """MIT License

Copyright (c) 2021 Some Body

""" + MIT


@pytest.mark.parametrize("width", [60, 78, 100, 10_000])
def test_wrapping_does_not_matter(spark, width):
    """Texts without a statement of copyright inside a paragraph are found in any wrapping, titled or not."""
    texts = {"titled": FILE, "plain": FILE.split("\n\n", 2)[2], "words": MIT}
    wrapped = [(k, "\n\n".join(textwrap.fill(par, width) for par in t.split("\n\n"))) for k, t in texts.items()]
    got = licences.scan(spark.createDataFrame(wrapped, "name string, text string")).collect()
    assert {r.row.name: r.licence for r in got} == {k: "MIT" for k in texts}


def test_unwrapped_to_one_line(spark):
    rows = [("MIT", " ".join(MIT.split()))]
    assert [r.licence for r in licences.scan(spark.createDataFrame(rows, "name string, text string")).collect()] == ["MIT"]


def test_notices_belong_to_their_row(spark, monkeypatch):
    from entityflow.llm import queries

    rows = [(None, "Licensed under CC BY-NC 4.0."), (5, "plain text"), (5, "a\nSPDX-License-Identifier: Apache-2.0"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op4_licences(spark, "").collect()
    assert sorted((str(r.doc_id), r.notices) for r in got) == [("5", ""), ("5", "Apache-2.0"), ("None", ""), ("None", "CC-BY-NC-4.0")]
