"""Recurring line templates on planted lines."""

import numpy as np
import pytest
from helpers import DOCS, awkward, nothing
from pyspark.sql import functions as F

from entityflow.llm import lines


def prose(i):
    return " ".join(f"{a}{i}x" for a in "abcdefghij") + ".\n" + " ".join(f"p{chr(97 + (i * k) % 26)}{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for k in range(20))


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_templates_go_and_prose_stays(spark, sent):
    names = ["ann", "bo", "cy", "di", "ed", "fay", "gus", "hal"]
    rows = []
    for i in range(40):
        extra = []
        if i % 2 == 0:
            extra.append("All content on this site is free to read")
        if i % 4 == 1:
            extra.append(f"Posted by user {names[i // 4 % 8]} at {i}:00 in the forum")  # two variable fields
        if i == 7:
            extra.append("Posted by user nobody")
        rows.append((i, "\n".join([prose(i), *extra]), "en", "a", 0))
    got = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(rows, DOCS), p=lines.TemplateParams(most_sent=sent)).collect()}
    for i, text, *_ in rows:
        gone = i % 2 == 0 or i % 4 == 1
        assert got[i].n_dropped_lines == int(gone)
        assert got[i].text == (prose(i) if gone else text)


def test_copies_stay_whole(spark):
    body = "\n".join(f"line number {'abcdefg'[k]} of the text" for k in range(7))
    rows = [(i, body, "en", "a", 0) for i in range(20)]  # equal texts are one text
    rows += [(100 + i, body + f"\nend {chr(97 + i)}", "en", "a", 0) for i in range(20)]  # near copies lose too much
    got = lines.drop_recurring(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.text for r in got} == {i: t for i, t, *_ in rows}


def test_awkward_tables(spark):
    docs = awkward(spark)
    got = lines.drop_recurring(docs, p=lines.TemplateParams(min_docs=1, most=1.0))
    assert got.count() == docs.count()
    assert {r.text for r in got.where("doc_id = 1").collect()} == {None}
    assert got.where("doc_id = 4").select("text").distinct().first().text == ""
    assert got.columns[: len(docs.columns)] == docs.columns
    assert lines.drop_recurring(nothing(spark)).count() == 0


def test_repeated_rows_are_one_text(spark):
    docs = spark.createDataFrame([(1, "common words stand here\nown", "en", "a", 0)] * 9 + [(2, "other", "en", "a", 0)], DOCS)
    assert lines.drop_recurring(docs).agg(F.sum("n_dropped_lines")).first()[0] == 0


def test_lines_sent_and_joined_give_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.limit(5)).withColumn("gone", F.lit(1)).withColumn("body", F.lit("x"))
    sent, joined = (lines.drop_recurring(docs, p=lines.TemplateParams(most_sent=n)) for n in (1 << 20, 0))
    assert sent.columns == joined.columns
    assert sent.exceptAll(joined).count() == joined.exceptAll(sent).count() == 0
    assert sent.where("n_dropped_lines > 0").count() > 0


def test_awkward_tables_joined(spark):
    p = lines.TemplateParams(min_docs=1, most=1.0, most_sent=0)
    docs = awkward(spark)
    sent = lines.drop_recurring(docs, p=lines.TemplateParams(min_docs=1, most=1.0))
    assert lines.drop_recurring(docs, p=p).select("doc_id", "text").exceptAll(sent.select("doc_id", "text")).count() == 0
    assert lines.drop_recurring(nothing(spark), p=p).count() == 0


def test_among():
    known = np.array([2, 5, 9])
    assert lines.among(np.array([1, 2, 9, 10]), known).tolist() == [False, True, True, False]
    assert lines.among(np.array([1]), known[:0]).tolist() == [False]


def test_long_lines_recur_from_two_texts_on(spark):
    long, short = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55)), " ".join(f"part{chr(97 + i)}" for i in range(20))
    rows = [(i, "\n".join([prose(i), prose(i + 50), prose(i + 100), *([long] if i < 2 else []), *([short] if 2 <= i < 6 else [])]), "en", "a", 0) for i in range(10)]
    got = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r.n_dropped_lines for i, r in got.items()} == {i: int(i < 2) for i in range(10)}
    assert long not in got[0].text and short in got[2].text


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_short_carriers_lose_the_passage_and_copies_stay(spark, sent):
    word = lambda a, i: f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}"
    passage = " ".join(word("shared", i) for i in range(55))
    own = lambda k: " ".join(word(f"own{chr(97 + k)}", i) for i in range(45))
    body = [" ".join(word(f"line{chr(97 + k)}", i) for i in range(12)) for k in range(12)]
    rows = [(k, passage + "\n" + own(k), "en", "a", 0) for k in range(6)]
    edited = lambda k: body[k].rsplit(" ", 1)[0] + " other" + chr(97 + k)
    rows += [(100 + k, "\n".join([*body[:k], edited(k), *body[k + 1 :]]), "en", "a", 0) for k in range(6)]  # one word replaced
    docs = spark.createDataFrame(rows + rows[-2:], DOCS)
    got = lines.drop_recurring(docs, p=lines.TemplateParams(most_sent=sent)).collect()
    assert {r.doc_id: r.text for r in got} == {i: own(i) if i < 100 else t for i, t, *_ in rows}
    assert len(got) == 14


def test_a_common_opening_is_no_template(spark):
    name = lambda a, i: f"{a}{chr(97 + i)}"
    extra = [[f"It was then {name('rest', i)}", f"Page {i} of 20", "Terms of use apply", f"It was then {name('one', i)} {name('two', i)} {name('three', i)}"] for i in range(12)]
    rows = [(i, "\n".join([prose(i), prose(i + 50), *extra[i]]), "en", "a", 0) for i in range(12)]
    got = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(rows, DOCS)).collect()}
    for i in range(12):
        assert got[i].text == "\n".join([prose(i), prose(i + 50), extra[i][0], extra[i][3]])
        assert got[i].n_dropped_lines == 2


def test_texts_of_mostly_boilerplate_lose_it(spark):
    footer = "all rights to this text stay with its author\nsend a letter to the address printed above"
    own = lambda i: " ".join(f"w{chr(97 + (i * 7 + k * 5) % 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(6))
    rows = [(i, own(i) + "\n" + footer, "en", "a", 0) for i in range(40)]
    got = lines.drop_recurring(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.text for r in got} == {i: own(i) for i in range(40)}


def test_copies_stay_whole_however_many_others_share_their_lines(spark):
    notice = [" ".join(f"n{chr(97 + k)}{chr(97 + j)}" for j in range(8)) for k in range(6)]
    rows = [(100 * k + i, prose(20 * k + i) + "\n" + notice[k], "en", "a", 0) for k in range(6) for i in range(20)]
    copies = [(1000 + i, "\n".join([*notice, "these words close the whole " + "xy"[i]]), "en", "a", 0) for i in range(2)]
    got = {r.doc_id: r.n_dropped_lines for r in lines.drop_recurring(spark.createDataFrame(rows + copies, DOCS)).collect()}
    assert got == {**{i: 1 for i, *_ in rows}, 1000: 0, 1001: 0}


def test_lines_are_counted_without_a_shuffle_of_all(spark):
    """Leaves, bodies and templates that are few are looked up in tasks: no join of all lines, which grew by a power of 1.29."""
    docs = spark.createDataFrame([(i, prose(i) + "\nAll content on this site is free to read", "en", "a", 0) for i in range(12)], DOCS)
    p = lines.TemplateParams()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = lines.parse(docs, "text", "doc_id", p.depth).localCheckpoint()
        found = lines.templates(docs, parsed, "text", "doc_id", p)
        assert found.select("template", "docs").collect() == [("All content on this site is free to read", 12)]
        # only templates and their counts are joined; the lines were joined with the shapes before
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_looked_up(spark):
    known = np.array([-4, 2, 9])
    found = spark.createDataFrame([(9,), (3,), (-4,), (10,)], "x bigint").select(
        lines.held(known)("x").alias("held"), lines.looked_up(known, np.array([1, -2, 3]))("x").alias("value"))
    assert [tuple(r) for r in found.collect()] == [(True, 3), (False, None), (True, 1), (False, None)]
