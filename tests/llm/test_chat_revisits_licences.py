"""Formatting round trips, revisit resolution and licence lookups on small cases."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entityflow.llm import chat, licences, revisits

TURNS = "conv_id long, turn long, role string, text string"
hostile = st.text(alphabet=st.sampled_from("\\blg<>+/turn: \n#é"), max_size=20)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "a>b", ""]), hostile), min_size=1, max_size=40))
def test_every_turn_comes_back(spark, turns):
    rows = [(c, i, r, t) for i, (c, r, t) in enumerate(turns)]
    done = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    for r in done.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect():
        own = [(x, t) for c, _, x, t in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == own
        assert r.loss == "".join(t for x, t in own if x == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)


def test_conversation_edges(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (1, 3, "assistant", None), (None, 0, "user", "x"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(1)).withColumn("segments", F.lit(1))
    got = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert got[1] == "<turn:></turn>\n<turn:user>a<+>b</turn>\n<turn:assistant></turn>\n"
    assert got[None] == "<turn:user>x<+>x</turn>\n"
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


RECORDS = "record_id long, kind string, url string, captured_at long, status int, headers map<string,string>, body string, row string, at long"


def resolve(spark, rows):
    df = spark.createDataFrame([(*r, f"body {r[0]}", "x", 0) for r in rows], RECORDS)
    return {r.row.record_id: r for r in revisits.resolve_revisits(df).collect()}, df


def test_revisits(spark):
    full = {"ETag": '"1"', "Content-Type": "text/html", "Date": "d0"}
    rows = [
        (1, "response", "http://www.A.org/x/?b=2&a=1&utm_source=z#f", 10, 200, full), (2, "response", "https://a.org/x?a=1&b=2", 20, 404, full),
        (3, "response", "https://a.org/x?a=1&b=2", 30, 200, {"etag": '"2"'}), (4, "revisit", "https://a.org:443/x?b=2&a=1", 25, 304, {"ETAG": '"1"', "Date": "d1", "Content-Length": "0"}),
        (5, "revisit", "https://a.org/x?a=1&b=2", 40, 304, {"ETag": '"1"'}), (6, "revisit", "https://a.org/x?a=1&b=2", 40, 304, {"ETag": 'W/"2"'}),
        (7, "revisit", "https://a.org/x?a=1&b=2", 5, 304, {}), (8, "revisit", None, 5, 304, None), (9, "revisit", "https://a.org/x?a=1&b=2", None, 304, {}),
        (10, "revisit", "https://a.org/x?a=1&b=2", 40, 304, None), (11, "response", "http://b.org", 1, 200, None), (12, "revisit", "http://b.org/", 1, 304, {}),
        (13, "revisit", "http://b.org/", 0, 304, {}), (14, "revisit", "ftp://b.org/", 9, 304, {}),
    ]
    got, df = resolve(spark, rows)
    assert {i: (r.verdict, r.response_id) for i, r in got.items()} == {
        4: ("resolved", 1), 5: ("mismatch", None), 6: ("resolved", 3), 7: ("no_response", None), 8: ("no_response", None), 9: ("no_response", None),
        10: ("mismatch", None), 12: ("resolved", 11), 13: ("no_response", None), 14: ("no_response", None)}
    assert dict(tuple(h) for h in got[4].headers) == {"etag": '"1"', "content-type": "text/html", "date": "d1"}
    bodies = revisits.with_bodies(revisits.resolve_revisits(df), df, "body").where("row.record_id = 4").first()
    assert bodies.body == "body 1"
    assert resolve(spark, [])[0] == {}


def test_one_hot_url_over_many_partitions(spark):
    rows = []
    for i in range(3000):
        kind = "response" if i % 10 == 0 else "revisit"
        rows.append((i, kind, "http://h.org/", i // 7, 200 if kind == "response" else 304, {"etag": f'"{i}"'} if kind == "response" else {"last-modified": "x"}))
    got, _ = resolve(spark, rows)
    assert len(got) == 2700 and {r.verdict for r in got.values()} == {"mismatch"}
    df = spark.createDataFrame([("k", i // 7, i, (i,) if i % 10 == 0 else None) for i in range(3000)], "k string, t long, n long, v struct<x:long>")
    assert all(r.latest.x == (r.n - 1) // 10 * 10 for r in revisits.as_of(df, "k", "t", "n", "v").collect() if r.n)


def test_licences(spark):
    mit = next(t for k, t in licences.KNOWN if k == "MIT" and len(t) > 200)
    variant = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence".replace("licence", "license")).replace(",", " ,") + "\n"
    rows = [(1, mit), (2, variant), (3, mit + " more"), (4, None), (5, ""), (6, "..."), (7, "own text\nLicenced under CC BY-NC 4.0!\nReleased under the MIT Licence"),
            (7, "own text\nLicenced under CC BY-NC 4.0!\nReleased under the MIT Licence")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit(1)).withColumn("known", F.lit(1))
    got = licences.scan(df).select("row.doc_id", "digest", "licence").collect()
    assert {r.doc_id: r.licence for r in got} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: None} and len(got) == 8
    assert all((r.digest is None) == (r.doc_id in (4, 5, 6)) for r in got)
    assert [tuple(r) for r in licences.scan_lines(df, id=F.col("doc_id")).collect()] == [(7, ["CC-BY-NC-4.0", "MIT"])]
    assert licences.scan(df.where("false")).count() == 0
    assert hashlib.sha256(b"released under the mit license").hexdigest() in {r.known for r in licences.known_digests(spark).collect()}


def test_every_known_text_has_a_hint():
    assert all(re.search(licences.HINT, t) for _, t in licences.KNOWN)
