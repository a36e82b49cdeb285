"""Targets, takes and positions against plain Python."""

import hashlib

import pytest
from helpers import DOCS, awkward, nothing

from entityflow.llm import mixing


def brute_targets(sizes, weights, most=3):
    total, capped = sum(sizes.values()), set()
    while True:
        free = {s for s in sizes if s not in capped}
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in sizes}
        capped |= over


def docs_of(spark, counts):
    rows, i = [], 0
    for s, sizes in counts.items():
        for n in sizes:
            rows.append((i, " ".join(["w"] * n), "en", s, 0))
            i += 1
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("counts", [
    {"a": [10] * 50, "b": [7] * 10, "c": [5] * 3, None: [4] * 9},
    {"a": [3], "b": [400] * 20, "c": [1, 2, 3], "d": [50]},
    {"a": [0, 0], "b": [5]},
])
def test_targets_and_takes(spark, counts):
    got = mixing.allocate(docs_of(spark, counts)).collect()
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    want = brute_targets({s: sum(counts[s]) for s in counts}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for s in counts:
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(want[s]) for r in own)
        assert sum(r.taken for r in own) == round(want[s])
        assert all(r.taken <= 3 * r["size"] for r in own)
        own.sort(key=lambda r: hashlib.md5(str(r.row.doc_id).encode()).hexdigest())
        before = 0
        for r in own:
            assert r.before == before
            before += r["size"]


def test_positions_follow_the_schedule(spark):
    """Of a source's words up to a time, the share is the schedule's integral up to it."""
    docs = docs_of(spark, {"a": [5] * 800, "b": [5] * 800, "c": [5] * 800})
    placed = mixing.positioned(mixing.allocate(docs)).collect()
    for s, knots in zip("abc", mixing.SCHEDULES):
        own = [r for r in placed if r.source == s]
        for t in (0.2, 0.5, 0.8):
            cut = [(a, w) for a, w in knots if a < t]
            (a, w), (b, v) = cut[-1], next((k for k in knots if k[0] >= t))
            want = mixing.integral([*cut, (t, w + (v - w) * (t - a) / (b - a))]) / mixing.integral(knots)
            assert sum(r.words for r in own if r.position <= t) / own[0].goal == pytest.approx(want, abs=0.01)


def test_mix_is_ordered_and_repeatable(spark):
    docs = docs_of(spark, {"a": [5] * 60, "b": [9] * 300, "c": [2] * 30})
    one, two = [r.doc_id for r in mixing.mix(docs).collect()], [r.doc_id for r in mixing.mix(docs.repartition(5)).collect()]
    assert one == two
    assert mixing.mix(docs).columns == docs.columns


def test_awkward_tables(spark):
    docs = awkward(spark)
    got = mixing.allocate(docs).collect()
    assert len(got) == docs.count() and all(r.taken == 0 for r in got if r.row.text is None)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.allocate(nothing(spark)).count() == 0


def test_takes_are_read_from_the_ordered_mix(spark, monkeypatch):
    """What a document gives is what its copies have in the mix, which is placed by the schedules and range-sorted."""
    written, keep = {}, mixing.materialise

    def watched(df, name):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(mixing, "materialise", watched)
    docs = docs_of(spark, {"a": [5] * 60, "b": [9, 0, 0] * 100, None: [2] * 30}).union(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    got = sorted(str(tuple(r)) for r in mixing.takes(docs).collect())
    assert got == sorted(str(tuple(r)) for r in mixing.allocate(docs, keep_rows=False).select("row", "size", "source_size", "target", "taken").collect())
    order = [r.position for r in written["mix-order"].collect()]
    assert len(order) > 90 and all(0 <= x <= 1 for x in order)
    assert sum(r.words for r in written["mix-order"].collect()) == sum(r.taken for r in mixing.takes(docs).collect())
    assert mixing.takes(nothing(spark)).count() == 0
