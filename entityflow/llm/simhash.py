"""SimHash fingerprints and their components by covering locality-sensitive hashing.

Masks come from a linear code: every bit position has a non-zero vector of ``radius + 1`` bits, and each non-zero vector
``v`` gives the mask of the positions whose vector has an odd product with ``v``. Up to ``radius`` differing positions
span less than the whole space, so some ``v`` is orthogonal to all of them and its mask leaves every differing bit out:
each pair within the radius agrees under at least one of the ``2 ** (radius + 1) - 1`` masks. Nothing is missed.

Equal fingerprints are one row before masking. A bucket with more distinct fingerprints than ``_BUCKET`` is masked a
second time over the bits its mask leaves free, which covers the pairs in it just the same and leaves at most 2 ** 16
distinct fingerprints in any bucket. A bucket gives the links of a spanning forest, not its pairs; buckets are streamed
in sorted order with one bucket in memory.

Edge cases: a NULL or wordless text has fingerprint 0 and links like any other; fewer words than a shingle make one
shingle of all words; NULL ids are carried, and a component's id is its smallest non-NULL id; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import boxed, row_key, unboxed
from entityflow.llm.graph import components
from entityflow.sources.storage import materialise

_BUCKET = 1 << 16
_CHUNK = 1 << 17


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits over the hashes of all word shingles; a bit is 1 if over half of the hashes have it."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    width = min(shingle, len(parts))
    first, last = starts[: len(parts) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _CHUNK):
        pairs = zip(first[at : at + _CHUNK].tolist(), last[at : at + _CHUNK].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in pairs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: Column, shingle: int = 4, **keys: Column) -> DataFrame:
    """The key columns and ``fp`` (the 64 bits as a signed long) of every row."""
    named = df.select(*[c.alias(k) for k, c in keys.items()], text.cast("binary").alias("text"))
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in names], pa.array(found.view(np.int64))], [*names, "fp"]
                )

    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    return named.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "fp bigint"]))


def masks(positions: list[int], radius: int) -> list[int]:
    """The covering masks over the given bit positions."""
    vectors = (1 << (radius + 1)) - 1
    code = {p: i % vectors + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (code[p] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(fps: DataFrame, which: list[tuple[int, int]]) -> DataFrame:
    """(table, key, fp) for each (table number, mask)."""
    pick = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in which]))
    return fps.select("fp", pick.alias("k")).select(
        F.col("k.t").alias("table"), F.col("fp").bitwiseAND(F.col("k.m")).alias("key"), "fp")


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) that join exactly the fingerprints which chains of steps within the radius join. Each search
    compares with fingerprints not reached yet, so a dense group costs little more than one pass."""
    left, a, b = fps, [], []
    while len(left) > 1:
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= radius
            if near.any():
                hit = left[near]
                left = left[~near]
                a.append(hit)
                b.append(np.full(len(hit), root))
                todo.extend(hit)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _linked(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b): the links of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3  # rows of the bucket that may go on in the next batch

        def links(table: np.ndarray, key: np.ndarray, fp: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            found = [
                forest(np.unique(fp[i:j]).view(np.uint64), radius)
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if j - i > 1
            ]
            sides = [np.concatenate([x[s] for x in found] or [np.zeros(0, np.uint64)]).view(np.int64) for s in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(s) for s in sides], ["a", "b"])

        for batch in batches:
            rows = [
                np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)])
                for r, c in zip(rest, ("table", "key", "fp"))
            ]
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            cuts = np.concatenate([[0], new])
            yield links(*rows, cuts)
            rest = [r[cuts[-1] :] for r in rows]
        if len(rest[0]):
            yield links(*rest, np.array([0, len(rest[0])]))

    dealt = buckets.repartition("table", "key").sortWithinPartitions("table", "key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) whose components are those of all pairs within ``radius``."""
    first = masks(list(range(64)), radius)
    rows = _buckets(fps, list(enumerate(first)))
    full = rows.groupBy("table", "key").count().where(F.col("count") > _BUCKET).select("table", "key")
    full = materialise(full, "simhash-full-buckets")
    on = ["table", "key"]
    links = _linked(rows.join(full, on, "left_anti"), radius)
    if full.isEmpty():
        return links
    again = rows.join(full, on, "left_semi")
    parts = [
        (t * len(first) + i, m | n)
        for t, m in enumerate(first) for i, n in enumerate(masks([p for p in range(64) if not m >> p & 1], radius))
    ]
    pick = F.explode(F.filter(
        F.array(*[F.struct(F.lit(n).alias("t"), F.lit(_signed(m)).alias("m")) for n, m in parts]),
        lambda x: F.floor(x["t"] / len(first)) == F.col("table"),
    ))
    finer = again.select("fp", "table", pick.alias("k")).select(
        F.col("k.t").alias("table"), F.col("fp").bitwiseAND(F.col("k.m")).alias("key"), "fp")
    return links.union(_linked(finer, radius)).distinct()


def near_duplicates(df: DataFrame, text: Column, radius: int = 4, shingle: int = 4, **keys: Column) -> DataFrame:
    """Every row's keys, ``fp``, ``root`` (a fingerprint that names the component) and ``component``: the smallest first
    key reachable over links within ``radius``.

    Fingerprints are written once. Copies meet in a partial aggregate, so a group of any size is one fingerprint from
    there on; only the last join, by fingerprint, sees the copies again, and Spark splits its large keys.
    """
    docs = materialise(fingerprints(df, text, shingle, **keys), "simhash-fingerprints")
    smallest = next(iter(keys))
    distinct = materialise(docs.groupBy("fp").agg(F.min(smallest).alias("least")), "simhash-distinct")
    linked = components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.select("fp", "root").join(ids, "root").select(F.col("fp").alias("of"), "root", "component")
    return docs.join(named, F.col("fp") == F.col("of")).drop("of")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (NULL last), then text hash. Rows
    equal in id and text are one document, of which one row stays."""
    key = row_key(F.col(doc_id), F.col(text))
    groups = near_duplicates(df, F.col(text), radius, shingle, id=F.col(doc_id), **key)
    first = F.min(F.struct(F.col("id").isNull(), "id", "h2", "h1")).alias("first")
    heads = groups.groupBy("root").agg(first).select(F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2"))
    rows = boxed(df, **key).join(heads, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return unboxed(rows, df.columns)
