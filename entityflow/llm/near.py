"""Near copies by the Jaccard similarity of their word shingles.

A text is the set of its shingles (64-bit hashes). Texts with equal sets are one row from there on. The others meet in
``bands`` buckets, each keyed by ``rows`` MinHash values; of a pair at similarity s the buckets miss
``(1 - s ** rows) ** bands``, which is 7e-6 at 0.8 and less above. Every pair that meets is judged by its exact
similarity unless links already join it, so nothing below ``similarity`` is linked. For ``one_of_each`` the buckets only save
work: what they leave apart, pairs that meet in none included, is joined exactly.

A bucket's members are compared with leading ones: those that share most buckets with others, of different components
first, for a text that many near copies were made from meets each of them more often than they meet one another. The first
``rounds`` turns have one leader, the next has ``few``, so that smaller buckets are compared pair by pair. Buckets of more
members than that, in more than one component, are then split by ``parts`` keys of ``deep`` further MinHash values each and
led by ``few`` once more. A turn makes one row per member and bucket, and per member as many pairs as its small buckets have
different leaders (at most ``few`` each) and ``few`` for all its large ones. A split keeps a pair at similarity s together
with probability ``1 - (1 - s ** deep) ** parts``, 0.88 at 0.8, in each of the ten buckets that such a pair shares on
average. Those turns only save work: all sets, or (for ``copied``) those whose large buckets still hold more than one component,
are then joined exactly. Of two sets at the similarity each has a shingle of the other among its first
``n - similarity * n + 1`` ones in any one order; in the order of their number, shingles that texts have in common by a template
come last. That number is kept for ``weights`` groups of shingles, so a set finds its first ones by itself and the others never
become rows of a join. Every pair of different components that shares such a shingle, early enough in both for the similarity to be
reached by what follows, is judged, so no pair that meets in a bucket, and for all sets no pair at the similarity, is left out.
Buckets are joins and partial aggregates; no task holds a bucket or a group, and sets are compared as Spark arrays, a pair at a time.

``copied`` only asks which documents are a copy at all. It takes the same steps but for the split and for the pairs that meet in no
bucket, with all that is settled as one component: what has a copy need not meet another, and no components are searched.

Edge cases: NULL and wordless texts have the empty set and are one; fewer words than a shingle make one shingle of all
words; repeated rows are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.functions.ranking import first_n
from entityflow.llm.common import bounded, boxed, row_key, unboxed
from entityflow.llm.graph import stars
from entityflow.sources.storage import materialise

_CHUNK = 2048


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5  # words
    similarity: float = 0.8  # least Jaccard similarity of near copies
    bands: int = 30
    rows: int = 5  # MinHash values of a band
    rounds: int = 1  # comparisons with one leading member
    few: int = 8  # leading members of the turns after that
    parts: int = 4  # keys by which a bucket is split
    deep: int = 4  # MinHash values of such a key
    weights: int = 1 << 18  # numbers (a power of two) by which shingles are put in order


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, width: int, seen: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of a text's word shingles; ``seen`` keeps word hashes between texts."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    for w in set(parts).difference(seen):
        seen[w] = xxh64_intdigest(w, 42)
    words = np.fromiter(map(seen.__getitem__, parts), np.uint64, len(parts))
    width = min(width, len(parts))
    n = len(parts) - width + 1
    total = np.full(n, width, np.uint64)
    for j, c in enumerate(_constants(width, 1)):
        total += _mixed(words[j : j + n] * c)
    return np.unique(_mixed(total))


def minima(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, one per multiplier."""
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, (by[:, None] * found[None, at : at + _CHUNK]).min(axis=1))
    return least


def band_keys(least: np.ndarray, p: NearParams) -> np.ndarray:
    parts = _mixed(least.reshape(p.bands, p.rows) * _constants(p.rows, 3))
    return _mixed(parts.sum(axis=1, dtype=np.uint64))


def _name(found: np.ndarray) -> int:
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def hashed(df: DataFrame, p: NearParams, counted: bool = False) -> DataFrame:
    """(id, h1, h2, s, n, keys) of each row of (id, h1, h2, text): the set's hash and size, and its key in each band.

    If ``counted``, the first row of each slice of texts also has ``times``: how many of the slice's shingles are in each group."""
    by = _constants(p.bands * p.rows, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                seen = {}
                sets = [shingles(t, p.shingle, seen) for t in part.column("text").to_pylist()]
                keys = [band_keys(minima(x, by), p).view(np.int64) for x in sets]
                columns = [*[part.column(c) for c in ("id", "h1", "h2")], pa.array(map(_name, sets), pa.int64()),
                           pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                if counted:
                    times = np.zeros(p.weights, np.int32)
                    for x in sets:  # a set at a time: no second copy of all
                        np.add.at(times, (x & np.uint64(p.weights - 1)).astype(np.int64), 1)
                    columns.append(pa.array([times, *[None] * (len(sets) - 1)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "h1", "h2", "s", "n", "keys", "times"][: len(columns)])

    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, h1 bigint, h2 bigint, s bigint, n bigint, keys array<bigint>"
    return df.mapInArrow(run, schema + ", times array<int>" * counted)


def _sets(df: DataFrame, p: NearParams, keyed: bool = True) -> DataFrame:
    """(s, found, keys) of each row of (s, text): the set, and (if ``keyed``) the keys by which its buckets are split."""
    by, parts = _constants(p.parts * p.deep, 5), _constants(p.deep, 3)

    def split(found: np.ndarray) -> np.ndarray:
        return _mixed(_mixed(minima(found, by).reshape(p.parts, p.deep) * parts).sum(axis=1, dtype=np.uint64)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                seen = {}
                found = [shingles(t, p.shingle, seen) for t in part.column("text").to_pylist()]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("s"), pa.array([x.view(np.int64) for x in found], longs), pa.array([split(x) if keyed else None for x in found], longs)],
                    ["s", "found", "keys"])

    return df.mapInArrow(run, "s bigint, found array<bigint>, keys array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) of at least the similarity."""
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("found").alias("x")), "a").join(
        sets.select(F.col("s").alias("b"), F.col("found").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("n"))
    total = F.col("n") - F.col("common")
    return common.where((total == 0) | (F.col("common") / F.when(total > 0, total) >= p.similarity)).select("a", "b")


def _weights(counts: DataFrame, p: NearParams) -> np.ndarray:
    """The sums of (ends, f), numbers of shingles that end in the same bits: ``weights`` numbers at most, whatever the input."""
    ends = counts.groupBy("ends").agg(F.sum("f").alias("f")).toArrow()
    out = np.zeros(p.weights, np.int64)
    out[ends.column("ends").to_numpy()] = ends.column("f").to_numpy()
    return out


def _counted(docs: DataFrame, p: NearParams) -> DataFrame:
    """(ends, f) of all slices' ``times``, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.weights, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                total += batch.column("times")[at].values.to_numpy()
        ends = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(total[ends])], ["ends", "f"])

    return docs.select("times").where("times is not null").mapInArrow(run, "ends bigint, f bigint")


def _firsts(found: np.ndarray, weight: np.ndarray, p: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the order of their weights, and their places there, from 1; those without one come
    before all others and are left out."""
    n, heavy = len(found), weight[found & (p.weights - 1)]
    shared = np.flatnonzero(heavy)
    before = n - len(shared)
    take = max(0, min(len(shared), n - int(np.floor(p.similarity * n)) + 1 - before))
    shared = shared[np.lexsort((found[shared], heavy[shared]))[:take]]
    return found[shared], np.arange(before + 1, before + take + 1)


def _first_shingles(asked: DataFrame, sets: DataFrame, p: NearParams) -> DataFrame:
    """(token, s, n, root, at) of the shingles by which sets (s, root) of different components can be alike: of each set the
    first ones in one order of all, those of a single component before the rare ones; ``at`` is the place there, from 1.

    The order is by the number of sets that hold a shingle, or another of the same weight, so each set is put in order by
    itself and only its first shingles become rows; those that turn out to be of a single component are left out."""
    found = asked.join(sets, "s").select("s", "root", "found")
    held = found.select("root", F.explode("found").alias("token")).groupBy("token").agg(
        F.count("*").alias("f"), F.min("root").alias("a"), F.max("root").alias("z"))
    held = materialise(held.where("a < z").select("token", "f"), "near-held")
    weight = _weights(held.select(F.col("token").bitwiseAND(F.lit(p.weights - 1)).alias("ends"), "f"), p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, token, size, at = [], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            lists = batch.column("found")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                first, places = _firsts(values[lo:hi], weight, p)
                row += [i] * len(first)
                size += [hi - lo] * len(first)
                token.append(first)
                at.append(places)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(token)), batch.column("s").take(rows), pa.array(size, pa.int64()),
                 batch.column("root").take(rows), pa.array(np.concatenate(at))],
                ["token", "s", "n", "root", "at"])

    return found.mapInArrow(run, "token bigint, s bigint, n bigint, root bigint, at bigint").join(held, "token", "left_semi")


def _leading(texts: DataFrame, weight: np.ndarray, p: NearParams) -> DataFrame:
    """(token, s, n, at) of the first shingles of each set of (text), equal sets of a slice once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                seen, sets = {}, {}
                token, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for t in part.column("text").to_pylist():
                    found = shingles(t, p.shingle, seen)
                    name = _name(found)
                    if name not in sets:
                        first, places = _firsts(found.view(np.int64), weight, p)
                        sets[name] = (len(found), len(first))
                        token.append(first)
                        at.append(places)
                takes = [take for _, take in sets.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token)), pa.array(np.repeat(np.array(list(sets), np.int64), takes)),
                     pa.array(np.repeat(np.array([n for n, _ in sets.values()], np.int32), takes)),
                     pa.array(np.concatenate(at).astype(np.int32))],
                    ["token", "s", "n", "at"])

    return texts.select("text").mapInArrow(run, "token bigint, s bigint, n int, at int")


def _maybe_alike(first: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) of different components that have a first shingle in common with enough behind it in both sets."""
    # sets at the similarity have this share of both sizes in common, none of it before the first; the rest is for rounding
    share, rounding = p.similarity / (1 + p.similarity), 0.001
    # of the smaller set fewer shingles do, as the other is as large at least
    small = first.where(F.col("at") <= F.col("n") + 1 - 2 * share * F.col("n") + rounding)
    other = first.select("token", F.col("s").alias("b"), F.col("n").alias("m"), F.col("root").alias("of"), F.col("at").alias("to"))
    larger = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("s") < F.col("b")))
    worth = F.col("n") >= p.similarity * F.col("m")
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) + 1 >= share * (F.col("n") + F.col("m")) - rounding
    met = small.join(other, "token").where(larger & (F.col("root") != F.col("of")) & worth & enough)
    return met.select(F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b")).distinct()


class _Links:
    """The pairs judged so far, and the component of each set that is not its least one."""

    def __init__(self, sets: DataFrame, p: NearParams):
        self.sets, self.p = sets, p
        self.tried: DataFrame | None = None
        self.roots: DataFrame | None = None  # (a, b): b is the least set of a's component

    def with_root(self, rows: DataFrame) -> DataFrame:
        if self.roots is None:
            return rows.withColumn("root", F.col("s"))
        roots = self.roots.select(F.col("a").alias("s"), F.col("b").alias("root"))
        return rows.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))

    def rooted(self, member: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component, with their ``root``."""
        now = materialise(self.with_root(member), "near-rooted")
        live = now.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count("*").alias("size")).where("a < z")
        return now.join(live.select("bucket", "size"), "bucket")

    def compare(self, pairs: DataFrame) -> None:
        """Judge pairs (a, b) that were not judged before and keep those alike."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near-pairs")
        new = materialise(_alike(pairs, self.sets, self.p), "near-links")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        if self.roots is None or not new.isEmpty():
            self.keep(new)

    def keep(self, links: DataFrame) -> None:
        self.roots = stars(links if self.roots is None else self.roots.union(links))

    def lead(self, now: DataFrame, leaders: int) -> None:
        """Compare rooted members with the leading ones of their buckets.

        A bucket's leaders travel as one array, so a member makes one row per bucket; the leaders of all its buckets are
        put together, each once, before they become pairs. With several leaders, those of buckets with more members than
        that are cut to as many for all such buckets of a member: the ones with the highest score.
        """
        best = [F.desc("score"), F.xxhash64("s", "bucket")]
        own = first_n(now, ["bucket", "root"], best, leaders, "_nth")
        heads = first_n(own, ["bucket"], [F.col("_nth"), *best], leaders).groupBy("bucket").agg(
            F.collect_list(F.struct("s", "n", "root", "score")).alias("heads"))

        def worth(h):
            return (h["root"] != F.col("root")) & (F.least(h["n"], F.col("n")) >= self.p.similarity * F.greatest(h["n"], F.col("n")))

        met = now.join(heads, "bucket").select(
            "s", "size", F.transform(F.filter("heads", worth), lambda h: F.struct(h["score"].alias("score"), h["s"].alias("s"))).alias("heads"))
        whole = F.lit(leaders == 1) | (F.col("size") <= leaders)

        def together(of: Column) -> Column:
            return F.array_distinct(F.flatten(F.collect_list(F.when(of, F.col("heads")))))

        met = met.where(F.size("heads") > 0).groupBy("s").agg(together(whole).alias("all"), together(~whole).alias("some"))
        some = F.slice(F.sort_array("some", asc=False), 1, leaders)
        heads = F.array_distinct(F.transform(F.concat("all", some), lambda h: h["s"]))
        pairs = met.select("s", heads.alias("heads")).select("s", F.explode("heads").alias("t")).select(
            F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
        self.compare(pairs.distinct())

    def join_rest(self, member: DataFrame, few: int) -> None:
        """Judge all pairs of different components among the sets whose buckets of more than ``few`` members hold several."""
        asked = materialise(self.rooted(member).where(F.col("size") > few).select("s", "root").distinct(), "near-rest")
        if asked.isEmpty():
            return
        first = materialise(_first_shingles(asked, self.sets, self.p), "near-first")
        self.compare(_maybe_alike(first, self.p))

    def join_all(self, docs: DataFrame, texts: DataFrame, one: DataFrame) -> None:
        """Judge all pairs of different components that can be at the similarity, whether they met in a bucket or not."""
        first = _leading(texts, _weights(_counted(docs, self.p), self.p), self.p)
        # dealt once: most first shingles are of a single set
        over = Window.partitionBy("token")
        first = first.select("token", "s", "n", "at", F.min("s").over(over).alias("a"), F.max("s").over(over).alias("z"))
        first = materialise(first.where("a < z").drop("a", "z"), "near-shared-first")
        first = materialise(self.with_root(first.distinct()), "near-rooted")
        live = first.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z")
        first = materialise(first.join(live, "token", "left_semi"), "near-first")
        pairs = _maybe_alike(first, self.p)
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near-last")
        if pairs.isEmpty():
            return
        ends = materialise(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct(), "near-ends")
        more = _shingled(one, ends.join(self.sets, "s", "left_anti"), texts, self.p, keyed=False)
        self.sets = self.sets.join(ends, "s", "left_semi").unionByName(more)
        self.compare(pairs)


class _Settled(_Links):
    """The same with all sets that need no further copy as one component."""

    def __init__(self, sets: DataFrame, settled: DataFrame, p: NearParams):
        super().__init__(sets, p)
        self.roots = settled.select(F.col("s").alias("a"), F.lit(0).cast("long").alias("b"))

    def keep(self, links: DataFrame) -> None:
        ends = links.select("a").union(links.select("b")).select("a", F.lit(0).cast("long").alias("b"))
        self.roots = materialise(self.roots.union(ends).distinct(), "near-settled")


def _members(one: DataFrame, wanted: str = "true") -> DataFrame:
    """(s, n, score, bucket) of the sets (s, n, keys) that share a bucket with another, where one of the bucket is wanted."""
    at = one.select("s", "n", F.expr(wanted).alias("wanted"), F.posexplode("keys").alias("band", "key"))
    at = at.select("s", "n", "wanted", F.xxhash64("band", "key").alias("bucket"))
    shared = at.groupBy("bucket").agg((F.count("*") - 1).alias("others"), F.max("wanted").alias("any")).where("others > 0 and any")
    member = materialise(at.drop("wanted").join(shared.drop("any"), "bucket"), "near-shared")
    score = member.groupBy("s").agg(F.sum("others").alias("score"))
    return materialise(member.drop("others").join(score, "s"), "near-members")


def _shingled(one: DataFrame, member: DataFrame, texts: DataFrame, p: NearParams, keyed: bool = True) -> DataFrame:
    """(s, found, keys) of the members, from one text (h1, h2) each."""
    wanted = one.join(member, "s", "left_semi").select("s", "h1", "h2")
    sets = texts.join(wanted, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("s", "text")
    return materialise(_sets(sets, p, keyed), "near-shingles")


def near_links(docs: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """(s, root) of the sets with near copies, but for the least set of each component. ``docs``: (h1, h2, s, n, keys, times);
    ``texts``: (h1, h2, text)."""
    one = materialise(
        docs.groupBy("s").agg(F.min(F.struct("h1", "h2", "n", "keys")).alias("o")).select("s", "o.*"), "near-sets")
    member = _members(one)
    sets = _shingled(one, member, texts, p)

    links = _Links(sets, p)
    for _ in range(p.rounds):
        links.lead(links.rooted(member), 1)
    links.lead(links.rooted(member), p.few)
    large = links.rooted(member).where(F.col("size") > p.few).select("s", "n", "score", "bucket")
    keys = sets.join(large.select("s").distinct(), "s", "left_semi").select("s", F.posexplode("keys").alias("part", "finer"))
    finer = large.join(keys, "s").select("s", "n", "score", F.xxhash64("bucket", "part", "finer").alias("bucket"))
    links.lead(links.rooted(finer), p.few)
    links.join_all(docs, texts, one)
    return links.roots.select(F.col("a").alias("s"), F.col("b").alias("root"))


def copied(docs: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """(id) of the documents marked ``asked`` that have another document's set or one at the similarity. ``docs``: (id, h1, h2,
    s, n, keys, asked), of different texts; ``texts``: (h1, h2, text)."""
    one = docs.groupBy("s").agg(
        F.min(F.struct("h1", "h2", "n", "keys")).alias("o"), (F.max("asked") & (F.count("*") == 1)).alias("open"),
        (F.count("*") > 1).alias("equal"))
    one = materialise(one.select("s", "o.*", "open", "equal"), "near-sets")
    member = _members(one, "open")
    sets = _shingled(one, member, texts, p, keyed=False)

    links = _Settled(sets, one.where("not open"), p)
    for _ in range(p.rounds):
        links.lead(links.rooted(member), 1)
    links.lead(links.rooted(member), p.few)
    links.join_rest(member, p.few)
    done = one.join(links.roots, F.col("s") == F.col("a"), "left_semi").where("open or equal").select("s")
    return docs.where("asked").join(done, "s", "left_semi").select("id")


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", p: NearParams = NearParams()) -> DataFrame:
    """One row of each group that chains of near copies join, with all its columns: the one with the smallest id (NULL
    last), then text hash. Rows equal in id and text are one document, of which one row stays."""
    key = row_key(F.col(doc_id), F.col(text))
    hashes = [c.alias(k) for k, c in key.items()]
    texts = df.select(F.col(doc_id).alias("id"), *hashes, F.col(text).cast("binary").alias("text"))
    docs = materialise(hashed(texts, p, counted=True), "near-hashed")
    first = F.min(F.struct(F.col("id").isNull(), "id", "h2", "h1")).alias("first")
    firsts = docs.groupBy("s").agg(first)
    roots = near_links(docs, texts.select("h1", "h2", "text"), p)
    heads = firsts.join(roots, "s", "left").groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("first").alias("first"))
    heads = heads.select(F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2"))
    rows = boxed(df, **key).join(heads, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return unboxed(rows, df.columns)
