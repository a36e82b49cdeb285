"""Line deduplication by a log-template tree.

A line's tokens are its space-separated words, those with a digit masked as ``<*>``. The tree has a fixed depth: a line
goes to the leaf of its token count and its leading tokens. In a leaf that recurs in ``min_docs`` different texts, a
token is constant where at least ``min_docs`` texts have it at that position, else it is a variable field and becomes
``<*>``; the line's template is what is left. A template recurs if at least ``min_docs`` different texts have it and at
least ``constant`` of its tokens are constant, and as many of those that follow the leading ones and are not masked, so
that a common opening alone takes no line. Lines of recurring templates are dropped. Lines of ``long_words`` and more
recur from ``long_docs`` texts on, in all three places.

Texts that are equal count once. A text of whose words over ``most`` would go stays whole, for a near-duplicate stage to
judge, if it is a near copy of another text by that stage's own measure (``near``: five-word shingles, similarity 0.8). Else
it carries boilerplate and loses it like any other, however much of it that is. Only texts of which more than half of
``most`` recurs are compared, as a copy of a text that recurs by ``most`` does too.

The recurring leaves, their distinct lines, and later those of recurring templates, are counted. Up to ``most_sent`` of them
go to every task as hashes, so that neither texts nor all lines are shuffled; beyond that, lines are joined with them and
texts with their lines by document. Both ways give the same rows.

Only lines of recurring leaves are looked at token by token, equal lines once; counts are partial aggregates, so a line
in a third of all texts is one row per task. Edge cases: a NULL or empty text stays as it is; a line without a word is
never dropped; repeated rows are treated alike; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm import near
from entityflow.llm.common import SPACES, bounded, boxed, row_key
from entityflow.sources.storage import materialise

_DIGIT = re.compile(rb"[0-9]")


@dataclass(frozen=True)
class TemplateParams:
    depth: int = 3  # leading tokens of the tree
    min_docs: int = 5  # different texts that make a leaf, a token or a template recur
    long_words: int = 50  # from so many words on, a line is long
    long_docs: int = 2  # the same for the leaves, tokens and templates of long lines
    constant: float = 0.5  # share of a template's tokens that must be constant
    most: float = 0.5  # share of a text's words that goes without asking whether the text is a copy
    copy: near.NearParams = near.NearParams()  # what makes a text a near copy
    most_sent: int = 1 << 20  # distinct lines (16 bytes each at most) that are sent to every task; more are joined


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line (split at the six ASCII spaces), with variable-looking ones masked."""
    tokens = line.split()
    return [b"<*>" if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def leaf_of(tokens: list[bytes], depth: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join([b"%d" % len(tokens), *tokens[:depth]]), 1)


def line_keys(texts: list[str | None], depth: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, line number, words, body and, with a depth, leaf) of each line with a word; leaf and body are 64-bit hashes."""
    from xxhash import xxh64_intdigest

    of, at, words, bodies, leaves = [], [], [], [], []
    for k, text in enumerate(texts):
        for i, line in enumerate((text or "").encode().split(b"\n")):
            tokens = masked(line)
            if tokens:
                of.append(k)
                at.append(i)
                words.append(len(tokens))
                bodies.append(xxh64_intdigest(b" ".join(tokens), 2))
                if depth is not None:
                    leaves.append(leaf_of(tokens, depth))
    hashes = [np.array(x, np.uint64).view(np.int64) for x in (bodies, *([] if depth is None else [leaves]))]
    return np.array(of, np.int64), np.array(at, np.int32), np.array(words, np.int32), *hashes


def parse(df: DataFrame, text: str, doc_id: str, depth: int) -> DataFrame:
    """(h1, h2, content, line, words, leaf, body) per line with a word."""
    key = row_key(F.col(doc_id), F.col(text))
    named = df.select(*[c.alias(k) for k, c in key.items()], F.xxhash64(text).alias("content"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                row, line, words, body, leaf = line_keys(part.column("text").to_pylist(), depth)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(pa.array(row)) for c in ("h1", "h2", "content")],
                     pa.array(line), pa.array(words), pa.array(leaf), pa.array(body)],
                    ["h1", "h2", "content", "line", "words", "leaf", "body"],
                )

    return named.mapInArrow(run, "h1 bigint, h2 bigint, content bigint, line int, words int, leaf bigint, body bigint")


def few(bodies: DataFrame, most: int, column: str = "body") -> np.ndarray | None:
    """A column of longs of a written table as a sorted array for the tasks; None if it has over ``most`` rows."""
    if bodies.count() > most:
        return None
    return np.unique(bodies.select(column).toArrow().column(column).to_numpy())


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` the sorted array ``known`` holds."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def held(known: np.ndarray):
    """A function of a column of longs: whether the sorted array ``known`` holds them."""

    @F.arrow_udf("boolean")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(among(values.to_numpy(zero_copy_only=False), known))

    return run


def looked_up(known: np.ndarray, value: np.ndarray):
    """A function of a column of longs: the value of each that the sorted array ``known`` holds, else NULL."""

    @F.arrow_udf("bigint")
    def run(values: pa.Array) -> pa.Array:
        values = values.to_numpy(zero_copy_only=False)
        hit = among(values, known)
        found = np.zeros(len(values), np.int64)
        found[hit] = value[np.searchsorted(known, values[hit])]
        return pa.array(found, mask=~hit)

    return run


def seen_lines(df: DataFrame, text: str, known: np.ndarray, depth: int) -> DataFrame:
    """(leaf, body, shape): the masked line of each known body; each task gives each body once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = known
        for batch in batches:
            for part in bounded(batch):
                if not len(missing):
                    continue
                texts = part.column("text").to_pylist()
                of, line, _, body = line_keys(texts)
                hit = np.flatnonzero(among(body, missing))
                hit = hit[np.unique(body[hit], return_index=True)[1]]
                split = {i: texts[i].split("\n") for i in set(of[hit].tolist())}
                found = [masked(split[i][j].encode()) for i, j in zip(of[hit].tolist(), line[hit].tolist())]
                leaf = np.array([leaf_of(x, depth) for x in found], np.uint64).view(np.int64)
                missing = missing[~among(missing, body[hit])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(body[hit]), pa.array([b" ".join(x).decode() for x in found], pa.string())],
                    ["leaf", "body", "shape"])

    lines = df.select(F.col(text).alias("text")).mapInArrow(run, "leaf bigint, body bigint, shape string")
    return lines.dropDuplicates(["leaf", "body"]).withColumn("tokens", F.split("shape", " ")).drop("shape")


def joined_lines(df: DataFrame, text: str, doc_id: str, lines: DataFrame, bodies: DataFrame) -> DataFrame:
    """(leaf, body, tokens) of each body, from one of the texts that hold it."""
    some = lines.join(bodies.select("leaf", "body"), ["leaf", "body"]).groupBy("leaf", "body").agg(
        F.min(F.struct("h1", "h2", "line")).alias("at"))
    wanted = some.select("leaf", "body", "at.*").groupBy("h1", "h2").agg(F.collect_list(F.struct("leaf", "body", "line")).alias("at"))
    key = row_key(F.col(doc_id), F.col(text))
    texts = df.select(*[c.alias(k) for k, c in key.items()], F.col(text).alias("text"))
    examples = (
        texts.join(wanted, ["h1", "h2"]).select(F.split("text", "\n").alias("all"), F.explode("at").alias("a"))
        .select("a.leaf", "a.body", F.get("all", F.col("a.line")).alias("text"))
        .dropDuplicates(["leaf", "body"])
    )
    tokens = F.transform(F.array_remove(F.split("text", SPACES), ""), lambda t: F.when(F.rlike(t, F.lit("[0-9]")), F.lit("<*>")).otherwise(t))
    return examples.select("leaf", "body", tokens.alias("tokens"))


def needed(words: Column, p: TemplateParams) -> Column:
    """How many different texts make a line of so many words recur."""
    return F.when(words >= p.long_words, min(p.long_docs, p.min_docs)).otherwise(p.min_docs)


def templates(df: DataFrame, lines: DataFrame, text: str, doc_id: str, p: TemplateParams) -> DataFrame:
    """(leaf, body, template, docs): the distinct masked lines whose template recurs."""
    leaves = (
        lines.groupBy("leaf").agg(F.countDistinct("content").alias("n"), F.min("words").alias("words"))
        .where(F.col("n") >= needed(F.col("words"), p)).select("leaf")
    )
    leaves = materialise(leaves, "line-leaves")
    sent = few(leaves, p.most_sent, "leaf")
    within = lines.join(leaves, "leaf", "left_semi") if sent is None else lines.where(held(sent)(F.col("leaf")))
    bodies = materialise(within.groupBy("leaf", "body").agg(F.countDistinct("content").alias("docs")), "line-bodies")
    known = few(bodies, p.most_sent)
    examples = joined_lines(df, text, doc_id, lines, bodies) if known is None else seen_lines(df, text, known, p.depth)
    examples = bodies.join(examples, ["leaf", "body"])
    examples = materialise(examples, "line-examples")
    each = examples.select("leaf", "body", "docs", F.size("tokens").alias("words"), F.posexplode("tokens").alias("pos", "token"))
    support = (
        each.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n"), F.min("words").alias("words"))
        .where(F.col("n") >= needed(F.col("words"), p)).select("leaf", "pos", "token")
    )
    fixed = (
        each.where((F.col("pos") >= p.depth) & (F.col("token") != "<*>"))
        .join(support, ["leaf", "pos", "token"], "left_semi")
        .groupBy("leaf", "body").agg(F.collect_set("pos").alias("fixed"))
    )
    general = F.transform("tokens", lambda t, i: F.when((i < p.depth) | F.array_contains("fixed", i), t).otherwise("<*>"))
    # constant tokens: those of the tree's prefix, and the fixed ones behind it, that are not masked
    plain, leading = F.size(F.array_remove("tokens", "<*>")), F.size(F.array_remove(F.slice("tokens", 1, p.depth), "<*>"))
    shaped = (
        examples.join(fixed, ["leaf", "body"], "left").withColumn("fixed", F.coalesce("fixed", F.array().cast("array<int>")))
        .where(leading + F.size("fixed") >= p.constant * F.size("tokens"))
        # what follows the tree's prefix counts for itself: masked tokens say nothing there, the others must be constant
        .where(F.size("fixed") >= p.constant * (plain - leading))
        .select("leaf", "body", general.alias("shape"))
        .select("leaf", "body", F.concat_ws(" ", "shape").alias("template"))
        .withColumn("kind", F.xxhash64("leaf", "template"))
    )
    shaped = materialise(shaped, "line-shapes")
    # a template's texts are counted from the lines again: two of its lines may stand in one text
    if known is None:
        of = lines.join(shaped.select("leaf", "body", "kind"), ["leaf", "body"])
    else:
        kinds = shaped.select("body", "kind").toArrow().sort_by("body")
        kind = looked_up(*[kinds.column(c).to_numpy() for c in ("body", "kind")])
        of = lines.select("content", "words", kind(F.col("body")).alias("kind")).where("kind is not null")
    counted = (
        of.groupBy("kind").agg(F.countDistinct("content").alias("docs"), F.min("words").alias("words"))
        .where(F.col("docs") >= needed(F.col("words"), p)).drop("words")
    )
    return shaped.join(counted, "kind").drop("kind")


def copies(
    df: DataFrame, lines: DataFrame, recurring: DataFrame, known: np.ndarray | None, text: str, doc_id: str, p: TemplateParams
) -> DataFrame:
    """(content): the texts that would lose over ``most`` of their words but are near copies of others. ``known``: the bodies
    of ``recurring``, if they are few."""
    # repeated rows give each line several times, in both sums
    if known is None:
        hit = lines.join(recurring.select("leaf", "body", F.lit(True).alias("hit")), ["leaf", "body"], "left")
    else:
        hit = lines.select("content", "words", held(known)(F.col("body")).alias("hit"))
    shares = hit.groupBy("content").agg((F.sum(F.when(F.col("hit"), F.col("words"))) / F.sum("words")).alias("share"))
    some = materialise(shares.where(F.col("share") > p.most / 2), "line-mostly")
    asked = (F.col("share") > p.most).alias("asked")
    if some.where(asked).isEmpty():
        return some.select("content").limit(0)
    key = row_key(F.col(doc_id), F.col(text))
    texts = df.select(F.xxhash64(text).alias("id"), *[c.alias(k) for k, c in key.items()], F.col(text).cast("binary").alias("text"))
    sent = few(some, p.most_sent, "content")
    mostly = some.select(F.col("content").alias("id"))
    texts = texts.join(mostly, "id", "left_semi") if sent is None else texts.where(held(sent)(F.col("id")))
    texts = materialise(texts.dropDuplicates(["id"]), "line-texts")
    docs = near.hashed(texts, p.copy).join(some.select(F.col("content").alias("id"), asked), "id")
    docs = materialise(docs, "line-sets")
    return near.copied(docs, texts.select("h1", "h2", "text"), p.copy).select(F.col("id").alias("content"))


def dropped_lines(lines: DataFrame, known: DataFrame, whole: DataFrame) -> DataFrame:
    """(h1, h2, gone): per document that loses lines, their numbers and how many words they have. ``whole``: the content of
    the texts that lose none."""
    # repeated rows give each line several times
    per_doc = (
        lines.join(known, ["leaf", "body"], "left_semi").join(whole, "content", "left_anti").groupBy("h1", "h2")
        .agg(F.sum("words").alias("words"), F.collect_set("line").alias("lines"), F.countDistinct("line").alias("n"), F.count("*").alias("all"))
    )
    once = F.col("words") * F.col("n") / F.col("all")
    return per_doc.select("h1", "h2", F.struct("lines", once.cast("long").alias("words")).alias("gone"))


def drops(known: np.ndarray, whole: np.ndarray):
    """A function of a text and its content hash: the numbers and words of the lines it loses, or NULL."""

    @F.arrow_udf("struct<lines:array<int>,words:bigint>")
    def run(texts: pa.Array, content: pa.Array) -> pa.Array:
        stays = among(content.to_numpy(zero_copy_only=False), whole)
        of, line, words, body = line_keys([None if s else t for t, s in zip(texts.to_pylist(), stays.tolist())])
        hit = among(body, known)
        of, line, words = of[hit], line[hit], words[hit]
        ends = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        out = [{"lines": line[a:b], "words": int(words[a:b].sum())} if a < b else None for a, b in zip(ends, ends[1:])]
        return pa.array(out, pa.struct([("lines", pa.list_(pa.int32())), ("words", pa.int64())]))

    return run


def drop_recurring(df: DataFrame, text: str = "text", doc_id: str = "doc_id", p: TemplateParams = TemplateParams()) -> DataFrame:
    """All rows of ``df`` with the lines of recurring templates taken out of their texts, and ``n_dropped_lines`` (int)
    and ``n_dropped_words`` (long)."""
    lines = materialise(parse(df, text, doc_id, p.depth), "lines")
    recurring = materialise(templates(df, lines, text, doc_id, p).select("leaf", "body", "template"), "line-known")
    known = few(recurring, p.most_sent)
    whole = materialise(copies(df, lines, recurring, known, text, doc_id, p), "line-copies")
    kept_whole = few(whole, p.most_sent, "content")
    if known is None or kept_whole is None:
        rows = boxed(df, **row_key(F.col(doc_id), F.col(text))).join(dropped_lines(lines, recurring, whole), ["h1", "h2"], "left")
    else:
        rows = boxed(df, gone=drops(known, kept_whole)(F.col(text), F.xxhash64(text)))
    body = F.col("row").getField(text)
    kept = F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains("gone.lines", i))
    changed = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        *[(changed if c == text else F.col("row").getField(c)).alias(c) for c in df.columns],
        F.coalesce(F.size("gone.lines"), F.lit(0)).alias("n_dropped_lines"),
        F.coalesce("gone.words", F.lit(0).cast("long")).alias("n_dropped_words"),
    )
