"""Language identification of mixed-language text.

A word's script, found from character ranges, narrows the languages to those that use the script; its letter groups give
each of them a score (the mean log-likelihood of its letter pairs and triples, ends of the word included, hashed to buckets and
counted over all labelled training texts). A Viterbi search over the words of a text, with a penalty for every switch of language, labels
them; runs of equal labels are the spans. The text's language is the one with most letters.

Where no stretch of words favours other languages by as much as one switch costs, one label for all words is the best
path, and the search is skipped: same result, no step per word. The model has a fixed number of buckets for each
language, so its size does not grow with the corpus; counts are added per task and bucket before they are shuffled.

Edge cases: a NULL text and a text without letters have no spans and the language ``und`` with score 0; a word in a
script that no learned language uses says nothing; ties go to the language that sorts first; without any training text
every text is ``und``; repeated rows count and are labelled each; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
# First code points of Unicode blocks, and the script of the letters from there on.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2C00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([c for c, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])
_TEXT = 1 << 19  # characters looked at together


@dataclass(frozen=True)
class LangParams:
    bits: int = 16  # buckets of the model, as a power of 2
    most_languages: int = 256  # more are refused: the model must fit on the driver
    smoothing: float = 0.05
    script_share: float = 0.01  # of a language's letters, for it to be a candidate for the script
    weight: float = 3.0  # of a word's mean log-likelihood
    switch: float = 12.0  # cost of a change of language


@dataclass
class LangModel:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets
    uses: np.ndarray  # scripts x languages, true where the script is a candidate
    params: LangParams = field(default_factory=LangParams)


_KNOWN = 0x33480  # no letters lie beyond


class Letters:
    """Lower-case letter and script of every code point; 0 for what is no letter."""

    def __init__(self, bits: int):
        chars = [chr(i) for i in range(_KNOWN)]
        self.lower = np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in chars], np.uint32)
        self.script = _SCRIPT[np.searchsorted(_FIRST, np.arange(_KNOWN), side="right") - 1]
        self.shift = np.uint32(32 - bits)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each letter: its place, whether a word starts with it, and the buckets of the pair with the letter
        before and the triple with those at both sides (a word's ends count as 0)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        line = np.zeros(len(points) + 2, np.uint32)
        line[1:-1] = self.lower[np.minimum(points, _KNOWN - 1)] * (points < _KNOWN)
        at = np.flatnonzero(line[1:-1])
        before, here, after = line[at], line[at + 1], line[at + 2]
        pair = (before * np.uint32(0x9E3779B1)) ^ (here * np.uint32(0x85EBCA77))
        triple = pair * np.uint32(0x27D4EB2F) ^ (after * np.uint32(0x165667B1)) ^ np.uint32(0x5BD1E995)
        mixed = [((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> self.shift).astype(np.int64) for x in (pair, triple)]
        return at, before == 0, mixed[0], mixed[1]


def windows(text: str) -> Iterator[str]:
    """The text in parts that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _TEXT)
        while end < len(text) and text[end - 1].isalpha() and end - at < 2 * _TEXT:
            end += 1
        yield text[at:end]
        at = end


def fit(training: DataFrame, text: Column, lang: Column, p: LangParams = LangParams()) -> LangModel:
    """Count the letter groups of all training texts whose ``lang`` is not NULL."""
    named = training.select(text.alias("text"), lang.cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        letters, size = Letters(p.bits), 1 << p.bits
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in sorted(set(names)):
                own = sums.setdefault(name, np.zeros(size + len(NAMES), np.int64))
                of_name = np.flatnonzero(names == name)
                for some in np.array_split(of_name, -(-len(of_name) // 256)):
                    joined = "\n".join(batch.column("text").take(pa.array(some)).to_pylist())
                    for part in windows(joined):
                        _, _, pair, triple = letters.read(part)
                        own[:size] += np.bincount(pair, minlength=size) + np.bincount(triple, minlength=size)
                        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
                        points = points[points < _KNOWN]
                        points = points[letters.lower[points] > 0]
                        own[size:] += np.bincount(letters.script[points], minlength=len(NAMES))
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    counts = named.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.limit((p.most_languages + 1) * ((1 << p.bits) + len(NAMES))).toArrow()
    return _model(found, p)


def _model(counts: pa.Table, p: LangParams) -> LangModel:
    languages = sorted(set(counts.column("lang").to_pylist()))
    if len(languages) > p.most_languages:
        raise ValueError(f"over {p.most_languages} languages")
    size = 1 << p.bits
    table = np.zeros((len(languages), size + len(NAMES)))
    row = np.searchsorted(np.array(languages, dtype=object), np.array(counts.column("lang").to_pylist(), dtype=object))
    if len(row):
        table[row, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    n, letters = table[:, :size], table[:, size:]
    log_p = np.log((n + p.smoothing) / (n.sum(axis=1, keepdims=True) + p.smoothing * size)).astype(np.float32)
    uses = letters.T >= p.script_share * np.maximum(letters.sum(axis=1), 1)
    return LangModel(languages, log_p, uses, p)


class Scorer:
    """Scores of words by language."""

    def __init__(self, model: LangModel):
        self.model, self.letters = model, Letters(model.params.bits)
        self.log_p = np.ascontiguousarray(model.log_p)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, letters, scores by language) of each word."""
        m, found, offset = self.model, [], 0
        for part in windows(text):
            at, first, pair, triple = self.letters.read(part)
            start = np.flatnonzero(first)
            if len(start):
                n = np.diff(np.append(start, len(at)))
                mean = np.stack([np.add.reduceat(p[pair] + p[triple], start) for p in self.log_p], axis=1)
                mean *= (m.params.weight / (2 * n))[:, None]
                points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")[at[start]]
                uses = m.uses[self.letters.script[points]]
                scores = np.where(uses, mean, np.where(uses.any(axis=1, keepdims=True), -1e4, 0.0))
                found.append((at[start] + offset, n, scores.astype(np.float32)))
            offset += len(part)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(m.languages)), np.float32))
        return tuple(np.concatenate([f[k] for f in [empty, *found]]) for k in range(3))


def _plain(scores: np.ndarray, doc: np.ndarray, n: int, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """(best single language, whether it is the best path) of each of ``n`` texts; ``doc`` numbers the words' texts."""
    sums = np.stack([np.bincount(doc, scores[:, k], n) for k in range(scores.shape[1])], axis=1)
    best = sums.argmax(axis=1)
    if scores.shape[1] == 1:
        return best, np.ones(n, bool)
    own = best[doc]
    rows = np.arange(len(doc))
    mine = scores[rows, own].astype(np.float64)
    others = scores.copy()
    others[rows, own] = -np.inf
    gain = others.max(axis=1) - mine
    after = np.cumsum(gain)
    before = after - gain
    # lowest point so far within each text: each text starts far below the one before it
    span = float(np.ptp(after)) + float(np.ptp(before)) + float(np.abs(gain).max()) + 1
    lowest = np.minimum.accumulate(before - span * doc) + span * doc
    most = np.full(n, -np.inf)
    np.maximum.at(most, doc, after - lowest)
    return best, most < switch


def viterbi(scores: np.ndarray, start: np.ndarray, length: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word; the texts (``start``, ``length``) advance together, word by word."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    label = np.zeros(len(scores), np.int64)
    back = np.zeros(len(scores), np.int32)
    switched = np.zeros(scores.shape, bool)
    value = np.zeros((len(start), scores.shape[1]))
    longest = int(length.max(initial=0))
    for t in range(longest):
        a = int(np.searchsorted(-length, -t, side="left"))  # texts of more than t words
        at, v = start[:a] + t, value[:a]
        best = v.max(axis=1, keepdims=True)
        back[at] = v.argmax(axis=1)
        move = v < best - switch
        switched[at] = move
        value[:a] = np.where(move, best - switch, v) + scores[at]
    now = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = int(np.searchsorted(-length, -t, side="left"))
        at = start[:a] + t
        label[at] = now[:a]
        now[:a] = np.where(switched[at, now[:a]], back[at], now[:a])
    return label


def label_texts(texts: list[str | None], scorer: Scorer) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of letters, spans) of each text."""
    names, p = scorer.model.languages, scorer.model.params
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    if not names:
        return out
    size = np.array([len(t or "") + 1 for t in texts])
    offset = np.cumsum(size) - size
    place, letters, scores = scorer.words("\n".join([t or "" for t in texts]))
    doc = np.searchsorted(offset, place, side="right") - 1
    length = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(length) - length
    if not len(doc):
        return out
    best, plain = _plain(scores, doc, len(texts), p.switch)
    label = best[doc]
    mixed = np.flatnonzero(~plain & (length > 0))
    if len(mixed):
        words = np.concatenate([np.arange(start[i], start[i] + length[i]) for i in mixed])
        n = length[mixed]
        label[words] = viterbi(scores[words], np.cumsum(n) - n, n, p.switch)
    for i in np.flatnonzero(length):
        own = slice(start[i], start[i] + length[i])
        share = np.bincount(label[own], letters[own], len(names))
        cuts = [0, *(np.flatnonzero(np.diff(label[own])) + 1).tolist()]
        begin = [0, *(int(place[start[i] + c] - offset[i]) for c in cuts[1:])]
        ends = [*begin[1:], int(size[i] - 1)]
        spans = [(a, z, names[label[start[i] + c]]) for a, z, c in zip(begin, ends, cuts)]
        k = int(share.argmax())
        out[i] = (names[k], float(share[k] / share.sum()), spans)
    return out


def identify(df: DataFrame, text: Column, model: LangModel, **keys: Column) -> DataFrame:
    """The key columns, ``lang``, ``score`` (its share of the letters) and ``spans`` (start, end, lang; in characters)."""
    named = df.select(*[c.alias(k) for k, c in keys.items()], text.alias("text"))
    names = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars, first = [], 0, at
                while at < batch.num_rows and chars < _TEXT and len(texts) < 512:
                    texts.append(batch.column("text")[at].as_py())
                    chars += len(texts[-1] or "")
                    at += 1
                done = label_texts(texts, scorer)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in names], pa.array([d[0] for d in done], pa.string()),
                     pa.array([d[1] for d in done], pa.float64()),
                     pa.array([[{"start": s, "end": e, "lang": g} for s, e, g in d[2]] for d in done], span)],
                    [*names, "lang", "score", "spans"])

    out = [*[f"{k} {kinds[k]}" for k in names], "lang string, score double, spans array<struct<start:int,end:int,lang:string>>"]
    return named.mapInArrow(run, ", ".join(out))
