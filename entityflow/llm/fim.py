"""Fill-in-middle order of texts, cut by a learned rank index.

A text is cut into runs of ASCII letters and single other characters. The index of a text maps the rank of a boundary (0
to the number of tokens) to its byte offset: straight segments are fitted so that no boundary is further from its segment
than ``error``, and the remaining differences are kept in a byte each. A cut is the segment's prediction at its rank plus
the stored difference, which is exact. Segments are grown from their first boundary while the slopes that keep every
boundary within the error still meet, over windows of boundaries at a time.

The form and the two cuts follow from hashes of a seed, so that reruns agree. A text that is empty or contains a marker
stays plain, so every marker stands once in any other output and ``restored`` is exact.

Edge cases: a NULL text is empty; a NULL seed is the empty one; repeated rows give the same result each; an empty table
gives an empty result; only the given columns are read, and key columns may not be named like a result. Memory is bounded
by a few times the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import bounded

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class FimParams:
    moved: int = 90  # of 100 texts that are taken apart
    suffix_first: int = 20  # of 100 such texts that put the suffix first
    error: int = 126  # bytes between a boundary and its segment; a difference is one byte
    window: int = 4096  # boundaries looked at in one step of fitting


@dataclass
class RankIndex:
    """Segments (first rank, offset there, bytes a rank) and one small difference per boundary."""

    first: np.ndarray
    at: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @staticmethod
    def fit(offsets: np.ndarray, error: int = 126, window: int = 4096) -> RankIndex:
        """The index of ascending ``offsets``; ``error`` is at most 126."""
        first, slopes = [], []
        i, n = 0, len(offsets)
        while i < n:
            low, high, j, slope = -np.inf, np.inf, i + 1, 0.0
            while j < n:
                stop = min(n, j + window)
                run = np.arange(j - i, stop - i)
                rise = offsets[j:stop] - offsets[i]
                least = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                most = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                bad = least > most
                k = int(bad.argmax()) if bad.any() else stop - j
                if k:
                    low, high = least[k - 1], most[k - 1]
                    slope = (low + high) / 2
                j += k
                if j < stop:
                    break
            first.append(i)
            slopes.append(slope)
            i = j
        index = RankIndex(np.array(first, np.int64), offsets[first].astype(np.int64), np.array(slopes), np.zeros(0, np.int8))
        index.residual = (offsets - index.predict(np.arange(n))).astype(np.int8)
        return index

    def predict(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, side="right") - 1
        return self.at[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def cut(self, rank: np.ndarray) -> np.ndarray:
        """The exact offsets of boundaries."""
        return self.predict(rank) + self.residual[rank]


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each text starts (with the end as the last), and where each token starts."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    letter = (data | 0x20) - np.uint8(ord("a")) < 26
    opens = (data & 0xC0) != 0x80
    opens[1:] &= ~(letter[1:] & letter[:-1])
    opens[ends[:-1][np.diff(ends) > 0]] = True
    return data, ends, np.flatnonzero(opens)


def _indexed(texts: pa.Array, p: FimParams) -> Iterator[tuple[memoryview, np.ndarray, RankIndex]]:
    """Bytes, boundary offsets and index of each text."""
    data, ends, starts = boundaries(texts)
    whole, at = memoryview(data), np.searchsorted(starts, ends)
    for i in range(len(texts)):
        lo, hi = int(ends[i]), int(ends[i + 1])
        offsets = np.append(starts[at[i] : at[i + 1]] - lo, hi - lo)
        yield whole[lo:hi], offsets, RankIndex.fit(offsets, p.error, p.window)


def rank_index(df: DataFrame, text: Column, p: FimParams = FimParams(), **keys: Column) -> DataFrame:
    """The key columns and the index of each text as it can be stored: ``n`` tokens, ``first``, ``at``, ``slope`` of the
    segments, ``residual`` (a signed byte per boundary). ``cut_at`` reads it."""

    def row(raw: memoryview, offsets: np.ndarray, index: RankIndex, seed: None) -> tuple:
        return len(offsets) - 1, index.first, index.at, index.slope, index.residual.tobytes()

    kinds = {"n": pa.int64(), "first": pa.list_(pa.int64()), "at": pa.list_(pa.int64()), "slope": pa.list_(pa.float64()), "residual": pa.binary()}
    return _mapped(df, text, F.lit(None).cast("string"), keys, p, row, kinds,
                   "n bigint, first array<bigint>, at array<bigint>, slope array<double>, residual binary")


def cut_at(first: Column, at: Column, slope: Column, residual: Column, rank: Column) -> Column:
    """The byte offset of boundary ``rank``, from the columns of a stored index."""
    s = F.array_size(F.filter(first, lambda f: f <= rank))
    step = (rank - F.element_at(first, s)).cast("double")
    byte = F.conv(F.hex(F.substring(residual, rank.cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    signed = F.when(byte > 127, byte - 256).otherwise(byte)
    return F.element_at(at, s) + F.rint(F.element_at(slope, s) * step).cast("bigint") + signed


def fill_in_middle(df: DataFrame, text: Column, seed: Column, p: FimParams = FimParams(), **keys: Column) -> DataFrame:
    """The key columns, ``n`` tokens, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (NULL where plain)
    and ``output``."""
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def row(raw: memoryview, offsets: np.ndarray, index: RankIndex, seed: str | None) -> tuple:
        n, own = len(offsets) - 1, bytes(raw)
        digest = sha256((seed or "").encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        if not own or any(m in own for m in markers) or h3 % 100 >= p.moved:
            return n, "plain", None, None, own
        a, b = index.cut(np.sort(np.array([h1 % (n + 1), h2 % (n + 1)]))).tolist()
        prefix, middle, suffix = own[:a], own[a:b], own[b:]
        if h4 % 100 < p.suffix_first:
            form, parts = "spm", (markers[1], suffix, markers[0], prefix, markers[2], middle)
        else:
            form, parts = "psm", (markers[0], prefix, markers[1], suffix, markers[2], middle)
        return n, form, len(prefix.decode()), len(middle.decode()), b"".join(parts)

    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    return _mapped(df, text, seed, keys, p, row, kinds, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _mapped(df, text, seed, keys, p, row, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``row(bytes, offsets, index, seed)`` of every text beside its key columns."""
    names = [f"key{i}" for i in range(len(keys))]
    named = df.select(*[c.alias(k) for k, c in zip(names, keys.values())], seed.alias("seed"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                done = [row(*t, s) for t, s in zip(_indexed(part.column("text"), p), part.column("seed").to_pylist())]
                cols = [pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], *cols], [*names, *kinds])

    own = [f"{k} {named.schema[k].dataType.simpleString()}" for k in names]
    return named.mapInArrow(run, ", ".join([*own, schema])).withColumnsRenamed(dict(zip(names, keys)))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(
        form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
