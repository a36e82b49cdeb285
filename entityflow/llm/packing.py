"""Best-fit packing by length patterns.

Texts become token ids; a text longer than a sequence is cut into pieces, any other is one piece. Lengths fall into
bins, rounded up. Patterns are the multisets of up to ``parts`` bins that fill a sequence; how often each is used is
fitted to the histogram by non-negative least squares and rounded down. Pieces are dealt evenly over blocks of bounded
size; each block uses its share of every pattern, and then packs the residual pieces, longest first, each into the
fullest sequence that still holds it (what a pattern left open included), opening a new one only where none does.

The histogram has a fixed number of bins, so the driver sees a few counts and fits once at any size. A block ends with
at most a few open sequences. Edge cases: a NULL text is empty, and an empty text is its end token alone; repeated rows
are packed each; an empty table gives an empty result; other columns are not read. A text is tokenised whole
(``tokens``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import bounded
from entityflow.llm.tokens import Encoder
from entityflow.sources.storage import materialise


@dataclass(frozen=True)
class PackParams:
    capacity: int = 4096
    end_id: int = 1
    bins: int = 64  # of equal width
    parts: int = 3  # pieces of a pattern at most
    block: int = 50_000  # pieces of a block, about


def pieces(df: DataFrame, text: Column, doc_id: Column, vocabulary: str, p: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]) of every text; ``vocabulary`` is a tokenizer file that every
    machine has at that path."""
    named = df.select(doc_id.alias("doc_id"), text.alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of_worker(vocabulary), np.array([p.end_id], "<u4").tobytes()
        for batch in batches:
            for part in bounded(batch):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                flat, starts = encoder.flat(part.column("text"))
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    whole = memoryview(flat[a:b].tobytes() + end)
                    for k, s in enumerate(range(0, len(whole) // 4, p.capacity)):
                        cut = whole[4 * s : 4 * (s + p.capacity)]
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                cols = [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
        # the worker lives on beside later stages
        pa.default_memory_pool().release_unused()

    extra = ", ids array<int>" if with_ids else ""
    return named.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint{extra}")


def patterns(bins: int, parts: int) -> np.ndarray:
    """The multisets of up to ``parts`` bin numbers (1..bins) that add up to ``bins``, one row of counts each."""
    found: list[list[int]] = []

    def extend(left: int, most: int, chosen: list[int]) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < parts:
            for b in range(min(left, most), 0, -1):
                if b * (parts - len(chosen)) < left:
                    break
                extend(left - b, b, [*chosen, b])

    extend(bins, bins, [])
    out = np.zeros((len(found), bins))
    for i, f in enumerate(found):
        np.add.at(out[i], np.array(f) - 1, 1)
    return out


def nonnegative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method: a column enters while it lowers the error, and leaves
    when its coefficient would turn negative."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        used[best] = True
        while True:
            z = np.zeros_like(x)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (z <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            used &= x > 1e-12 * max(1.0, float(x.max()))
            x[~used] = 0
            if not used.any():
                return x
        x = z
    return x


class Shelf:
    """Numbers kept by size, from which the largest or smallest size within limits is taken."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit s is set where there are numbers of size s

    def put(self, size: int, number: int) -> None:
        self.at[size].append(number)
        self.mask |= 1 << size

    def take(self, size: int) -> int:
        number = self.at[size].pop()
        if not self.at[size]:
            self.mask &= ~(1 << size)
        return number

    def largest(self, low: int, high: int) -> int:
        """The largest size from ``low`` to ``high``, or -1."""
        size = (self.mask & ((1 << (high + 1)) - 1)).bit_length() - 1
        return size if size >= low else -1

    def smallest(self, low: int) -> int:
        fits = self.mask >> low
        return low + (fits & -fits).bit_length() - 1 if fits else -1


def best_fit(lengths: np.ndarray, counts: np.ndarray, wanted: np.ndarray, p: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of one block: ``counts[i]`` bins of pattern i, ``wanted[i]`` times. A pattern's
    last piece is the longest one left that fits, so that rounding the lengths up leaves no gap."""
    width = p.capacity // p.bins
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    pieces, rooms, n = Shelf(p.capacity), Shelf(p.capacity), 0
    for i, size in enumerate(lengths.tolist()):
        pieces.put(size, i)

    def place(size: int, k: int, full: int) -> int:
        i = pieces.take(size)
        sequence[i], offset[i] = k, full
        return full + size

    for pattern, times in zip(counts, wanted.tolist()):
        *first, last = [b for b in np.flatnonzero(pattern)[::-1].tolist() for _ in range(int(pattern[b]))]
        for _ in range(times):
            full = 0
            for b in [*first, None]:
                low, high = (last * width + 1, p.capacity - full) if b is None else (b * width + 1, (b + 1) * width)
                size = pieces.largest(low, high)
                if size < 0:
                    break
                full = place(size, n, full)
            if 0 < full < p.capacity:
                rooms.put(p.capacity - full, n)
            n += full > 0
            if size < 0:  # this pattern has run out of pieces
                break
    while (size := pieces.largest(1, p.capacity)) > 0:
        room = rooms.smallest(size)
        if room < 0:
            k, n, room = n, n + 1, p.capacity
        else:
            k = rooms.take(room)
        place(size, k, p.capacity - room)
        if room > size:
            rooms.put(room - size, k)
    return sequence, offset


def pack(cut: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """The rows of ``cut`` (which has ``length`` from 1 to the capacity) with ``sequence_id`` and ``offset``.

    ``cut`` must be stored rows: it is read once for the histogram and once for the packing.
    """
    width = p.capacity // p.bins
    bins = cut.groupBy(F.ceil(F.col("length") / width).cast("int").alias("bin")).count().collect()  # at most p.bins rows
    histogram = np.zeros(p.bins)
    for r in bins:
        histogram[r.bin - 1] = r["count"]
    total = int(histogram.sum())
    known = patterns(p.bins, p.parts)
    fitted = nonnegative_fit(known.T, histogram)
    top = np.argsort(-fitted, kind="stable")[: p.bins]
    top = top[fitted[top] > 0]
    counts, share = known[top], fitted[top] / max(total, 1)
    blocks = max(1, -(-total // p.block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [empty]).combine_chunks()
        lengths = rows.column("length").to_numpy()
        sequence, offset = best_fit(lengths, counts, np.floor(share * len(lengths)).astype(np.int64), p)
        first = TaskContext.get().partitionId() << 32
        done = rows.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
        yield from done.to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = pa.RecordBatch.from_pylist([], to_arrow_schema(cut.schema))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return cut.repartition(blocks).mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def packed(df: DataFrame, text: Column, doc_id: Column, vocabulary: str, p: PackParams = PackParams()) -> DataFrame:
    """Tokenise, cut and pack: one row per piece, without the ids."""
    return pack(materialise(pieces(df, text, doc_id, vocabulary, p), "pieces"), p)


def sequences(df: DataFrame, text: Column, doc_id: Column, vocabulary: str, p: PackParams = PackParams()) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, doc_ids), each piece's ids at its offset. A group is at most
    one sequence's pieces."""
    with_ids = pack(materialise(pieces(df, text, doc_id, vocabulary, p, with_ids=True), "pieces"), p)
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = with_ids.groupBy("sequence_id").agg(rows.alias("r"))
    return grouped.select("sequence_id", F.flatten(F.col("r.ids")).alias("ids"), F.col("r.doc_id").alias("doc_ids"))
