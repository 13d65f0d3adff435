"""Best-fit packing: best-fit decreasing over the whole table, planned on the histogram of piece lengths.

Best fit looks only at lengths, and a capacity of C tokens knows at most C of them. The planner therefore places runs of
equal pieces into runs of equal bins, longest first, with a segment tree over remaining capacities that finds the
tightest open bin in O(log C); its input and output are bounded by C, whatever the number of documents. Every piece then
computes its sequence from its rank among the pieces of its length. The result is the exact global best-fit-decreasing
packing, not one packing per partition.

Defined cases: a null text is an empty one and gives the end id alone; an empty table gives no rows; repeated rows and
equal lengths are placed one by one, ties by partition and place in it; other columns take no part. Documents longer than
the capacity are cut into full pieces, the first takes the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, prepare, release_memory
from .tokens import _workers, encoder

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class OpenBins:
    """Segment tree over remaining capacities 0..C; a leaf is open while bins with that much room exist."""

    def __init__(self, capacity: int):
        self.width = 1 << int(capacity).bit_length()
        self.open = np.zeros(2 * self.width, bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs of bin numbers (first, count)

    def _set(self, room: int, state: bool) -> None:
        node = room + self.width
        self.open[node] = state
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            self.runs[room].append((first, count))
            self._set(room, True)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._set(room, False)
        return run

    def tightest(self, length: int) -> int | None:
        """Smallest open room of at least ``length``."""
        node = length + self.width
        while not self.open[node]:
            while node & 1:  # a right child has no sibling above it
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.width:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.width


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces per bin, offset of the first): best-fit decreasing of the histogram.

    A tightest bin takes equal pieces until none fits, as what is left of it stays the tightest; so a run of bins with
    the same room takes a run of pieces at once.
    """
    bins, rows, next_bin = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = next_bin, -(-left // each)
                next_bin += count
            else:
                (first, count), each = bins.take(room), room // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            if full or rest:
                rows.append((length, rank, first, each, capacity - room))
            bins.add(room - each * length, first, full)
            used = full
            if rest:
                bins.add(room - rest * length, first + full, 1)
                used += 1
            bins.add(room, first + used, count - used)
            rank += full * each + rest
            left -= full * each + rest
    return np.array(rows, np.int64).reshape(-1, 5)


def _cut(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of n ids: full pieces, the first takes the rest."""
    start, piece = 0, 0
    while start < n:
        length = (n % capacity or capacity) if piece == 0 else capacity
        yield piece, start, length
        start, piece = start + length, piece + 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids with their partition and rank among the pieces of their length in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release_memory(keep=_workers)  # the next task of this stage takes the same tokenizer
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids, borders in encoder(tokenizer, True).ids(batch.column(1), END_ID):
                rows: list[tuple] = []
                for k, (low, high) in enumerate(zip(borders, borders[1:]), row):
                    for piece, start, length in _cut(int(high - low), capacity):
                        own = ids[low + start: low + start + length]
                        rows.append((doc_ids[k], piece, start, length, zlib.crc32(own), part, int(seen[length]), *([own] if with_ids else [])))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    return id_text(docs).mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    prepare(spark)
    p = pieces(docs, tokenizer, capacity, with_ids).checkpoint(eager=True)
    counts = p.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    order = np.lexsort((rows[:, 1], -rows[:, 0]))
    rows = rows[order]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = p.join(offsets, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(n)), np.int64)
        for value in np.unique(n):
            own = np.flatnonzero(n == value)
            runs = rows[np.searchsorted(-rows[:, 0], -value, "left"): np.searchsorted(-rows[:, 0], -value, "right")]
            run = runs[np.searchsorted(runs[:, 1], r[own], "right") - 1]
            k = r[own] - run[:, 1]
            out[0, own], out[1, own] = run[:, 2] + k // run[:, 3], run[:, 4] + k % run[:, 3] * value
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["sequence_id", "offset"])

    placed = ranked.withColumn("_at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset", *(["ids"] if with_ids else []))
