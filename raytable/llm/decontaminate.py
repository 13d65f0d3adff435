"""Benchmark decontamination: Wu-Manber multi-pattern search over word numbers.

Patterns are windows of ``WINDOW`` consecutive words of the benchmark items; a shorter item is one pattern. Patterns of one
length form a machine: a shift table over hashed pairs of neighbouring words says how far the scan may jump, a suffix-hash
table selects the patterns that end with a pair, and word-by-word comparison confirms an occurrence. All scan heads of a
batch jump together, one numpy step for all; a long text has many heads.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, each broadcast to one pass over the documents, so what a
task holds is bounded however long the benchmark is; hits of earlier blocks travel with the row.

Defined cases: null, empty and word-less documents have no words and are clean; null or word-less items have no window; items
with the same id count once, a null id is the empty string; repeated documents are judged one by one; an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORKER_MEMOS, once, prepare, text_chunks, utf8

WINDOW = 13
HEAD = 2048  # end positions scanned by one head
BLOCK_WORDS = 2_000_000
HITS = "struct<n_words:long,hit:binary,items:array<string>>"
SHARE = 20  # contaminated: at least one word in SHARE is hit

#: Bytes that separate words become spaces, A-Z become a-z, all others stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Machine:
    """Wu-Manber tables for patterns of one length over word numbers (0: no pattern has the word)."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, (count, self.m) = patterns, patterns.shape
        self.block = min(2, self.m)
        self.bits = max(10, int(count * max(1, self.m - 1)).bit_length() + 2)
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int64)
        for j in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._hash(patterns[:, j - self.block + 1], patterns[:, j]), self.m - 1 - j)
        suffix = self._hash(patterns[:, -self.block], patterns[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = a if self.block == 2 else np.zeros_like(b)
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of every occurrence inside a row."""
        first = borders[:-1] + self.m - 1  # first end position of each row
        heads, ends = _heads(first, borders[1:])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(heads):
            h = self._hash(text[heads - self.block + 1], text[heads])
            jump = self.shift[h]
            stop = np.flatnonzero(jump == 0)
            if len(stop):
                at, low = heads[stop], np.searchsorted(self.suffix, h[stop], "left")
                size = np.searchsorted(self.suffix, h[stop], "right") - low
                at, pick = np.repeat(at, size), np.repeat(low, size) + _within(size)
                which = self.order[pick]
                for k in range(self.m - 1, -1, -1):  # direct comparison, from the end
                    same = text[at - (self.m - 1 - k)] == self.patterns[which, k]
                    at, which = at[same], which[same]
                found.append((at, which))
            heads = heads + np.maximum(jump, 1)
            live = heads < ends
            heads, ends = heads[live], ends[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _heads(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan heads: stretches of at most HEAD end positions of every row."""
    count = np.maximum(0, -(-(end - first) // HEAD))
    start = np.repeat(first, count) + HEAD * _within(count)
    return start, np.minimum(start + HEAD, np.repeat(end, count))


class Searcher:
    """Machines by pattern length for a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.items = [name for name, _ in items]
        for item, (_, text) in enumerate(items):
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            m = min(window, len(own))
            for i in range(len(own) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(own[i:i + m]), set()).add(item)
        self.machines = [(Machine(np.array(list(p), np.int64)), list(p.values())) for p in by_length.values()]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """For each text its number of words, a mask of hit words and the ids of occurring items."""
        get = self.number.get
        rows = [[get(w, 0) for w in words(t)] for t in texts]
        borders = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=borders[1:])
        flat = np.fromiter((n for r in rows for n in r), np.int64, int(borders[-1]))
        cover = np.zeros(len(flat) + 1, np.int64)
        named: dict[int, set[str]] = {}
        for machine, owners in self.machines:
            end, which = machine.find(flat, borders)
            np.add.at(cover, end - machine.m + 1, 1)
            np.add.at(cover, end + 1, -1)
            row = np.searchsorted(borders, end, "right") - 1
            for r, p in set(zip(row.tolist(), which.tolist(), strict=True)):
                named.setdefault(r, set()).update(self.items[i] for i in owners[p])
        hit = np.cumsum(cover[:-1]) > 0
        for r in range(len(rows)):
            yield len(rows[r]), hit[borders[r]:borders[r + 1]], named.get(r, set())


_searchers: dict[int, Searcher] = {}
WORKER_MEMOS.append(_searchers)


def _searcher(block, window: int) -> Searcher:
    """The block's machines, built once per worker."""
    if block.value[0] not in _searchers:
        _searchers.clear()
        _searchers[block.value[0]] = Searcher(block.value[1], window)
    return _searchers[block.value[0]]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of a bounded size, dealt by hash; each block is collected on its own."""
    items = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
             .filter("text is not null").withColumn("size", F.octet_length("text") / 2 + 1))
    total = items.agg(F.sum("size")).first()[0]
    if total is None:
        return
    count = int(total // block_words) + 1
    for k in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r["item"], r["text"].encode()) for r in part.select("item", "text").distinct().collect()]


def _pass(block, window: int):
    """Column function: the hits of one block of items added to those of earlier blocks."""

    def scan(text: pa.Array, hits: pa.Array) -> pa.Array:
        search, texts, before = _searcher(block, window), utf8(text), hits.to_pylist()
        n_words, masks, items = [], [], []
        for a, b in text_chunks(texts):
            for old, (n, hit, names) in zip(before[a:b], search.scan(texts[a:b]), strict=True):
                mask = np.packbits(hit)
                if old and old["hit"] is not None:
                    mask |= np.frombuffer(old["hit"], np.uint8)
                    names |= set(old["items"])
                n_words.append(n)
                masks.append(mask.tobytes())
                items.append(sorted(names))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["n_words", "hit", "items"])

    return once(scan, HITS)


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with struct ``__hits``: n_words, hit (packed mask of hit words), items (ids of occurring items, sorted as strings)."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs.withColumn("__hits", F.lit(None).cast(HITS))
    for k, items in enumerate(list_or_empty(_blocks(benchmark, block_words))):
        if k:  # one pass per block; the machines of one block at a time in memory
            out = out.checkpoint(eager=True)
        block = spark.sparkContext.broadcast((_fingerprint(items), items))

        out = out.withColumn("__hits", _pass(block, window)(F.col("text").cast("string"), "__hits"))
    return out


def list_or_empty(blocks: Iterator[list]) -> Iterator[list]:
    """At least one block, so that words are counted even without a benchmark."""
    any_ = False
    for b in blocks:
        any_ = True
        yield b
    if not any_:
        yield []


def _fingerprint(items: list[tuple[str, bytes]]) -> bytes:
    h = hashlib.sha256()
    for name, text in items:
        h.update(b"%d %d " % (len(name), len(text)) + name.encode() + text)
    return h.digest()


def _counted(hits: pa.Array) -> pa.Array:
    rows = hits.to_pylist()
    return pa.StructArray.from_arrays([
        pa.array([r["n_words"] for r in rows], pa.int64()),
        pa.array([sum(map(int.bit_count, r["hit"])) for r in rows], pa.int64()),
        pa.array([len(r["items"]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in rows], pa.string()),
    ], ["n_words", "n_hit", "n_items", "items_sha256"])


def _counts(hits: str) -> Column:
    return once(_counted, "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string>")(hits)


def contaminated(c: Column) -> Column:
    return (c["n_hit"] > 0) & (SHARE * c["n_hit"] >= c["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, hit words, occurring items and verdict."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    c = searched(slim, benchmark, window, block_words).select("doc_id", _counts("__hits").alias("_c"))
    return c.select("doc_id", "_c.*", contaminated(F.col("_c")).alias("contaminated"))


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    out = searched(docs, benchmark, window).withColumn("__hits", _counts("__hits"))
    return out.filter(~contaminated(F.col("__hits"))).drop("__hits")
