"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling; later copies of repeated runs are deleted.

A document is the sequence of its lines that have a word. Ranks at level k order the runs of 2**k lines that start at each
position; level k + 1 ranks the pairs (rank at i, rank at i + 2**k). Only runs that occur twice keep a rank, so a level is
smaller than the one before, and unique text leaves after level 0. Sorting is done on distinct pairs, not on positions.

A run of L lines, 2**k <= L < 2**(k+1), is named by its two overlapping halves (rank_k at its start, rank_k at its end); equal
names are the suffixes of one interval of the suffix array whose longest common prefix is at least L. In such an interval
the smallest (doc_id, line) is the first copy. A maximal repeated run of at least ``MIN_WORDS`` words is the union of the
shortest windows of that many words that start, and that end, at its lines; every window that is not a first copy is deleted.
A window has at most MIN_WORDS lines, so there are at most log2(MIN_WORDS) + 1 levels whatever the data.

Defined cases: null, empty and word-less texts stay as they are; lines are compared without white space at their ends; lines
without a word are no part of a sequence and stay; overlapping copies inside one document count (all but the first go); rows
that repeat doc_id and text entirely are copies of each other, all but one are emptied if they have MIN_WORDS words; a null
doc_id sorts first; an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, once, prepare, release_memory, utf8

MIN_WORDS = 50
LINES = "d long, t long, i int, a long, b long, up int, down int"
NO_ID = -(1 << 63)


def _key_columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__t", F.xxhash64(F.col("text").cast("string")))


def _worded(text: bytes) -> list[tuple[int, bytes, int]]:
    """(line number, stripped line, words) of the lines that have a word."""
    out = []
    for k, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        if n:
            out.append((k, line.strip(), n))
    return out


def _windows(words: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest window of ``least`` words that starts, and that ends, at each line; 0 where there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + least, "left")
    up = np.where(end <= len(words), end - at, 0)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    down = np.where(start >= 0, at - start + 1, 0)
    return up, down


def _lines(least: int):
    def run(batches):
        release_memory()
        for batch in batches:
            rows: list[tuple] = []
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                lines = _worded(text)
                if not lines:
                    continue
                up, down = _windows([n for _, _, n in lines], least)
                for i, (_, line, _) in enumerate(lines):
                    h = xxhash.xxh3_128_intdigest(line)
                    rows.append((d, t, i, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), int(up[i]), int(down[i])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in LINES.split(", ")])

    return run


def _ranked(positions: DataFrame, a: str, b: str) -> DataFrame:
    """Positions whose (a, b) occurs twice or more, with its ``rank``: in the order of pairs, with gaps between range slices."""
    pairs = positions.groupBy(a, b).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(a, b)
    ranks = pairs.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id())
    return positions.join(ranks, [a, b]).select("d", "t", "i", "rank").checkpoint(eager=True)


def _levels(lines: DataFrame, least: int) -> list[DataFrame]:
    """Ranks of repeated runs of 1, 2, 4, ... lines by position, up to the longest window or until no run repeats."""
    levels = [_ranked(lines, "a", "b")]
    while 1 << len(levels) <= least:
        step = 1 << (len(levels) - 1)
        here = levels[-1]
        after = here.select("d", "t", (F.col("i") - step).alias("i"), F.col("rank").alias("next"))
        longer = here.join(after, ["d", "t", "i"]).withColumnRenamed("rank", "first")
        level = _ranked(longer, "first", "next")
        if not level.take(1):
            break
        levels.append(level)
    return levels


def later_copies(lines: DataFrame, least: int) -> DataFrame:
    """(d, t, i, size): windows of lines that are not the first copy."""
    levels = _levels(lines, least)
    starts = lines.filter("up > 0").select("d", "t", "i", F.col("up").alias("size"))
    ends = lines.filter("down > 0").select("d", "t", (F.col("i") - F.col("down") + 1).alias("i"), F.col("down").alias("size"))
    # all levels at once: a window looks up its halves at the level of its size
    level = sum(((F.col("size") >= 1 << k).cast("int") for k in range(1, len(levels))), F.lit(0))
    windows = starts.unionByName(ends).filter(F.col("size") < 2 << (len(levels) - 1)).withColumn("k", level)
    ranks = reduce(DataFrame.unionByName, [r.withColumn("k", F.lit(k)) for k, r in enumerate(levels)])
    at = ["k", "d", "t", "i"]
    head = windows.join(ranks.withColumnRenamed("rank", "head"), at)
    tails = head.select("k", "d", "t", (F.col("i") + F.col("size") - F.expr("shiftleft(1, k)")).alias("i"), "size", "head", F.col("i").alias("start"))
    named = tails.join(ranks.withColumnRenamed("rank", "tail"), at).select("k", "d", "t", F.col("start").alias("i"), "size", "head", "tail").distinct()
    named = named.checkpoint(eager=True)
    name = ["head", "tail", "size"]  # the size tells the level
    first = named.groupBy(*name).agg(F.min(F.struct("d", "t", "i")).alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    return named.join(first, name).filter(F.struct("d", "t", "i") > F.col("_first")).select("d", "t", "i", "size")


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, spans_ in zip(text.cast(pa.large_binary()).to_pylist(), spans.to_pylist(), strict=True):
        if t is None or spans_ is None:
            out.append(None)
            continue
        lines = t.split(b"\n")
        worded = _worded(t)
        gone = {worded[j][0] for s in spans_ for j in range(s["i"], s["i"] + s["size"])}
        out.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode())
    return pa.array(out, pa.string())


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, and a struct ``__dedup``: spans that went (in lines
    with words), whether the row repeats another entirely, and whether words were there before and none are now."""
    prepare(docs.sparkSession)
    keyed = _key_columns(docs)
    lines = keyed.select("__d", "__t", "text").mapInArrow(_lines(min_words), LINES).checkpoint(eager=True)
    spans = (later_copies(lines, min_words).groupBy("d", "t").agg(F.collect_list(F.struct("i", "size")).alias("__spans"))
             .select(F.col("d").alias("__d"), F.col("t").alias("__t"), "__spans").checkpoint(eager=True))
    # rows equal in id and text share their positions; they have MIN_WORDS words if a window starts at line 0
    twice = (lines.filter("i = 0 and up > 0").groupBy("d", "t").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
             .select(F.col("d").alias("__d"), F.col("t").alias("__t")).checkpoint(eager=True))
    marks = spans.join(twice.withColumn("__twice", F.lit(True)), ["__d", "__t"], "full_outer")
    out = keyed.join(marks, ["__d", "__t"], "left")
    cut = once(_cut, "string")(F.when(F.col("__spans").isNotNull(), F.col("text").cast("string")), F.col("__spans"))
    out = out.withColumn("__new", cut)
    single, again = out.filter("__twice is null").withColumn("__copy", F.lit(1)), out.filter("__twice")
    if twice.take(1):
        number = F.row_number().over(Window.partitionBy("__d", "__t").orderBy(F.lit(1)))
        out = single.unionByName(again.withColumn("__copy", number))
    else:
        out = single
    repeats = F.col("__copy") > 1
    text = F.when(repeats, F.lit("")).when(F.col("__spans").isNull(), F.col("text")).otherwise(F.col("__new"))
    state = F.struct(F.col("__spans").alias("spans"), repeats.alias("repeats"), ((F.col("__spans").isNotNull() | repeats) & ~_has_word(text)).alias("emptied"))
    return out.withColumn("__dedup", state).withColumn("text", text).drop("__d", "__t", "__spans", "__twice", "__new", "__copy")


def _has_word(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: its text without later copies, how many windows went and whether nothing is left."""
    out = cleaned(id_text(docs), min_words)
    return out.select("doc_id", "text", F.coalesce(F.size("__dedup.spans"), F.lit(0)).alias("n_windows"), F.col("__dedup.repeats").alias("repeats"), F.col("__dedup.emptied").alias("emptied"))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies deleted; a document of which nothing is left goes. Columns as they were."""
    return cleaned(docs, min_words).filter("not __dedup.emptied").drop("__dedup").select(*docs.columns)
