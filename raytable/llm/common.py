"""What the corpus operators share: session settings, word splitting and grouped numpy helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raytable.runtime import ensure_checkpoint_dir

#: Text handed to Python at once; a longer text travels alone.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2048


def prepare(spark: SparkSession) -> None:
    """Settings that bound the memory of Python tasks and cut lineage in the shared folder."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # shuffle files go when the query that wrote them ends, not when the driver happens to collect garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What operators keep between the tasks of a Python worker and can build again.
WORKER_MEMOS: list[dict] = []


def release_memory(keep: dict | None = None) -> None:
    """A reused Python worker gives back what tasks of earlier stages left: memos (but ``keep``), and pages that allocators keep."""
    for memo in WORKER_MEMOS:
        if memo is not keep:
            memo.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def drop_memos() -> None:
    """For functions that run once a batch: ``release_memory`` where an earlier stage left something."""
    if any(WORKER_MEMOS):
        release_memory()


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns every operator reads; other columns, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def once(function, returns: str):
    """Arrow UDF that the optimizer may not copy: a filter on its result must not run it again."""
    return F.arrow_udf(function, returns).asNondeterministic()


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def text_chunks(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, so that numpy arrays over the words of a range stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Numbering(dict):
    """Dense number per distinct value, in order of first sight."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def named(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all rows in one array, the row borders (length rows + 1), and the distinct words in the order of their numbers."""
    number = Numbering()
    borders = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=borders[1:])
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.int64, int(borders[-1]))
    return flat, borders, list(number)


def numbered(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all rows in one array, and the row borders (length rows + 1)."""
    return named(rows)[:2]


def pair_names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Exact dense names of pairs of small non-negative numbers: equal names, equal pairs."""
    if not len(first):
        return np.zeros(0, np.int64)
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1].astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
