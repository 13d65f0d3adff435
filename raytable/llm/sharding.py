"""Sharding: a Feistel permutation with cycle walking over global row numbers; shard and slot are computed from it.

Law ``rows``: row number r goes to place f(r), shard f(r) mod n, slot f(r) div n, so shard sizes differ by one at most and
slots have no gaps. The permutation depends on the key and on the number of rows alone. Everything is built from DataFrame
functions; texts are read once for size and checksum and never shuffled.

Rows are numbered by (doc_id, checksum, size), nulls first, so a run repeats itself; rows equal in all three are
interchangeable. Defined cases: a null text has size 8 and checksum 0; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, prepare

ROUNDS = 6
KEY = 20240917
SHARDS = 24


def _round(half: Column, key: int, n: int, size: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), F.lit(n), half), F.lit(size))


def feistel(x: Column, left: int | Column, right: int | Column, key: int) -> Column:
    """Keyed permutation of 0 .. left*right-1: halves (x div right, x mod right) take turns."""
    a, b = F.call_function("div", x, F.lit(right)), x % right
    for n in range(0, ROUNDS, 2):
        a = (a + _round(b, key, n, left)) % left
        b = (b + _round(a, key, n + 1, right)) % right
    return a * right + b


def permuted(rows: DataFrame, number: str, total: int, key: int, name: str) -> DataFrame:
    """Permutation of 0 .. total-1 as column ``name``.

    The domain is the smallest rectangle that holds total, so fewer than sqrt(total) + 1 places lie beyond it. Their walks back
    are resolved once as a table; only rows that land there look up their end.
    """
    spark = rows.sparkSession
    left = math.isqrt(max(0, total - 1)) + 1
    right = -(-total // left) if total else 1
    out = rows.withColumn(name, feistel(F.col(number), left, right, key))
    if left * right <= total or not total:
        return out
    beyond = spark.range(total, left * right).select(F.col("id").alias("_from"), F.lit(total).alias("_total"), F.lit(left).alias("_left"), F.lit(right).alias("_right"))
    walk = walked(beyond, key).select("_from", "_to")
    return out.join(walk, F.col(name) == F.col("_from"), "left").withColumn(name, F.coalesce("_to", name)).drop("_from", "_to")


def walked(beyond: DataFrame, key: int) -> DataFrame:
    """Places ``_from`` beyond their range 0 .. _total-1 with the place ``_to`` inside where their walk ends.

    A cycle that lies wholly beyond the range comes back to its start; no row leads to it, so its places are dropped. Every other
    walk meets a place inside before that, hence the loop ends.
    """
    step = feistel(F.col("_to"), F.col("_left"), F.col("_right"), key)
    walk = beyond.withColumn("_to", F.col("_from"))
    while True:
        walk = walk.withColumn("_to", F.when(F.col("_to") >= F.col("_total"), step).otherwise(F.col("_to"))).filter("_to <> _from").checkpoint(eager=True)
        if not walk.filter("_to >= _total").take(1):
            return walk


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Global row number from 0 in ``order``: range slices are counted, then numbered side by side."""
    s = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True)
    sizes = s.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))  # one row per slice
    before = sizes.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return s.withColumn("_within", within).join(before, "_slice").withColumn(name, F.col("_within") - 1 + F.col("_before")).drop("_slice", "_within", "_before")


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = id_text(docs).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(slim, ["doc_id", "text_crc32", "size"], "_row").checkpoint(eager=True)
    placed = permuted(rows, "_row", rows.count(), key, "_place")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"),
                         F.expr(f"_place div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
