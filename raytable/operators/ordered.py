"""Ordered (window-like) operators that hold when one key owns a large share of the rows.

A plain window puts a whole key into one task. Here rows are range-partitioned on
(key, order), each slice is scanned on its own, and only one small row per
(key, slice) carries the running state over slice borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raytable.runtime import materialize

SLICE = "_slice"


def slice_rows(df: DataFrame, by: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """Range-partition on key and order; the slice number is fixed by a checkpoint."""
    keys = [F.col(c) for c in by + order]
    part = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return materialize(part.withColumn(SLICE, F.spark_partition_id()))


def _carry(sliced: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    return sliced.groupBy(*by, SLICE).agg(*(c.alias(n) for n, c in aggs.items()))


def _earlier(by):
    return Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def rank_rows(df: DataFrame, by: list[str], order: list[str], name: str = "rn", total: str | None = None,
              slices: int | None = None) -> DataFrame:
    """Exact 1-based row number per key (and optionally the key's row count). ``order`` must be unique per key."""
    s = slice_rows(df, by, order, slices)
    offs = _carry(s, by, _cnt=F.count(F.lit(1)))
    offs = offs.withColumn("_before", F.coalesce(F.sum("_cnt").over(_earlier(by)), F.lit(0)))
    if total:
        offs = offs.withColumn(total, F.sum("_cnt").over(Window.partitionBy(*by)))
    local = s.withColumn("_within", F.row_number().over(Window.partitionBy(*by, SLICE).orderBy(*order)))
    out = local.join(offs.drop("_cnt"), by + [SLICE]).withColumn(name, F.col("_within") + F.col("_before"))
    return out.drop("_within", "_before", SLICE)


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str,
                total: str | None = None, slices: int | None = None) -> DataFrame:
    """Inclusive running sum per key in ``order``."""
    s = slice_rows(df.withColumn("_v", value), by, order, slices)
    offs = _carry(s, by, _cnt=F.sum("_v"))
    offs = offs.withColumn("_before", F.coalesce(F.sum("_cnt").over(_earlier(by)), F.lit(0)))
    if total:
        offs = offs.withColumn(total, F.sum("_cnt").over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = s.withColumn("_within", F.sum("_v").over(w)).join(offs.drop("_cnt"), by + [SLICE])
    return out.withColumn(name, F.col("_within") + F.col("_before")).drop("_v", "_within", "_before", SLICE)


def _lag_sliced(s: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    last = _carry(s, by, _last=F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)))
    last = last.withColumn("_prev", F.max_by("_last", SLICE).over(_earlier(by))).drop("_last")
    w = Window.partitionBy(*by, SLICE).orderBy(*order)
    out = s.withColumn("_first", F.row_number().over(w) == 1).withColumn("_lag", F.lag(value).over(w))
    return (out.join(last, by + [SLICE])
            .withColumn(name, F.when(F.col("_first"), F.col("_prev.v")).otherwise(F.col("_lag")))
            .drop("_first", "_lag", "_prev"))


def lag_rows(df: DataFrame, by: list[str], order: list[str], value: str, name: str,
             slices: int | None = None) -> DataFrame:
    """Previous row's value per key."""
    return _lag_sliced(slice_rows(df, by, order, slices), by, order, value, name).drop(SLICE)


def gap_sessions(df: DataFrame, by: list[str], value: str, order: list[str], tolerance: float,
                 name: str = "session", slices: int | None = None) -> DataFrame:
    """Session number per key: a new session starts where the gap to the previous value exceeds the tolerance."""
    s = slice_rows(df, by, [value] + order, slices)
    s = _lag_sliced(s, by, [value] + order, value, "_prev_value")
    s = s.withColumn("_new", F.coalesce((F.col(value) - F.col("_prev_value") > tolerance), F.lit(True)).cast("long"))
    offs = _carry(s, by, _cnt=F.sum("_new"))
    offs = offs.withColumn("_before", F.coalesce(F.sum("_cnt").over(_earlier(by)), F.lit(0))).drop("_cnt")
    w = Window.partitionBy(*by, SLICE).orderBy(value, *order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_within", F.sum("_new").over(w)).join(offs, by + [SLICE])
    return s.withColumn(name, F.col("_within") + F.col("_before")).drop("_within", "_before", "_new", "_prev_value", SLICE)


def last_known(df: DataFrame, by: list[str], order: list[str], value: str, name: str, forward: bool = True,
               slices: int | None = None) -> DataFrame:
    """Last (or, backwards, next) non-null value per key: the core of an as-of join."""
    s = slice_rows(df, by, order, slices)
    key = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    carry = _carry(s, by, _c=pick(F.col(value), F.when(F.col(value).isNotNull(), key)))
    span = (Window.partitionBy(*by).orderBy(F.col(SLICE) if forward else F.col(SLICE).desc())
            .rowsBetween(Window.unboundedPreceding, -1))
    carry = carry.withColumn("_carried", F.last("_c", ignorenulls=True).over(span)).drop("_c")
    w = Window.partitionBy(*by, SLICE).orderBy(*order)
    local = (F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if forward
             else F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return (s.withColumn("_within", local).join(carry, by + [SLICE])
            .withColumn(name, F.coalesce("_within", "_carried")).drop("_within", "_carried", SLICE))
