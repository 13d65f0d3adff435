"""Exact order statistics with bounded per-task state.

``percentile`` in a group-by keeps every distinct value of a group in one task, which
fails for a key owning a third of a huge table. The exact value is found in two steps
instead: a mergeable sketch brackets the wanted ranks (its rank error is guaranteed),
then only the rows inside the bracket are counted by distinct value. Ranks that fell
outside the bracket would raise, never give a wrong value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raytable.runtime import materialize, stored

KINDS = ("nearest", "linear", "midpoint")


def _position(kind: str, p: float, n: Column) -> Column:
    """1-based fractional rank of probability ``p`` among ``n`` values."""
    if kind == "nearest":
        return F.greatest(F.lit(1.0), F.ceil(F.lit(p) * n).cast("double"))
    if kind == "linear":
        return 1 + (n - 1) * F.lit(p)
    if kind == "midpoint":
        return F.least(n.cast("double"), F.greatest(F.lit(1.0), F.lit(p) * n + 0.5))
    raise ValueError(f"unknown percentile kind {kind!r}; one of {KINDS}")


def pctl(df: DataFrame, by: list[str], value: Column, wanted: dict[str, tuple[float, str]],
         accuracy: int = 20000) -> DataFrame:
    """One row per key with ``_n`` and each wanted percentile: name -> (probability, kind).

    The (small) result is checkpointed, so statistics built on statistics do not replay the scans below.

    ``nearest`` is rank ceil(p n), ``linear`` interpolates on 1+(n-1)p, ``midpoint`` on ranks (k-0.5)/n.
    """
    keyed = df.select(*by, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    probs = sorted({p for p, _ in wanted.values()})
    eps = 2.0 / accuracy
    edges = []
    for p in probs:
        edges += [max(0.0, p - eps), min(1.0, p + eps)]
    sketch = keyed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.percentile_approx("_v", edges, accuracy).alias("_q"))
    # stored with its true size: few keys are sent to all tasks, so rows of a hot key are neither shuffled nor sorted for the join
    sketch = stored(sketch)
    joined = keyed.join(sketch, by) if by else keyed.crossJoin(F.broadcast(sketch))
    out = None
    # Near 0 and 1, and in groups so small that the bracket spans only a few ranks, the bracket reaches the extremes.
    few = F.col("_n") * eps < 6
    brackets = []
    for i, p in enumerate(probs):
        lo = F.col("_lo") if p - eps <= 0 else F.when(few, F.col("_lo")).otherwise(F.col("_q")[2 * i])
        hi = F.col("_hi") if p + eps >= 1 else F.when(few, F.col("_hi")).otherwise(F.col("_q")[2 * i + 1])
        brackets.append((lo, hi))
    tagged = joined.withColumn("_in", F.lit(False))
    for lo, hi in brackets:
        tagged = tagged.withColumn("_in", F.col("_in") | F.col("_v").between(lo, hi))
    # Gap number: how many brackets lie wholly below, so rows outside collapse to one counted row per gap.
    gap = sum((F.when(F.col("_v") > hi, 1).otherwise(0) for _, hi in brackets), F.lit(0))
    counts = (tagged.withColumn("_bv", F.when(F.col("_in"), F.col("_v")))
              .withColumn("_gap", F.when(F.col("_in"), F.lit(-1)).otherwise(gap))
              .groupBy(*by, "_bv", "_gap").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_at"),
                                               F.first("_n").alias("_n")))
    w = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_from", F.col("_upto") - F.col("_c") + 1)
    aggs, finals = [], []
    for name, (p, kind) in wanted.items():
        pos = _position(kind, p, F.col("_n"))
        k0, k1 = F.floor(pos), F.least(F.floor(pos) + 1, F.col("_n"))
        for tag, k in (("0", k0), ("1", k1)):
            hit = (F.col("_from") <= k) & (k <= F.col("_upto"))
            aggs.append(F.max(F.when(hit, F.col("_bv"))).alias(f"_{name}{tag}"))
        frac = pos - F.floor(pos)
        a, b = F.col(f"_{name}0"), F.col(f"_{name}1")
        ok = F.assert_true(a.isNotNull() & (b.isNotNull() | (frac == 0)), "percentile rank left its bracket").isNull()
        exact = F.when(frac == 0, a).otherwise(a + (b - a) * frac)
        finals.append(F.when(ok, exact).alias(name))
    out = ranked.groupBy(*by).agg(F.first("_n").alias("_n"), *aggs)
    return materialize(out.select(*by, "_n", *finals))


def median(df: DataFrame, by: list[str], value: Column, name: str = "median") -> DataFrame:
    return pctl(df, by, value, {name: (0.5, "linear")})


def attach(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Left-join per-key statistics (NULL-safe for a global, single-row statistic)."""
    return df.join(stats, by, "left") if by else df.crossJoin(F.broadcast(stats))


def median_mad(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Per key: _n, median and raw median absolute deviation."""
    base = df.select(*by, value.cast("double").alias("_x"))
    med = median(base, by, F.col("_x"), "median")
    dev = attach(base, med.select(*by, "median"), by)
    mad = median(dev, by, F.abs(F.col("_x") - F.col("median")), "mad").drop("_n")
    return med.join(mad, by, "left") if by else med.crossJoin(F.broadcast(mad))


def residual_stats(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """count, mean, median, rms, mad, nearest-rank p95 and max of |x| over finite values."""
    finite = df.select(*by, value.cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    plain = finite.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"),
                                    F.sqrt(F.avg(F.col("_x") * F.col("_x"))).alias("rms"),
                                    F.max(F.abs("_x")).alias("max_abs"))
    mm = median_mad(finite, by, F.col("_x")).drop("_n")
    p95 = pctl(finite, by, F.abs("_x"), {"p95_abs": (0.95, "nearest")}).drop("_n")
    return plain.join(mm, by).join(p95, by) if by else plain.crossJoin(F.broadcast(mm)).crossJoin(F.broadcast(p95))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, name: str = "weighted_median") -> DataFrame:
    """First value whose cumulative weight reaches half of the total; equal values are merged before the scan."""
    from .ordered import running_sum

    merged = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    run = running_sum(merged, by, [value], F.col("_w"), "_cum", total="_total")
    return run.filter(F.col("_cum") >= F.col("_total") / 2).groupBy(*by).agg(F.min(value).alias(name))
