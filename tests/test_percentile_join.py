"""Rows of a hot key are not sorted to meet the brackets of their percentiles."""

from pyspark.sql import functions as F

from raytable.operators import quantiles
from raytable.runtime import tune


def test_brackets_of_few_keys_are_broadcast(spark, monkeypatch):
    tune(spark)
    plans = []
    monkeypatch.setattr(quantiles, "materialize", lambda df, plain=quantiles.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    df = spark.range(200_001).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    got = {r.k: r.m for r in quantiles.pctl(df, ["k"], F.col("v"), {"m": (0.5, "linear")}).collect()}
    assert got == {0: 100_000.0, 1: 100_000.0}
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
