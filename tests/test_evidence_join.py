"""Rows of a pair are not sorted to meet the statistics of their pair."""

from pyspark.sql import functions as F

from raytable.operators import selection
from raytable.runtime import tune


def test_statistics_of_few_pairs_are_broadcast(spark):
    tune(spark)
    df = spark.range(200_000).select((F.col("id") % 2).alias("p"), F.col("id").cast("string").alias("i"), (F.col("id") % 997).cast("double").alias("s"),
                                     *((F.col("id") % m).cast("double").alias(c) for c, m in (("mx", 89), ("my", 97), ("rx", 101), ("ry", 103))))
    out = selection.select_evidence(df, ["p"], "i", "s", ("mx", "my"), ("rx", "ry"), (4, 4), 60)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.p: r["count"] for r in out.filter("selected").groupBy("p").count().collect()} == {0: 60, 1: 60}
