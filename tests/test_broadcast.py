"""Joins of tables whose files are small and whose rows are many."""

from pyspark.sql import functions as F

from raytable.runtime import tune


def test_compressed_and_exploded_rows_do_not_pass_through_the_driver(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 400_000, 1, 2).select("id", (F.col("id") % 7).alias("k")).write.parquet(path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"), spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    tune(spark)
    many = spark.read.parquet(path).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(24)))).select("id", "o")
    joined = spark.read.parquet(path).join(many, "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 10_000_000
