"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else one beside the warehouse.

    A machine-local folder is only taken on a local master (as in tests); on a cluster it is refused.
    """
    conf = spark.sparkContext.getConf()
    configured = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local["):
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse.rstrip("/") + "/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session, setting it where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor never replays a loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again.

    Like a checkpoint it cuts lineage, but the planner sees the true size: a checkpoint keeps the estimate of its plan, and a loop
    that joins its state with something made from it would square that estimate every round.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW = 1 << 18  # rows of a table that is sent to all tasks


def few(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df``, marked as one for all tasks if ``rows`` are few: what it is joined with is then not shuffled."""
    return F.broadcast(df) if rows.count() <= FEW else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


BUCKETS = 1 << 18  # of keys, counted first: only keys of buckets with too many rows are counted one by one


def large_keys(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Keys with more rows than ``limit``."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).alias("_bucket")
    full = stored(df.select(bucket).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("_bucket"))
    if is_empty(full):
        return df.select(*by).limit(0)
    keys = df.select(*by, bucket).join(few(full, full), "_bucket", "left_semi")
    return stored(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*by))


def tune(spark: SparkSession) -> None:
    """Session settings the operators count on: AQE, skew-join splitting even before a grouped step, broadcasts by measured size."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # a table is sent to all tasks only if its rows, once made, are few: files are compressed and exploded rows are not in an
    # estimate, so millions of rows would pass through the driver for a few megabytes of Parquet
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    # shuffle files go when the query that wrote them ends: in loops they would pile up until the driver happens to collect garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # small id sets per key stay in the hash map; the default falls back to sorting after 128 keys
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "50000")
