"""Record tables: strict conforming reads, quarantine, and pair records from match results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raytable.functions.scalars import content_id, quantized_obs_id
from raytable.operators.selection import decimate
from raytable.schemas import REQUIRED


def conform(df: DataFrame, schema: dict, key: str | None = None) -> DataFrame:
    """Cast to the schema, fill defaults, refuse unknown columns; ids must be non-empty and unique (checked in the plan)."""
    unknown = [c for c in df.columns if c not in schema]
    if unknown:
        raise ValueError(f"unexpected columns: {', '.join(unknown)}")
    missing = [n for n, (_, d) in schema.items() if d is REQUIRED and n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cols = []
    for name, (kind, default) in schema.items():
        fill = F.lit(None if default is REQUIRED else default).cast(kind)
        cols.append((F.coalesce(F.col(name).cast(kind), fill) if name in df.columns else fill).alias(name))
    out = df.select(*cols)
    if key is None:
        return out
    out = out.filter(F.assert_true(F.coalesce(F.length(key) > 0, F.lit(False)), "empty id").isNull())
    repeated = out.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    clash = out.join(repeated.withColumn("_dup", F.lit(True)), key, "left")
    return clash.filter(F.assert_true(F.col("_dup").isNull(), "an id occurs more than once").isNull()).drop("_dup")


def read_table(spark: SparkSession, path: str, schema: dict, key: str | None = None, fmt: str = "parquet") -> DataFrame:
    return conform(spark.read.format(fmt).load(path), schema, key)


def split_valid(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid rows with the first failing rule's reason. A rule that is NULL fails."""
    reason = F.lit("")
    for name, ok in reversed(rules):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    tagged = df.withColumn("reason", reason)
    return tagged.filter("reason = ''").drop("reason"), tagged.filter("reason <> ''")


def records_from_matches(matches: DataFrame, budget: int, order: list[str], tolerance: float = 0.25) -> DataFrame:
    """Pair records of valid, finite matches, evenly thinned to a budget per pair, with hashed ids and default weights.

    matches: pair_id, view_a, view_b, row_a … col_b, state, score, confidence, matcher.
    """
    ok = F.col("state") == "valid"
    for c in ("row_a", "col_a", "row_b", "col_b"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    live = matches.filter(ok)
    kept = decimate(live, ["pair_id"], order, budget)
    confidence = F.coalesce(F.nanvl(F.col("confidence"), F.lit(None).cast("double")), F.lit(0.5))
    return kept.select(
        content_id("dense-record-", pair=F.col("pair_id"), rows=F.array("row_a", "row_b"), cols=F.array("col_a", "col_b"), matcher=F.col("matcher"),
                   key=F.concat_ws("/", *order)).alias("record_id"),
        "pair_id", "view_a", "view_b", "row_a", "col_a", "row_b", "col_b", "score",
        quantized_obs_id(F.col("view_a"), F.col("row_a"), F.col("col_a"), tolerance).alias("obs_a"),
        quantized_obs_id(F.col("view_b"), F.col("row_b"), F.col("col_b"), tolerance).alias("obs_b"),
        confidence.alias("confidence"), F.greatest(F.lit(0.1), confidence).alias("texture"), F.lit(1.0).alias("nav_a"), F.lit(1.0).alias("nav_b"),
        F.lit(1.0).alias("radiometric"), F.lit("valid").alias("match_state"), F.lit("visible").alias("visibility_a"), F.lit("visible").alias("visibility_b"), F.lit("").alias("mode_id"))
