"""Elevation grid ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_dem(cells: DataFrame, nodata: float | None = None, excluded: str | None = None, minimum_valid: int = 4) -> tuple[DataFrame, DataFrame]:
    """Mark valid cells (finite, not nodata, not excluded) and report coverage; too few valid cells is an error."""
    ok = F.col("up").isNotNull() & ~F.isnan("up")
    if nodata is not None:
        ok = ok & (F.col("up") != nodata)
    if excluded is not None:
        ok = ok & ~F.coalesce(F.col(excluded), F.lit(False))
    grid = cells.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("up", F.when(F.col("valid"), F.col("up")))
    d = grid.agg(F.count(F.lit(1)).alias("cells"), F.count_if("valid").alias("valid_cells"), F.min("up").alias("minimum"), F.max("up").alias("maximum"),
                 (F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    d = d.filter(F.assert_true(F.col("valid_cells") >= minimum_valid, "an elevation grid needs more valid cells").isNull())
    return grid, d.withColumn("coverage", F.col("valid_cells") / F.col("cells"))
