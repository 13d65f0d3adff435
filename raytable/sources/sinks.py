"""Writers: products with a compact summary, fixed-width records and tiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(points: DataFrame) -> DataFrame:
    """Compact counts of a point product, without the bulk rows."""
    return points.groupBy("mode_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("sigma").isNotNull()).alias("with_uncertainty"),
                                         F.avg("sigma").alias("mean_sigma"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def write_product(df: DataFrame, path: str) -> None:
    """Full rows as Parquet next to a JSON summary."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    summary(df).write.mode("errorifexists").json(f"{path}/summary")


def fixed_width(df: DataFrame, profile: list[tuple[Column, str, int, str]], name: str = "record") -> DataFrame:
    """One text record per row. profile: (value, kind 's' or 'n', width, printf format).

    Text is padded right, numbers left. An array value repeats its field. A value wider than its field fails the query.
    """
    parts = []
    for value, kind, width, fmt in profile:
        field = _field(kind, width, fmt)
        is_array = df.select(value.alias("v")).schema["v"].dataType.typeName() == "array"
        parts.append(F.array_join(F.transform(value, field), "") if is_array else field(value))
    return df.withColumn(name, F.concat(*parts))


def _field(kind: str, width: int, fmt: str):
    decimals = re.search(r"\.(\d+)f$", fmt)

    def field(v: Column) -> Column:
        if decimals:  # ties go to the even digit, as in C formatting
            r = F.bround(v, int(decimals.group(1)))
            v = F.when((v < 0) & (r == 0), F.lit(-0.0)).otherwise(r)  # a rounded-away negative keeps its sign
        text = v.cast("string") if kind == "s" else F.format_string(fmt, v)
        fits = F.assert_true(F.length(text) <= width, f"a field exceeds width {width}").isNull()
        return F.when(fits, F.rpad(text, width, " ") if kind == "s" else F.lpad(text, width, " "))

    return field


def write_records(df: DataFrame, path: str, name: str = "record") -> None:
    df.select(F.col(name).alias("value")).write.mode("errorifexists").text(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """One folder per layer and tile, mask as its own column; large tiles keep several files instead of one task."""
    tiles.repartition("layer", "tile_row", "tile_col").write.mode("errorifexists").partitionBy("layer", "tile_row", "tile_col").parquet(path)
