"""Deterministic selection: evidence per pair, spatial quotas, decimation, budgets, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raytable.runtime import stored

from .ordered import rank_rows


def _grid_cell(df: DataFrame, x: str, y: str, lo_hi: dict, grid: tuple[int, int], tag: str) -> DataFrame:
    rows, cols = grid
    for axis, c, n in (("x", x, cols), ("y", y, rows)):
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        df = df.withColumn(f"_u_{tag}{axis}", (F.col(c) - F.col(f"_lo_{c}")) / F.when(span <= 2.220446049250313e-16, 1.0).otherwise(span))
        df = df.withColumn(f"_b_{tag}{axis}", F.least(F.lit(n), F.greatest(F.lit(1), F.floor(F.col(f"_u_{tag}{axis}") * n) + 1)))
    return df.withColumn(f"_cell_{tag}", (F.col(f"_b_{tag}x") - 1) * rows + F.col(f"_b_{tag}y"))


def select_evidence(df: DataFrame, by: list[str], id_col: str, score: str, moving: tuple[str, str], reference: tuple[str, str],
                    grid: tuple[int, int] = (4, 4), cap: int = 250, weight: float = 0.25) -> DataFrame:
    """Diverse evidence per pair: first row of every cell, then by score to the cap, extremes always kept.

    Adds ``selected``. State per pair stays bounded (cells, cap rows and eight extremes), whatever the pair's size:
    cell winners and extremes are min/max aggregates, score leaders use a group limit applied before the shuffle.
    """
    coords = [*moving, *reference]
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(score).alias("_qlo"), F.max(score).alias("_qhi"),
        *(F.min(c).alias(f"_lo_{c}") for c in coords), *(F.max(c).alias(f"_hi_{c}") for c in coords))
    # one row per pair, stored with its true size: few pairs are sent to all tasks instead of sorting their rows by pair
    stats = stored(stats)
    z = df.select(*by, id_col, score, *coords).join(stats, by)
    z = _grid_cell(z, moving[0], moving[1], {}, grid, "m")
    z = _grid_cell(z, reference[0], reference[1], {}, grid, "r")
    quality = F.when(F.col("_qhi") > F.col("_qlo"), (F.col(score) - F.col("_qlo")) / (F.col("_qhi") - F.col("_qlo"))).otherwise(1.0)
    radial = sum(((F.col(c) - 0.5) * (F.col(c) - 0.5) for c in ("_u_mx", "_u_my", "_u_rx", "_u_ry")), F.lit(0.0))
    z = z.withColumn("_key", F.struct((-(quality + weight * radial)).alias("s"), F.col(id_col).alias("i")))
    big = z.filter(F.col("_n") > cap)
    cells = F.array(F.struct(F.lit("m").alias("side"), F.col("_cell_m").alias("cell")),
                    F.struct(F.lit("r").alias("side"), F.col("_cell_r").alias("cell")))
    winners = (big.select(*by, "_key", F.explode(cells).alias("_c")).groupBy(*by, "_c").agg(F.min("_key").alias("_key")).select(*by, "_key").distinct().withColumn("_kind", F.lit(0)))
    leaders = (big.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("_key"))).filter(F.col("_rn") <= cap)
               .select(*by, "_key").withColumn("_kind", F.lit(1)))
    picks = []
    for c in coords:
        picks += [F.min(F.struct(F.col(c).alias("v"), F.col("_key.i").alias("i"), F.col("_key").alias("k"))).alias(f"_f{len(picks)}")]
        picks += [F.min(F.struct((-F.col(c)).alias("v"), F.col("_key.i").alias("i"), F.col("_key").alias("k"))).alias(f"_f{len(picks)}")]
    extremes = big.groupBy(*by).agg(*picks)
    extremes = (extremes.select(*by, F.explode(F.array(*(F.col(f"_f{i}.k") for i in range(8)))).alias("_key"))
                .distinct().withColumn("_kind", F.lit(2)))
    pool = (winners.unionByName(leaders).unionByName(extremes).groupBy(*by, "_key")
            .agg(F.max(F.col("_kind") == 0).alias("_cover"), F.max(F.col("_kind") == 2).alias("_forced")))
    order = Window.partitionBy(*by)
    # coverage rows first (both groups in score order), up to the cap
    pool = pool.withColumn("_rank", F.row_number().over(order.orderBy(F.col("_cover").desc(), "_key")))
    pool = pool.withColumn("_keep", (F.col("_rank") <= cap))
    pool = pool.withColumn("_limit", F.greatest(F.lit(cap), F.sum(F.col("_forced").cast("long")).over(order)))
    pool = pool.filter(F.col("_keep") | F.col("_forced"))
    pool = pool.withColumn("_trim", F.row_number().over(order.orderBy(F.col("_forced").desc(), "_key")))
    chosen = pool.filter(F.col("_trim") <= F.col("_limit")).select(*by, F.col("_key.i").alias(id_col), F.lit(True).alias("_sel"))
    chosen = stored(chosen)
    small = stats.filter(F.col("_n") <= cap).select(*by, F.lit(True).alias("_all"))
    return (df.join(small, by, "left").join(chosen, by + [id_col], "left")
            .withColumn("selected", F.coalesce("_all", "_sel", F.lit(False))).drop("_all", "_sel"))


def select_spatially(points: DataFrame, by: list[str], n: int, x: str, y: str, width: int, height: int,
                     order: list[Column]) -> DataFrame:
    """N features per layer by rising quota per grid cell: rank in cell first, then the global order.

    Both windows are filtered by ``n``, so Spark limits every group before the shuffle.
    """
    aspect = width / max(height, 1)
    cols = max(1, int(-(-((n * aspect) ** 0.5) // 1)))
    rows = max(1, -(-n // cols))
    bin_of = lambda c, size, k: F.least(F.lit(k), F.greatest(F.lit(1), F.floor((F.col(c) - 0.5) / max(size, 1) * k) + 1))
    z = points.withColumn("_cell", (bin_of(x, width, cols) - 1) * rows + bin_of(y, height, rows))
    z = z.withColumn("_q", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(*order))).filter(F.col("_q") <= n)
    z = z.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_q", *order))).filter(F.col("_r") <= n)
    return z.drop("_cell", "_q", "_r")


def decimate(df: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Evenly spaced rows: the distinct values of round(linspace(1, n, limit)), halves away from zero."""
    ranked = rank_rows(df, by, order, "_rn", total="_n")
    if limit == 1:
        return ranked.filter("_rn = _n").drop("_rn", "_n")
    # row rn is taken iff some k in 0..limit-1 has round(1 + k (n-1)/(limit-1)) = rn
    step = (F.col("_n") - 1) / F.lit(float(limit - 1))
    k0 = F.ceil((F.col("_rn") - 1.5) / step)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        k = F.least(F.greatest(k0 + d, F.lit(0)), F.lit(limit - 1))
        hit = hit | (F.round(1 + k * step) == F.col("_rn"))
    return ranked.filter((F.col("_n") <= limit) | hit).drop("_rn", "_n")


def quality_order(metric: str, *ids: str) -> list[Column]:
    """Best first: metric ascending with unknown last, then ids."""
    return [F.col(metric).asc_nulls_last(), *(F.col(i).asc() for i in ids)]


def worst(ledger: DataFrame, residual: str, id_col: str, n: int) -> DataFrame:
    """The N largest residuals (ties: smallest id); a distributed top-k, not a sort."""
    return ledger.orderBy(F.col(residual).desc_nulls_last(), F.col(id_col).asc()).limit(n)


def split_budget(pairs: DataFrame, available: str, total: int, cap: int, order: str = "pair_id") -> DataFrame:
    """Share a record budget: floor(total / pairs), the first ``remainder`` pairs get one more, capped per pair."""
    ranked = _global_rank(pairs, order)
    base = F.floor(F.lit(total) / F.col("_pairs"))
    extra = F.when(F.col("_rn") <= F.lit(total) - base * F.col("_pairs"), 1).otherwise(0)
    return (ranked.withColumn("budget", F.least(F.lit(cap), base + extra).cast("bigint"))
            .withColumn("taken", F.least("budget", F.col(available)).cast("bigint")).drop("_rn", "_pairs"))


def _global_rank(df: DataFrame, order: str) -> DataFrame:
    return rank_rows(df.withColumn("_one", F.lit(0)), ["_one"], [order], "_rn", total="_pairs").drop("_one")


def best_two(scores: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """Best score with its position, runner-up, tie count and uniqueness margin per key (bounded candidate sets)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties))
    top = scores.withColumn("_rn", rank).filter(F.col("_rn") <= 2)
    two = top.groupBy(*by).agg(F.max(F.when(F.col("_rn") == 1, F.struct(F.col(score).alias("s"), *ties))).alias("_b"),
                               F.max(F.when(F.col("_rn") == 2, F.col(score))).alias("second"))
    best = scores.groupBy(*by).agg(F.max(score).alias("_m"), F.count(F.lit(1)).alias("candidates"))
    tied = scores.join(best, by).filter(F.abs(F.col(score) - F.col("_m")) <= 1e-12).groupBy(*by).agg(F.count(F.lit(1)).alias("ties"))
    out = two.join(best.drop("_m"), by).join(tied, by)
    return out.select(*by, F.col("_b.s").alias("best"), *(F.col(f"_b.{t}").alias(t) for t in ties), "second", "ties", "candidates",
                      (F.col("_b.s") - F.col("second")).alias("margin"))
