"""What round 3 found to grow faster than its input."""

import random

import numpy as np
from pyspark.sql import functions as F

from raytable.operators import models, network


def _matches(spark):
    rng, rows = random.Random(5), []
    for pair, n, exact in (("all", 40, 40), ("most", 41, 28), ("half", 40, 20), ("none", 30, 0), ("two", 2, 2), ("one", 1, 1)):
        for k in range(n):
            x, y = float(rng.randrange(512)), float(rng.randrange(512))
            d = (0.0, 0.0) if k < exact else (rng.uniform(-6, 6), rng.uniform(-6, 6))
            rows.append((pair, k, x, y, 1.5 * x - 0.25 * y + 8 + d[0], 0.25 * x + 1.5 * y - 4 + d[1]))
    rows.append(("void", 0, None, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "p string, k int, mx double, my double, rx double, ry double")


def test_consensus_takes_medians_only_where_counts_do_not_settle(spark, monkeypatch):
    m, asked = _matches(spark), []
    monkeypatch.setattr(network, "median", lambda df, by, v, name, plain=network.median: asked.append({r.p for r in df.select("p").distinct().collect()}) or plain(df, by, v, name))
    run = lambda: [sorted(map(tuple, t.collect()), key=str) for t in network.consensus_model(m, ["p"], ["k"], "similarity", 3.0, 64)]
    got = run()
    assert all(not {"all", "most"} & pairs for pairs in asked)
    assert [r[0] for r in got[0]] == ["all", "half", "most", "none", "two"]
    monkeypatch.setattr(network, "_contenders", lambda tied, by: tied.withColumn("_settled", F.lit(False)))  # exact medians of all
    assert got == run()


def test_monte_carlo_covariance_is_dealt_and_equals_the_plain_form(spark):
    root = np.linalg.cholesky(np.array([[1.0, 0.25, 0.0], [0.25, 2.0, 0.5], [0.0, 0.5, 1.5]]))
    df = spark.range(300).coalesce(1).select("id", *((F.col("id") % (5 + k) / 4.0 - 0.5).alias(f"j{k}") for k in range(6)))
    out = models.mc_covariance(df, "id", [["j0", "j1", "j2"], ["j3", "j4", "j5"]], root, 50, 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1  # one file, several tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seeds = {r.id: r.s for r in df.select("id", F.xxhash64("id").alias("s")).collect()}
    rows = {r.id: np.array(r[1:]).reshape(2, 3) for r in df.collect()}
    for r in out.collect():
        q = np.random.default_rng([7, seeds[r.id] & 0x7FFFFFFFFFFFFFFF]).standard_normal((50, 3)) @ root.T @ rows[r.id].T
        assert np.allclose(np.cov(q.T, bias=True)[np.triu_indices(2)], r[1:], rtol=1e-12, atol=1e-12)
    assert out.count() == 300


def test_pyramid_levels_are_made_from_the_level_below(spark, monkeypatch):
    from raytable.operators import raster

    rng = random.Random(3)
    rows = [(k, r, c, float(rng.randrange(256)), rng.random() < 0.8) for k, h, w in ((0, 150, 5), (1, 9, 40)) for r in range(h) for c in range(w)]
    rows += [(0, 150 + 70, 3, 7.0, True), (0, 4, 2, 9.0, True), (2, 0, 0, 1.0, False)]  # beyond the stated size, twice, a single void
    px = spark.createDataFrame(rows, "layer int, r int, c int, v double, valid boolean")
    sizes = {0: (150, 5, 4), 1: (9, 40, 2), 2: (1, 1, 0)}  # height, width, deepest level for tiles of 16
    want = {}
    for k, r, c, v, ok in rows:
        h, w, deepest = sizes[k]
        for level in range(deepest + 1):
            cell = (k, level, min(r >> level, max(2, -(-h // 2 ** level)) - 1), min(c >> level, max(2, -(-w // 2 ** level)) - 1))
            want.setdefault(cell, []).append(v if ok else None)
    read = []
    monkeypatch.setattr(raster, "stored", lambda df, plain=raster.stored: (lambda out: read.append(out.count()) or out)(plain(df)))
    out = raster.pyramid(px, spark.createDataFrame([(k, *v[:2]) for k, v in sizes.items()], "layer int, height bigint, width bigint"), 16)
    got = {tuple(r[:4]): tuple(r[4:]) for r in out.select("layer", "level", "pr", "pc", "v", "valid").collect()}
    full = {k: [v for v in vs if v is not None] for k, vs in want.items()}
    assert got == {k: (sum(vs) / len(vs) if vs else 0.0, bool(vs)) for k, vs in full.items()}
    assert len(read) == 6 and sum(read[1:]) < 1.6 * len(rows)  # sizes and five levels; all levels together are little more than the source


def test_splat_deals_points_of_one_file(spark):
    from raytable.operators import voxels

    points = spark.range(400).coalesce(1).select(
        (F.col("id") % 40 * 1.0).alias("x"), (F.floor(F.col("id") / 40) * 1.0).alias("y"), F.lit(1.0).alias("z"), F.lit(0.25).alias("sigma"),
        F.lit("m").alias("mode_id"), F.col("id").cast("string").alias("view_id"), F.lit("p").alias("pass_id"), F.lit(1).alias("pass_count"))
    seen = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = voxels.splat(points, voxels.Box((0.0, 40.0), (0.0, 10.0), (0.0, 4.0)), [1.0])
        seen = out._jdf.queryExecution().optimizedPlan().toString()
        total = out.agg(F.sum("weight")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen.index("MapInPandas") < seen.index("RepartitionByExpression")  # dealt before the kernels
    assert abs(total - 400) < 1e-9  # every kernel is normalised
