"""Robust points of packed rays: nothing is shuffled where the rays of a key stand in one row, and weights are those of ``base_weights``."""

import numpy as np
from pyspark.sql import functions as F

import workloads
from raytable import runtime
from raytable.operators import points as P


def written(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_two_ray_points_shuffle_nothing(spark, sf_dir):
    before = written(spark)
    workloads.QUERIES["slv_02_two_ray_points"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert written(spark) == before


def test_weights_of_packed_rays_equal_base_weights(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), f"o{i}", f"p{rng.integers(3)}", float(rng.random()), float(rng.random())) for i, k in enumerate(rng.integers(0, 20, 200))]
    rays = spark.createDataFrame(rows, "track int, obs_id string, pass_id string, confidence double, nav double")
    want = {r.obs_id: r.base_weight for r in P.base_weights(rays, ["track"]).collect()}
    rows.sort()
    tracks = np.unique([r[0] for r in rows], return_inverse=True)[1]
    w = P._pass_weights(np.array([r[3] * r[4] for r in rows]), np.array([int(r[2][1:]) for r in rows]), tracks, tracks.max() + 1)
    assert np.allclose(w, [want[r[1]] for r in rows], rtol=1e-12)


def test_points_do_not_depend_on_diagnostics_or_steps(spark, sf_dir, monkeypatch):
    r = workloads.base.table(spark, sf_dir, "fx_rays").filter("track < 400")
    cols = lambda p: sorted(p.select("track", "state", "ray_count", "accepted_count", *(F.round(c, 6) for c in ("x", "y", "z", "rms", "angle_min", "angle_max", "cov_xx"))).collect())
    assert cols(P.reconstruct_points(r, ["track"])[0]) == cols(P.reconstruct_points(r, ["track"], diagnostics=False)[0])


def test_only_large_keys_are_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BUCKETS", 4)  # full buckets hold small keys too
    df = spark.range(1000).select((F.col("id") % 100).alias("k")).unionByName(spark.range(500).select(F.lit(7).cast("long").alias("k")))
    assert [x.k for x in runtime.large_keys(df, ["k"], 100).collect()] == [7]
    assert runtime.large_keys(df, ["k"], 10_000).count() == 0
