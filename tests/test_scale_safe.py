"""Ordered, quantile and point operators give the same result however rows are sliced or keys are skewed."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from raytable import schemas
from raytable.functions import geometry as G
from raytable.functions.vec import Vec
from raytable.operators import ordered as O
from raytable.operators import points as P
from raytable.operators import quantiles as Q
from raytable.operators import voxels as X
from raytable.sources import tables as T


def skewed(spark):
    """One key owns two thirds of the rows."""
    return spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
                                    F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double").alias("v"), F.col("id"))


def test_rank_and_running_sum(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    want = {r["id"]: (r["rn"], r["s"]) for r in df.select("id", F.row_number().over(w).alias("rn"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()}
    a = O.rank_rows(df, ["k"], ["v", "id"], "rn", slices=6)
    b = O.running_sum(df, ["k"], ["v", "id"], F.col("v"), "s", slices=6)
    got = {r["id"]: (r["rn"], r["s"]) for r in a.join(b.select("id", "s"), "id").select("id", "rn", "s").collect()}
    assert got == want


def test_lag_and_last_known(spark):
    df = skewed(spark).withColumn("x", F.when(F.col("id") % 5 == 0, F.col("id")))
    w = Window.partitionBy("k").orderBy("v", "id")
    want = {r["id"]: (r["a"], r["b"], r["c"]) for r in df.select("id", F.lag("id").over(w).alias("a"), F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("b"),
                                                                F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("c")).collect()}
    a = O.lag_rows(df, ["k"], ["v", "id"], "id", "a", 6).select("id", "a")
    b = O.last_known(df, ["k"], ["v", "id"], "x", "b", True, 6).select("id", "b")
    c = O.last_known(df, ["k"], ["v", "id"], "x", "c", False, 6).select("id", "c")
    assert {r["id"]: (r["a"], r["b"], r["c"]) for r in a.join(b, "id").join(c, "id").collect()} == want


@pytest.mark.parametrize("accuracy", [20, 20000])
def test_quantiles_are_exact_even_with_a_coarse_sketch(spark, accuracy):
    df = skewed(spark)
    got = {r["k"]: r for r in Q.pctl(df, ["k"], F.col("v"), {"a": (0.5, "linear"), "b": (0.95, "nearest"), "c": (0.9, "midpoint"), "d": (1.0, "nearest")}, accuracy).collect()}
    vals = {}
    for r in df.collect():
        vals.setdefault(r["k"], []).append(r["v"])
    for k, v in vals.items():
        v, n = np.sort(v), len(v)
        pos = min(n, max(1, 0.9 * n + 0.5))
        mid = v[int(pos) - 1] + (pos - int(pos)) * (v[min(int(pos), n - 1)] - v[int(pos) - 1])
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"], got[k]["d"]], [np.quantile(v, 0.5), v[int(np.ceil(0.95 * n)) - 1], mid, v[-1]])


def rays(spark, noise=True):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(12):
        target = np.array([t, 2 * t, 50.0])
        for k in range(3 + t % 5):
            o = rng.uniform(-20, 20, 3) * [1, 1, 0]
            d = target - o + (rng.normal(0, 0.02, 3) if noise else 0) + (np.array([9, 0, 0]) if k == 2 and t % 3 == 0 else 0)
            rows.append((t, f"o{t}-{k}", f"p{k % 2}", *map(float, o), *map(float, d), 0.5 + k / 10, 1.0))
    return spark.createDataFrame(rows, "track int, obs_id string, pass_id string, ox double, oy double, oz double, dx double, dy double, dz double, confidence double, nav double")


def test_distributed_points_equal_local_points(spark):
    r = rays(spark)
    a, da = P.reconstruct_points(r, ["track"], P.PointOptions())
    b, db = P.reconstruct_points(r, ["track"], P.PointOptions(local_rays=0))
    left = {x["track"]: x for x in a.collect()}
    right = {x["track"]: x for x in b.collect()}
    assert left.keys() == right.keys()
    for t in left:
        assert left[t]["state"] == right[t]["state"] and left[t]["accepted_count"] == right[t]["accepted_count"]
        for c in ("x", "y", "z", "rms", "cov_xx", "cov_yz", "sigma_1", "angle_min", "angle_max"):
            if left[t][c] is None:
                assert right[t][c] is None
            else:
                assert right[t][c] == pytest.approx(left[t][c], rel=1e-4, abs=1e-6), (t, c)
    ra, rb = ({x["obs_id"]: (x["accepted"], x["reason"]) for x in d.collect()} for d in (da, db))
    assert ra == rb and not all(v[0] for v in ra.values())


def test_point_result_does_not_depend_on_row_order(spark):
    r = rays(spark)
    key = lambda df: {x["track"]: (round(x["x"] or 0, 9), x["state"]) for x in P.reconstruct_points(df, ["track"])[0].collect()}
    assert key(r.repartition(1)) == key(r.orderBy(F.desc("obs_id")).repartition(7))


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    mk = lambda n, p: [(f"{p}{i:03d}", "mn"[i % 2], *map(float, rng.integers(0, 400, 3) / 8)) for i in range(n)]
    a, b = mk(120, "a"), mk(40, "b")
    cols = "point_id string, mode_id string, x double, y double, z double"
    got = {r["point_id"]: r["nearest_id"] for r in X.nearest_by_mode(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), 0.5).collect()}
    want = {p[0]: min((np.linalg.norm(np.subtract(p[2:], q[2:])), q[0]) for q in b if q[1] == p[1])[1] for p in a}
    assert got == want


def test_nearest_with_outliers_missing_and_crowded_points(spark):
    """A point a million units away, missing coordinates, one crowded position and one crowded cell, ties by the smallest id."""
    rng = np.random.default_rng(5)
    mk = lambda n, p: [(f"{p}{i:03d}", "mn"[i % 2], *map(float, rng.integers(0, 40, 3) / 8)) for i in range(n)]
    a = mk(60, "a") + [("far", "m", -1e6, 3.0, 2e6), ("lost", "m", None, 1.0, 1.0), ("nan", "n", float("nan"), 1.0, 1.0), ("other", "k", 1.0, 1.0, 1.0)]
    b = mk(150, "b") + [(f"c{i:03d}", "m", 2.0, 2.0, 2.0) for i in range(80)] + [("away", "n", 5e5, 0.0, 0.0), ("gone", "n", 1.0, None, 1.0)]
    b += [(f"e{i:03d}", "m", 3 + i / 4096, 3.0, 3 + i % 7 / 8192) for i in range(120)]
    cols = "point_id string, mode_id string, x double, y double, z double"
    got = {r["point_id"]: (r["nearest_id"], r["distance"]) for r in X.nearest_by_mode(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), 0.5).collect()}
    assert len(got) == len(a)
    for p in a:
        near = [(float(np.linalg.norm(np.subtract(p[2:], q[2:]))), q[0]) for q in b if q[1] == p[1] and None not in q and None not in p and p[2] == p[2]]
        if not near:
            assert got[p[0]] == (None, None)
        else:
            assert got[p[0]] == (min(near)[1], pytest.approx(min(near)[0]))


# golden rows: origin, direction, plane height 50, expected status and range
GOLDEN = [((0, 0, 0), (0, 0, 1), "ok", 50.0), ((3, -4, 10), (1, 2, 4), "ok", 10.0), ((0, 0, 100), (0, 0, -2), "ok", 25.0),
          ((0, 0, 0), (1, 1, 0), "parallel", None), ((0, 0, 60), (0, 0, 1), "behind", None)]


def test_plane_intersection_golden_rows(spark):
    rows = [(i, *map(float, o), *map(float, d)) for i, (o, d, _, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, ox double, oy double, oz double, dx double, dy double, dz double")
    plane = G.Plane((0, 0, 50), (1, 0, 0), (0, 1, 0), (0, 0, 1))
    for r in G.intersect_plane(df, Vec.prefixed("o"), Vec.prefixed("d"), plane).collect():
        _, _, status, rng = GOLDEN[r["i"]]
        assert r["status"] == status and r["valid"] == (status == "ok")
        if status == "ok":
            assert r["range"] == pytest.approx(rng, abs=1e-11) and r["world_z"] == pytest.approx(50.0, abs=1e-11)


def test_schemas_fail_closed(spark):
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "point_id string, x double")
    assert T.conform(good, schemas.POINTS, "point_id").count() == 2
    with pytest.raises(ValueError):
        T.conform(good.withColumn("surprise", F.lit(1)), schemas.POINTS)
    with pytest.raises(ValueError):
        T.conform(good.drop("point_id"), schemas.POINTS)
    with pytest.raises(Exception, match="more than once"):
        T.conform(good.unionByName(good), schemas.POINTS, "point_id").collect()


def test_grid_refinement_per_model(spark):
    """Straight, bent and unknown models: each ends on its own, with its own nodes and state."""
    from raytable.operators import models

    m = spark.createDataFrame([("flat", 0.0), ("half", 0.5), ("full", 1.0), ("void", None)], "model string, a double")
    bend = lambda p, t: p.join(t, "model").withColumn("row", F.col("a") * F.col("x") * F.col("x")).withColumn("col", F.lit(0.0)).drop("a")
    nodes, log = models.refine_grid(m, "model", bend, (-1.0,) * 3, (1.0,) * 3, (3, 3, 3), 0.01, 800)
    got = {(r["model"], r["round"]): (r["ni"], r["max_error"], r["state"]) for r in log.collect()}
    want = {("flat", 0): (3, 0.0, "converged")}
    for name, a in (("half", 0.5), ("full", 1.0), ("void", None)):
        for k in range(3):
            error = None if a is None else a / 4 ** (k + 1)
            want[name, k] = (2 ** (k + 1) + 1, error, "refining" if k < 2 else "converged" if name == "half" else "nodeLimit")
    assert got == want
    assert {r["model"]: r["count"] for r in nodes.groupBy("model").count().collect()} == {"flat": 27, "half": 729, "full": 729, "void": 729}
    none, log = models.refine_grid(m.limit(0), "model", bend, (-1.0,) * 3, (1.0,) * 3, (3, 3, 3), 0.01, 800)
    assert none.count() == 0 and log.count() == 0
