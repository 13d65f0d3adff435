"""Distributed pointing adjustment against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raytable.operators import network as N

IU = np.triu_indices(6)
RAYS = "view_a string, view_b string, " + ", ".join(f"{s}{p}{c} double" for s in "ab" for p in "od" for c in "xyz")


def network(seed, views=7, extra=5):
    """Random pair blocks over two parts of a network, as a table and as a dense system."""
    rng = np.random.default_rng(seed)
    pairs = {(k, k + 1) for k in range(views - 1) if k != 3} | {tuple(sorted(rng.choice(4, 2, replace=False))) for _ in range(extra)}
    rows, h, g = [], np.zeros((3 * views, 3 * views)), np.zeros(3 * views)
    blocks = {}
    for a, b in sorted((int(x), int(y)) for x, y in pairs):
        j = rng.normal(size=(4 if a % 2 else 9, 6))  # some blocks are singular
        m, r = j.T @ j, j.T @ rng.normal(size=len(j))
        at = [3 * a + k for k in range(3)] + [3 * b + k for k in range(3)]
        h[np.ix_(at, at)] += m
        g[at] += r
        blocks[a, b] = (at, m, r)
        rows.append((f"v{a}", f"v{b}", [*map(float, m[IU]), *map(float, r), 1.0, 1.0, 0.0]))
    return rows, h, g, blocks


def test_block_solver_and_inverse_equal_dense_ones(spark):
    rows, h, g, _ = network(1, 6)
    opt = N.AdjustOptions(prior_sigma=0.5)
    own, off = N._system(spark.createDataFrame(rows, "view_a string, view_b string, v array<double>"))
    held = N._held(own, opt)
    dense = h + np.eye(len(h)) / 0.25
    rhs = own.select(F.lit(0).alias("rhs"), "view_id", *(F.col(f"g{k}").alias(f"b{k}") for k in range(3)))
    got = {r.view_id: [r.x0, r.x1, r.x2] for r in N.solve_blocks(held, off, rhs).collect()}
    assert np.allclose(np.concatenate([got[f"v{k}"] for k in range(6)]), np.linalg.solve(dense, g), atol=1e-8)
    want, seen = np.linalg.inv(dense), np.zeros_like(dense)
    for r in N.inverse_blocks(held, off).collect():
        i, j = int(r.view_id[1:]), int(r.c[1:])
        seen[3 * i:3 * i + 3, 3 * j:3 * j + 3] = np.array([r[c] for c in N.NINE]).reshape(3, 3)
    assert np.allclose(seen, want, atol=1e-8)  # blocks between the two parts are zero and have no row


def test_leave_one_out_equals_a_refit(spark):
    rows, h, g, blocks = network(3, 6)
    opt = N.AdjustOptions(prior_sigma=0.5)
    got = {(r.view_a, r.view_b): r for r in N.leave_one_out(spark.createDataFrame(rows, "view_a string, view_b string, v array<double>"), opt).collect()}
    dense = h + np.eye(len(h)) / 0.25
    full, degree = -np.linalg.solve(dense, g), np.bincount([k for p in blocks for k in p])
    assert len(got) == len(blocks)
    for (a, b), (at, m, r) in blocks.items():
        less, lessg = dense.copy(), g.copy()
        less[np.ix_(at, at)] -= m
        lessg[at] -= r
        d = -np.linalg.solve(less, lessg) - full
        row = got[f"v{a}", f"v{b}"]
        assert row.max_change == pytest.approx(np.abs(d).max(), abs=1e-8) and row.rms_change == pytest.approx(np.sqrt((d ** 2).mean()), abs=1e-8)
        assert row.missing_views == "|".join(f"v{k}" for k in (a, b) if degree[k] == 1)


def rays(spark):
    """Ground points seen by five views whose rays are turned by known angles; one row is not finite."""
    rng = np.random.default_rng(6)
    angles = rng.uniform(-0.01, 0.01, (5, 3))
    origin = np.array([[-30, 0, 0], [30, 5, 0], [0, 40, 5], [5, -35, 2], [10, 10, -8]], float)
    inverse = [np.linalg.inv(np.stack([N._turn(np.eye(3)[[k]], a[None])[0] for k in range(3)], 1)) for a in angles]
    rows = []
    for _ in range(240):
        a, b = rng.choice(5, 2, replace=False)
        ground = np.array([*rng.uniform(-50, 50, 2), rng.uniform(90, 110)])
        da, db = inverse[a] @ (ground - origin[a]), inverse[b] @ (ground - origin[b])
        rows.append((f"v{a}", f"v{b}", *map(float, [*origin[a], *da, *origin[b], *db])))
    rows.append(("v0", "v1", *[0.0] * 3, *[float("nan")] * 3, *[1.0] * 6))
    return spark.createDataFrame(rows, RAYS), angles


def test_planted_angles_come_back(spark):
    df, angles = rays(spark)
    opt = N.AdjustOptions(prior_sigma=10.0, iterations=2)
    views, _ = N.adjust_views(df, opt, sigmas=False)
    got = {r.view_id: r for r in views.collect()}
    for k in range(5):
        r = got[f"v{k}"]
        assert np.allclose([r.omega, r.phi, r.kappa], angles[k], atol=1e-4)
        assert r.records == 240 and r.lost_records == 1 and r.cost_after < r.cost_before and r.sigma_omega is None


def test_loss_is_what_the_weights_descend_on():
    r = np.linspace(-4, 4, 81)
    for loss in ("none", "huber", "cauchy", "bisquare"):
        opt, e = N.AdjustOptions(loss=loss, scale=1.5), 1e-6
        slope = (N._loss(r + e, opt) - N._loss(r - e, opt)) / (2 * e)
        off = np.abs(np.abs(r) - 1.5) > 1e-3
        assert np.allclose(slope[off], (2 * N._weights(r, opt) * r)[off], atol=1e-5)
