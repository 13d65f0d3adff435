"""Consensus models try all hypotheses of the reference, counted for packs of rows as one by one."""

import inspect

import numpy as np
import pytest

import workloads
from raytable.operators import network as N


@pytest.mark.parametrize("kind", ["similarity", "affine"])
def test_queries_try_every_hypothesis(spark, sf_dir, monkeypatch, kind):
    seen = []
    whole = N.consensus_model

    def spy(*args, **named):
        bound = inspect.signature(whole).bind(*args, **named)
        bound.apply_defaults()
        seen.append(bound.arguments["maximum"])
        raise StopIteration

    monkeypatch.setattr(N, "consensus_model", spy)
    with pytest.raises(StopIteration):
        workloads.QUERIES[f"slv_04_consensus_{kind}"](spark, sf_dir)
    assert seen == [512]


def sequential(rows, kind, distance=3.0, maximum=512, refits=3):
    x, y, u, v = np.array(rows, float).T
    size = 2 if kind == "similarity" else 3
    apply = lambda m: np.hypot(m[0] * x + m[1] * y + m[2] - u, m[3] * x + m[4] * y + m[5] - v)
    best = None
    for h, s in enumerate(N.hypothesis_samples(len(x), size, maximum)):
        i = np.array(s) - 1
        m = N._fit(kind, x[i], y[i], u[i], v[i])
        if m is None:
            continue
        e = apply(m)
        near = e <= distance
        grid = lambda a: round(float(np.median(a)) / N.SCORE_GRID) * N.SCORE_GRID if len(a) else 1e300
        score = (-near.sum(), grid(e[near]), grid(e), round(float(np.sqrt((m[0] - 1) ** 2 + m[1] ** 2 + m[3] ** 2 + (m[4] - 1) ** 2)) / N.SCORE_GRID), h)
        if best is None or score < best[0]:
            best = (score, m)
    m = best[1]
    for _ in range(refits):
        near = apply(m) <= distance
        m = N._fit(kind, x[near], y[near], u[near], v[near])
    return m, apply(m) <= distance


@pytest.mark.parametrize("kind", ["similarity", "affine"])
def test_packs_equal_the_sequential_form(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "ROWS_AT_ONCE", 50)
    rng = np.random.default_rng(3)
    table, want = [], {}
    for p, noise in enumerate((0.0, 1.5, 4.0)):  # exact rows, noisy ones, hardly any agreement
        at = rng.uniform(0, 500, (400, 2))
        to = at @ np.array([[1.5, 0.25], [-0.25, 1.5]]) + [8, -4] + rng.normal(0, 1, (400, 2)) * noise
        to[rng.random(400) < 0.6] += rng.uniform(20, 200, 2)
        rows = np.hstack([at, to])
        want[p] = sequential(rows, kind)
        table += [(p, k, *map(float, r)) for k, r in enumerate(rows)]
    df = spark.createDataFrame(table, "pair long, id long, mx double, my double, rx double, ry double")
    models, out = N.consensus_model(df, ["pair"], ["id"], kind)
    for r in models.collect():
        assert np.allclose([r[c] for c in N.MATRIX], want[r.pair][0], atol=1e-6)
    got = {(r.pair, r.id): r.accepted for r in out.collect()}
    assert all(got[p, k] == bool(a) for p, (_, near) in want.items() for k, a in enumerate(near))
