"""The rational fit joins coefficients with packs of samples."""

import random

from raytable.operators import models


def test_coefficients_meet_packs_not_samples(spark, monkeypatch):
    rng, rows = random.Random(1), []
    for m in (0, 1):
        for _ in range(1500):
            x, y, z = (rng.uniform(-1, 1) for _ in "xyz")
            rows.append((m, x, y, z, (m + 1 + 0.5 * x - 0.25 * y * z) / (1 + 0.125 * x + 0.0625 * z)))
    seen = []
    monkeypatch.setattr(models, "stored", lambda df, plain=models.stored: (lambda out: seen.append((df.columns, out.count())) or out)(plain(df)))
    out = models.fit_rational(spark.createDataFrame(rows, "m int, x double, y double, z double, t double").coalesce(1), "m", "t").collect()
    assert sorted(r.m for r in out) == [0, 1] and all(r.max_error < 1e-6 and r.min_denominator > 0.5 for r in out)
    assert seen[0][0] == ["m", "x", "y", "z", "t"] and seen[0][1] < 10  # 3000 samples
