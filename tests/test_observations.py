"""Observations: which members are looked at again, and what travels with a record."""

import math
import random

from pyspark.sql import functions as F

from raytable.operators import association as A

ENDS = "view string, pass string, obs string, row double, col double, ox double, oy double, oz double, dx double, dy double, dz double, confidence double, nav double, visibility string, pair_id string"


def _members():
    rng = random.Random(5)
    out = []
    for k in range(120):
        spread = (0.0, 0.1, 0.2, 0.35, 0.8)[k % 5]
        tilt = (0.0, 1e-9, 8e-8, 2e-7, 1e-6)[k // 5 % 5]
        shift = (0.0, 4e-7, 9e-7, 3e-6)[k // 25 % 4]
        for _ in range(1 + k % 4):
            row = None if k % 17 == 3 else 100 + spread * rng.random()
            out.append((f"v{k % 3}", None if k == 40 else f"p{k % 3 + (k == 60) * rng.randrange(2)}", f"o{k}", row, 50 + spread * rng.random(), 1 + shift * rng.random(), 2.0, 3.0,
                        tilt * rng.random(), 0.0, 1.0, 0.5, 0.5, rng.choice(("visible", "visible", "unknown", "occluded")) if k % 11 == 0 else "visible", "a|b"))
    return out


def _agree(rows):
    """The verdict by looking at all members, None where a mean is missing."""
    mean = lambda v: sum(v) / len(v)
    unit = [tuple(c / math.sqrt(sum(x * x for x in r[8:11])) for c in r[8:11]) for r in rows]
    if len({r[1] for r in rows} - {None}) != 1 or {"visible", "occluded"} <= {r[13] for r in rows}:
        return False
    o, d = [mean([r[5 + k] for r in rows]) for k in range(3)], [mean([u[k] for u in unit]) for k in range(3)]
    n = math.sqrt(sum(x * x for x in d))
    far = max(math.dist(r[5:8], o) for r in rows) <= 1e-6 and max(math.degrees(math.acos(min(1, sum(a * b / n for a, b in zip(u, d))))) for u in unit) <= 1e-5
    if any(r[3] is None for r in rows):
        return None if far else False
    m = mean([r[3] for r in rows]), mean([r[4] for r in rows])
    return far and max(math.dist(r[3:5], m) for r in rows) <= 0.25


def test_consistency_equals_a_look_at_all_members(spark):
    rows = _members()
    groups = {}
    for r in rows:
        groups.setdefault(f"{r[0]}|{r[2]}", []).append(r)
    want = {k: _agree(v) for k, v in groups.items()}
    assert set(want.values()) == {True, False, None}
    ends = spark.createDataFrame(rows, ENDS)
    for f in (A.consistent_observations, A.consolidate_observations):
        assert {r["node"]: r["consistent"] for r in f(ends).collect()} == want


def test_only_some_observations_are_looked_at_again(spark):
    """Rows are shuffled once: members of the same place need no second look at the means."""
    first = A._observed(spark.createDataFrame([r for r in _members() if r[2] in ("o0", "o25", "o100")], ENDS), {}, 0.25, 1e-6, 1e-5)
    assert first.filter("consistent is null").count() == 0
    assert "Union" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_checked_records_carry_what_was_asked_for(spark, sf_dir):
    from workloads.base import table
    from workloads.tracks import verdicts

    df = verdicts(table(spark, sf_dir, "fx_records"), "mode_id")
    assert df.columns == ["record_id", "mode_id", "u", "v", "association_reason", "association_state"]
    joins = [n for n in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in n]
    assert len(joins) == 2  # rays, pixels and the like were left behind before these
    assert df.select(F.count("record_id")).first()[0] == table(spark, sf_dir, "fx_records").count()
