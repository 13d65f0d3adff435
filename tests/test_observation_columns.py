"""Observations shuffle what their wanted columns need."""

from raytable.operators import association as A


def test_wanted_columns_equal_those_of_the_whole_observation(spark, monkeypatch):
    ends = spark.sql("""select concat('v', id % 3) as view, concat('o', id % 7) as obs, concat('p', id % 3) as pass, concat('q', id % 5) as pair_id, id * 0.5 as row, id * 0.25 as col, 0.0D as ox, 0.0D as oy, 0.0D as oz,
        1.0D as dx, id * 0.5D as dy, 2.0D as dz, id / 8 as confidence, id / 4 as nav, case id % 4 when 0 then 'visible' when 1 then 'occluded' when 2 then 'visible' end as visibility from range(100)""")
    whole = A.consolidate_observations(ends)
    assert whole.columns == list(A.OBSERVED)
    parts = (["obs_id", "visibility"], ["node", "view_id", "row", "col"], ["node", "dx", "pass_id", "pair_count"], ["node", "row", "consistent"])
    want = [sorted(map(str, whole.select(*keep).collect())) for keep in parts]
    assert want[3] == sorted(map(str, A.consolidate_observations(ends, keep=parts[3]).collect()))
    monkeypatch.setattr(A, "_observed", None)  # members are not compared where nobody asks
    for keep, rows in zip(parts[:3], want):
        assert sorted(map(str, A.consolidate_observations(ends, keep=keep).collect())) == rows
