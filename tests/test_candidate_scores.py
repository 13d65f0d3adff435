"""Patches of candidates are not written."""

from raytable.operators import raster


def test_candidate_scores_store_scores_only(spark, monkeypatch):
    px = spark.sql("select cast(id div 12 as bigint) as r, cast(id % 12 as bigint) as c, cast(id * id % 31 as double) as v, true as valid from range(144)")
    seeds = spark.sql("select 1 as seed, 5 as r, 5 as c, true as valid union all select 2, 6, 6, true")
    made = []
    for name in ("stored", "materialize"):
        monkeypatch.setattr(raster, name, lambda df, plain=getattr(raster, name): made.append(df.columns) or plain(df))
    rows = raster.candidate_scores(seeds, px, px, (-1, 1), (0, 0), 2).collect()
    assert len(rows) == 6 and all(abs(r.score - 1) < 1e-12 for r in rows if r.dx == 0)
    assert made == [["seed", "r", "c", "dx", "dy", "score", "texture"]]
