"""Scopes of ordinary size are reconciled as rows; larger ones in rounds with the same decisions and roots."""

import random

from pyspark.sql import functions as F

from raytable.operators import graph as G

COLS = "record_id string, scope string, u string, v string, view_u string, view_v string, q int"


def edges(rnd, count=150):
    rows = []
    for k in range(count):
        s, a, b = rnd.choice("xyz"), rnd.randrange(25), rnd.randrange(25)
        if a % 6 != b % 6:
            rows.append((f"e{k:03d}", s, f"n{a:02d}", f"n{b:02d}", f"v{a % 6}", f"v{b % 6}", rnd.randrange(9)))
    return rows


def test_ordinary_scopes_take_no_rounds(spark, monkeypatch):
    df = spark.createDataFrame(edges(random.Random(4)), COLS)
    tables, store = [], G.stored
    monkeypatch.setattr(G, "stored", lambda d: tables.append(1) or store(d))
    got = G.reconcile(df, ["scope"], [F.col("q")])
    assert got.filter("not accepted").count() > 0
    assert not tables  # the rounds stored six tables each


def test_rounds_and_rows_agree(spark, monkeypatch):
    rows = edges(random.Random(5)) + [("own", "x", "n99", "n99", "v0", "v0", 1), ("none", "y", "n98", "n97", None, None, 1)]
    df = spark.createDataFrame(rows, COLS)
    run = lambda: {r.record_id: (r.accepted, r.root) for r in G.reconcile(df, ["scope"], [F.col("q")], roots=True).collect()}
    local = run()
    monkeypatch.setattr(G, "SCOPE_EDGES", 50)  # some scopes are large, one is not
    mixed = run()
    monkeypatch.setattr(G, "SCOPE_EDGES", 0)
    assert local == mixed == run() and len(local) == len(rows)
    assert any(not ok for ok, _ in local.values()) and all((root is None) == (not ok) for ok, root in local.values())


def test_trees_of_ordinary_tracks_take_no_rounds(spark, monkeypatch):
    df = spark.createDataFrame(edges(random.Random(6)) + [("own", "z", "n99", "n99", "v0", "v0", 0)], COLS).selectExpr("scope as track_id", "record_id as edge_id", "u", "v", "q as metric")
    tables, store = [], G.stored
    monkeypatch.setattr(G, "stored", lambda d: tables.append(1) or store(d))
    rows = lambda: sorted(map(tuple, G.track_spanning_tree(df, [F.col("metric")]).collect()))
    local = rows()
    assert local and not tables
    monkeypatch.setattr(G, "SCOPE_EDGES", 0)
    assert rows() == local
