"""Set-based forms of order-dependent operators against plain sequential code on small random inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from raytable.operators import graph as G
from raytable.operators import ledger as L
from raytable.operators import matching as D
from raytable.operators import selection as P
from raytable.operators import views as V


class Sets:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reconcile_equals_sequential_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(120):
        s, a, b = rnd.choice("xy"), rnd.randrange(25), rnd.randrange(25)
        if a % 6 != b % 6:
            rows.append((f"e{k:03d}", s, f"n{a:02d}", f"n{b:02d}", f"v{a % 6}", f"v{b % 6}", rnd.randrange(9)))
    want = {}
    for s in "xy":
        sets, views = Sets(), {}
        for e, sc, u, v, wu, wv, q in sorted((r for r in rows if r[1] == s), key=lambda r: (r[6], r[0])):
            a, b = sets.find(u), sets.find(v)
            va, vb = views.setdefault(a, {wu}), views.setdefault(b, {wv})
            if a == b:
                want[e] = True
            elif va & vb:
                want[e] = False
            else:
                sets.join(a, b)
                views[min(a, b)] = va | vb
                want[e] = True
    df = spark.createDataFrame(rows, "record_id string, scope string, u string, v string, view_u string, view_v string, q int")
    got = {r["record_id"]: r["accepted"] for r in G.reconcile(df.repartition(3), ["scope"], [F.col("q")]).collect()}
    assert got == want and False in want.values()


def test_components_and_forest(spark):
    rnd = random.Random(5)
    edges = [(f"e{k:03d}", f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}", rnd.randrange(20)) for k in range(70)]
    # a long chain and a hub
    edges += [(f"c{k:03d}", f"c{k:03d}", f"c{k + 1:03d}", k % 7) for k in range(90)] + [(f"h{k:03d}", "hub", f"leaf{k:03d}", k % 5) for k in range(150)]
    df = spark.createDataFrame(edges, "edge_id string, u string, v string, w int")
    sets = Sets()
    for _, u, v, _ in edges:
        sets.join(u, v)
    got = {r["node"]: r["component"] for r in G.components(df).collect()}
    assert got == {n: sets.find(n) for n in got} and len(got) == len({x for e in edges for x in e[1:3]})
    tree, s2 = set(), Sets()
    for e, u, v, w in sorted(edges, key=lambda r: (r[3], r[0])):
        if s2.find(u) != s2.find(v):
            s2.join(u, v)
            tree.add(e)
    assert {r["edge_id"] for r in G.spanning_forest(df, [F.col("w")]).collect()} == tree


def _greedy(rows):
    """Sequential reconciliation of (edge, u, v, view_u, view_v, key)."""
    sets, views, want = Sets(), {}, {}
    for e, u, v, wu, wv, q in sorted(rows, key=lambda r: (r[5], r[0])):
        a, b = sets.find(u), sets.find(v)
        va, vb = views.setdefault(a, {wu}), views.setdefault(b, {wv})
        want[e] = a == b or not va & vb
        if a != b and want[e]:
            sets.join(a, b)
            views[min(a, b)] = va | vb
    return want


def test_reconcile_joins_a_long_chain_in_few_rounds(spark, monkeypatch):
    """2000 edges of rising keys, views all different but for one repeated at either end; branches and shortcuts beside it."""
    rnd = random.Random(4)
    view = lambda k: "v0000" if k == 2000 else f"v{k:04d}"
    pairs = [(k, k + 1, k) for k in range(2000)] + [(rnd.randrange(2001), 3000 + k, rnd.randrange(2000)) for k in range(40)] + [(*rnd.sample(range(2001), 2), 2500 + k) for k in range(20)]
    rows = [(f"e{i:05d}", f"n{a:04d}", f"n{b:04d}", view(a), view(b), q) for i, (a, b, q) in enumerate(pairs)]
    rounds = []
    real = G.is_empty
    monkeypatch.setattr(G, "is_empty", lambda df: rounds.append("_clash" in df.columns or "_k" in df.columns) or real(df))
    df = spark.createDataFrame(rows, "record_id string, u string, v string, view_u string, view_v string, q int")
    got = {r["record_id"]: r["accepted"] for r in G.reconcile(df, [], [F.col("q")]).collect()}
    want = _greedy(rows)
    assert got == want and False in want.values()
    assert 2 < sum(rounds) < 20


@pytest.mark.parametrize("tol, rows", [(0.6, 50_000), (1.7, 50_000), (0.6, 25), (1.7, 25)])
def test_leader_clusters_equal_scan(spark, monkeypatch, tol, rows):
    """With 25 points a slice every view is one dense patch cut into several slices."""
    monkeypatch.setattr(G, "SLICE_ROWS", rows)
    rnd = random.Random(7)
    pts = [("ab"[rnd.randrange(2)], rnd.randrange(120) / 8, rnd.randrange(80) / 8) for _ in range(400)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, view_id string, row double, col double")
    want = {}
    for view in "ab":
        centres, members = [], []
        for i in sorted((i for i, p in enumerate(pts) if p[0] == view), key=lambda i: pts[i][1:]):
            p = pts[i][1:]
            d = [math.dist(c, p) for c in centres]
            if not d or min(d) > tol:
                centres.append(p)
                members.append([i])
                want[i] = len(members)
            else:
                k = d.index(min(d))
                members[k].append(i)
                centres[k] = tuple(sum(pts[m][1 + j] for m in members[k]) / len(members[k]) for j in (0, 1))
                want[i] = k + 1
    got = {r["id"]: int(r["obs_id"].split("-")[1]) for r in G.cluster_endpoints(df, tol).collect()}
    assert got == want


def test_unique_match_mask_equals_scan(spark):
    rnd = random.Random(9)
    rows = [(k, "pq"[rnd.randrange(2)], rnd.randrange(30), rnd.randrange(30)) for k in range(300)]
    used, want = set(), {}
    for k, p, a, b in rows:
        want[k] = ("m", p, a) not in used and ("r", p, b) not in used
        if want[k]:
            used |= {("m", p, a), ("r", p, b)}
    df = spark.createDataFrame(rows, "k int, pair string, a int, b int")
    got = {r["k"]: r["_mask"] for r in L.unique_match_mask(df, ["pair"], "a", "b", ["k"]).collect()}
    assert got == want


def chords_one_by_one(chosen, pool, views, wanted):
    sel, pool, names = list(chosen), list(pool), []
    for _ in range(min(wanted, len(pool))):
        deg, pp = {}, {}
        for r in sel:
            deg[r[1]], deg[r[2]] = deg.get(r[1], 0) + 1, deg.get(r[2], 0) + 1
            key = "|".join(sorted(r[5:7]))
            pp[key] = pp.get(key, 0) + 1

        def score(r):
            v = r[7] + 0.10 * min(1, r[3] / (views - 1)) + 0.08 * ((deg.get(r[1], 0) < 2) + (deg.get(r[2], 0) < 2))
            v += 0.08 if not r[4] and pp.get("|".join(sorted(r[5:7])), 0) < 2 else 0
            return v - (0.05 if any(s[3] == r[3] for s in sel) else 0)

        best = min(pool, key=lambda r: (-round(score(r), 9), r[0]))
        pool.remove(best)
        sel.append(best)
        names.append(best[0])
    return names


CHORD = "pair_id string, view_a string, view_b string, separation int, same_pass boolean, pass_id_a string, pass_id_b string, quality double"


@pytest.mark.parametrize("seed,views,passes,taken,wanted", [(11, 14, 3, 6, 20), (12, 14, 3, 0, 1), (13, 20, 2, 5, 1000), (14, 24, 5, 23, 60)])
def test_chords_equal_step_by_step(spark, seed, views, passes, taken, wanted):
    rnd = random.Random(seed)
    cand = []
    for a in range(views):
        for b in range(a + 1, views):
            if rnd.random() < 0.5:
                cand.append((f"p{a:02d}-{b:02d}", f"v{a}", f"v{b}", b - a, a % passes == b % passes, f"k{a % passes}", f"k{b % passes}", rnd.random()))
    rnd.shuffle(cand)
    chosen, pool = cand[:taken], cand[taken:]
    got = [r["pair_id"] for r in V.select_chords(spark.createDataFrame(cand, CHORD), spark.createDataFrame(chosen, CHORD), views, wanted).collect()]
    assert len(got) == len(set(got)) and set(got) == set(chords_one_by_one(chosen, pool, views, wanted))


def test_chords_in_few_rounds_whatever_their_number(spark, monkeypatch):
    """Two thousand candidates of full views settle together; ties go by id and a missing quality comes last."""
    rows = [(f"p{k:04d}", f"v{k % 40}", f"v{40 + k % 41}", 1 + k % 7, False, "k0", "k1", (k // 100) / 64) for k in range(2000)]
    rows[5] = (*rows[5][:7], None)
    writes = []
    stored = V.stored
    monkeypatch.setattr(V, "stored", lambda d: writes.append(1) or stored(d))
    none = spark.createDataFrame([], CHORD)
    got = {r["pair_id"] for r in V.select_chords(spark.createDataFrame(rows, CHORD), none, 81, 1999).collect()}
    assert got == {r[0] for r in rows} - {"p0005"} and len(writes) < 200
    assert V.select_chords(none, none, 2, 5).count() == 0 and V.select_chords(spark.createDataFrame(rows, CHORD), none, 81, 0).count() == 0


@pytest.mark.parametrize("block", [7, 1024])
def test_matching_with_copies_and_near_ties(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    rnd = random.Random(17)
    kinds = [[rnd.randrange(3) + 1e4, rnd.randrange(3) - 1e4, float(rnd.randrange(2))] for _ in range(9)]
    near = [[v[0] + rnd.randrange(5) * 1e-9, *v[1:]] for v in kinds]
    rows = [(k, k % 2, rnd.choice(kinds + near)) for k in range(160)] + [(200, 0, None), (201, 1, None)]
    df = spark.createDataFrame(rows, "id int, side int, v array<double>")
    a, b = ([(i, v) for i, t, v in rows if t == side and v] for side in (0, 1))
    d2 = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    back = {i: min((d2(v, w), j) for j, w in a)[1] for i, v in b}
    want = set()
    for i, v in a:
        (d, j), (e, _) = sorted((d2(v, w), j) for j, w in b)[:2]
        if math.sqrt(d) <= 0.8 * math.sqrt(e) and back[j] == i:
            want.add((i, j))
    got = D.match_descriptors(df.filter("side = 0"), df.filter("side = 1"), [], "id", "v")
    assert want and {(r["id_a"], r["id_b"]) for r in got.collect()} == want


def test_evidence_equals_loop(spark):
    rnd = random.Random(13)
    rows = [(f"r{k:03d}", "p" if k < 200 else "q", rnd.randrange(16) / 16, *(float(rnd.randrange(100)) for _ in range(4))) for k in range(210)]
    cap, grid = 40, 4
    want = set()
    for pair in "pq":
        rs = [r for r in rows if r[1] == pair]
        if len(rs) <= cap:
            want |= {r[0] for r in rs}
            continue
        lo = [min(r[3 + j] for r in rs) for j in range(4)]
        hi = [max(r[3 + j] for r in rs) for j in range(4)]
        unit = {r[0]: [(r[3 + j] - lo[j]) / (hi[j] - lo[j]) for j in range(4)] for r in rs}
        q0, q1 = min(r[2] for r in rs), max(r[2] for r in rs)
        score = {r[0]: (r[2] - q0) / (q1 - q0) + 0.25 * sum((u - 0.5) * (u - 0.5) for u in unit[r[0]]) for r in rs}
        order = sorted((r[0] for r in rs), key=lambda i: (-score[i], i))
        cell = lambda i, s: tuple(min(grid - 1, int(unit[i][2 * s + k] * grid)) for k in (0, 1))
        keep, seen = [], [set(), set()]
        for i in order:
            if len(keep) < cap and (cell(i, 0) not in seen[0] or cell(i, 1) not in seen[1]):
                keep.append(i)
                seen[0].add(cell(i, 0)), seen[1].add(cell(i, 1))
        for i in order:
            if len(keep) < cap and i not in keep:
                keep.append(i)
        forced = set()
        for j in range(4):
            forced |= {min(rs, key=lambda r: (r[3 + j], r[0]))[0], min(rs, key=lambda r: (-r[3 + j], r[0]))[0]}
        allk = set(keep) | forced
        for i in reversed(order):
            if len(allk) <= max(cap, len(forced)):
                break
            if i in allk and i not in forced:
                allk.remove(i)
        want |= allk
    df = spark.createDataFrame(rows, "id string, pair string, score double, a double, b double, c double, d double")
    got = P.select_evidence(df, ["pair"], "id", "score", ("a", "b"), ("c", "d"), (grid, grid), cap)
    assert {r["id"] for r in got.filter("selected").collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_cycle_closures_equal_composed_paths(spark, seed):
    """Random graph in two parts with a long chain, double edges and a loop edge against paths walked in the sorted greedy forest."""
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(25)] + [tuple(rng.sample(range(12), 2)) for _ in range(12)] + [tuple(rng.sample(range(30, 36), 2)) for _ in range(8)] + [(3, 3), (4, 5), (5, 4)]
    rows = [(f"e{i:03d}", u, v, rng.randint(0, 3), rng.random(), None if i == 7 else rng.random()) for i, (u, v) in enumerate(edges)]
    df = spark.createDataFrame(rows, "edge_id string, u long, v long, q int, dx double, dy double")
    got = {r["edge_id"]: (r["in_tree"], r["closure_dx"], r["closure_dy"]) for r in G.cycle_closures(df.repartition(3), [F.col("q")], ["dx", "dy"]).collect()}
    usable = sorted((q, e, u, v, dx, dy) for e, u, v, q, dx, dy in rows if dy is not None)
    place, tree = {}, set()  # node -> (part, x, y)
    for q, e, u, v, dx, dy in usable:
        a, b = place.setdefault(u, (u, 0.0, 0.0)), place.setdefault(v, (v, 0.0, 0.0))
        if a[0] != b[0]:
            tree.add(e)
            sx, sy = a[1] + dx - b[1], a[2] + dy - b[2]
            for n, (p, x, y) in list(place.items()):
                if p == b[0]:
                    place[n] = (a[0], x + sx, y + sy)
    assert got.keys() == {r[1] for r in usable}
    for q, e, u, v, dx, dy in usable:
        want = (dx - (place[v][1] - place[u][1]), dy - (place[v][2] - place[u][2]))
        assert got[e][0] == (e in tree) and got[e][1:] == pytest.approx(want, abs=1e-9)


def test_empty_tables(spark):
    edges = spark.createDataFrame([], "record_id string, u string, v string, view_u string, view_v string, q int")
    assert G.reconcile(edges, [], [F.col("q")]).count() == 0
    assert G.cluster_endpoints(spark.createDataFrame([], "id int, view_id string, row double, col double"), 0.5).count() == 0


def shuffle_files(spark) -> int:
    from pathlib import Path

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.is_file() for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data"))


def test_components_leave_no_shuffle_files_and_find_the_smallest_node(spark):
    import time

    from raytable.runtime import tune

    rnd, sets = random.Random(4), Sets()
    rows = [(f"n{rnd.randrange(400):03d}", f"n{rnd.randrange(400):03d}") for _ in range(260)]
    rows += [(f"a{k:03d}", f"a{k + 1:03d}") for k in range(99)] + [(f"b{99 - k:02d}", f"b{98 - k:02d}") for k in range(60)]  # chains in both orders
    rows += [("z", f"s{k:02d}") for k in range(50)] + [("lone", "lone"), ("a005", "a004")]  # a hub with the largest name, a loop, a repeat
    for a, b in rows:
        sets.join(a, b)
    tune(spark)
    time.sleep(1)  # files go in the background
    before = shuffle_files(spark)
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(rows, "u string, v string")).collect()}
    assert got == {n: sets.find(n) for n in list(sets.p)}
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert G.components(spark.createDataFrame([], "u string, v string")).count() == 0
