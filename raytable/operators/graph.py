"""Graph operators as DataFrame rounds. Every round is stored in the shared folder; no group is gathered in one task."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raytable.runtime import is_empty, large_keys, stored

from .ordered import rank_rows


def _numbered(nodes: DataFrame) -> DataFrame:
    """Order-preserving 64-bit number per distinct node ``a``, so that loops compare longs instead of strings or structs."""
    return stored(nodes.repartitionByRange("a").sortWithinPartitions("a").select("a", F.monotonically_increasing_id().alias("i")))


def components(edges: DataFrame, u: str = "u", v: str = "v", node: str = "node", component: str = "component") -> DataFrame:
    """Connected components: one row per node with its smallest reachable node.

    Contraction: every node points to its smallest neighbour. Seen as edges, each node takes its least edge in one total order, so pointers
    only close in mutual pairs, whose smaller end is a root. Pointer jumping leads every node to its root; edges move
    to the roots and loops and repeats go. Each round at least halves the nodes that still have edges, and what is settled is not touched
    again, so all rounds together write a small multiple of the edges. Hubs are safe: minima combine before the shuffle and AQE splits skewed joins.
    """
    raw = stored(edges.select(F.col(u).alias("a"), F.col(v).alias("b")))
    ids = _numbered(raw.select(F.explode(F.array("a", "b")).alias("a")).distinct())
    pairs = (raw.filter("a <> b").join(ids, "a").select("b", F.col("i").alias("x")).join(ids.select(F.col("a").alias("b"), F.col("i").alias("y")), "b"))
    live = stored(pairs.select("x", "y"))
    levels = []
    while not is_empty(live):
        ends = live.unionByName(live.select(F.col("y").alias("x"), F.col("x").alias("y")))
        best = ends.groupBy("x").agg(F.min("y").alias("p"))
        back = best.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        root = (F.col("pp") == F.col("x")) & (F.col("x") < F.col("p"))
        parent = _rooted(stored(best.join(back, "p").select("x", F.when(root, F.col("x")).otherwise(F.col("p")).alias("p"))), "x")
        levels.append(parent)
        to = lambda c, name: parent.select(F.col("x").alias(c), F.col("p").alias(name))
        moved = live.join(to("x", "a"), "x").select("y", "a").join(to("y", "b"), "y").filter("a <> b")
        live = stored(moved.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    if not levels:
        return ids.select(F.col("a").alias(node), F.col("a").alias(component))
    # the root of a node in the first round, the root of that root in the second, and so on: the last rounds are the smallest
    top = levels.pop()
    while levels:
        top = stored(levels.pop().join(top.select(F.col("x").alias("p"), F.col("p").alias("r")), "p", "left").select("x", F.coalesce("r", "p").alias("p")))
    least = top.groupBy("p").agg(F.min("x").alias("r"))  # a root is not always the smallest node of its tree
    roots = stored(ids.join(top.join(least, "p").select(F.col("x").alias("i"), "r"), "i", "left").select("a", F.coalesce("r", "i").alias("r"), "i"))
    names = roots.filter("i = r").select("r", F.col("a").alias("c"))
    return roots.join(names, "r").select(F.col("a").alias(node), F.col("c").alias(component))


def _rooted(parent: DataFrame, c: str) -> DataFrame:
    """``c``, p with every pointer p moved on to the root of its tree (a root points to itself)."""
    while True:
        up = parent.select(F.col(c).alias("p"), F.col("p").alias("pp"))
        jumped = stored(parent.join(up, "p").select(c, F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("_moved")))
        parent = jumped.drop("_moved")
        if is_empty(jumped.filter("_moved")):
            return parent


def spanning_forest(edges: DataFrame, order: list[Column], u: str = "u", v: str = "v", edge_id: str = "edge_id") -> DataFrame:
    """Minimum spanning forest under a total order (ends in the unique edge id): Boruvka rounds.

    Returns the chosen edge ids. With a total order the forest is unique, so it equals a sorted greedy scan.
    """
    live = stored(edges.select(F.col(edge_id).alias("_e"), F.struct(*order, F.col(edge_id)).alias("_k"),
                                    F.col(u).alias("_a"), F.col(v).alias("_b")).filter("_a <> _b"))
    chosen = None
    while not is_empty(live):  # every cluster with an edge joins another one
        ends = live.select(F.explode(F.array(F.struct(F.col("_a").alias("c"), F.col("_b").alias("o")),
                                             F.struct(F.col("_b").alias("c"), F.col("_a").alias("o")))).alias("p"), "_k", "_e").select("p.*", "_k", "_e")
        best = stored(ends.groupBy("c").agg(F.min(F.struct("_k", "_e", "o")).alias("m")).select("c", F.col("m.o").alias("o"), F.col("m._e").alias("_e")))
        picked = best.select("_e").distinct()
        chosen = picked if chosen is None else chosen.unionByName(picked)
        # each cluster points over its best edge; the smaller of a mutual pair is the root
        back = best.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        parent = best.join(back, "o").select("c", F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"))
        parent = stored(parent)
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = stored(parent.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("_moved")))
            parent = jumped.drop("_moved")
            if is_empty(jumped.filter("_moved")):
                break
        for side in ("_a", "_b"):
            live = live.join(parent.select(F.col("c").alias(side), F.col("p").alias("_p")), side, "left").withColumn(side, F.coalesce("_p", side)).drop("_p")
        live = stored(live.filter("_a <> _b"))
    if chosen is None:
        return edges.select(edge_id).limit(0)
    return chosen.select(F.col("_e").alias(edge_id)).distinct()


def cycle_closures(edges: DataFrame, order: list[Column], offsets: list[str], u: str = "u", v: str = "v", edge_id: str = "edge_id") -> DataFrame:
    """Closure of every fundamental cycle: edge id, in_tree, and per offset column the direct minus the composed displacement.

    An edge carries the displacement from ``u`` to ``v``. Borůvka rounds build the minimum spanning forest under the total order; every edge
    keeps the displacement between the roots of its two clusters, and a merge adds what pointer jumping composed along the
    tree. When both ends are in one cluster, what is left is the mismatch of the cycle the edge closes, whatever its length; it is zero for edges of
    the forest. Rounds and jumps are logarithms, no path is walked. An edge with a NULL offset takes no part; a loop edge (u = v) closes on itself.
    """
    off = [f"_d{k}" for k in range(len(offsets))]
    usable = F.lit(True)
    for c in offsets:
        usable = usable & F.col(c).isNotNull()
    rows = edges.filter(usable).select(F.col(edge_id).alias("_e"), F.struct(*order, F.col(edge_id)).alias("_k"), F.col(u).alias("_a"), F.col(v).alias("_b"),
                                       *(F.col(c).cast("double").alias(d) for c, d in zip(offsets, off)))
    closed = [rows.filter("_a = _b").select("_e", F.lit(False).alias("_tree"), *off)]
    live = stored(rows.filter("_a <> _b"))
    while not is_empty(live):
        side = lambda c, o, sign: F.struct(F.col(c).alias("c"), F.col(o).alias("o"), *((F.col(d) * sign).alias(d) for d in off))
        ends = live.select(F.explode(F.array(side("_a", "_b", -1.0), side("_b", "_a", 1.0))).alias("p"), "_k", "_e").select("p.*", "_k", "_e")
        best = stored(ends.groupBy("c").agg(F.min(F.struct("_k", "_e", "o", *off)).alias("m")).select("c", "m._e", "m.o", *(F.col(f"m.{d}").alias(d) for d in off)))
        picked = best.select("_e").distinct().withColumn("_tree", F.lit(True))
        # a cluster points over its best edge, with its place seen from there; the smaller of a mutual pair is the root
        back = best.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        root = (F.col("oo") == F.col("c")) & (F.col("c") < F.col("o"))
        parent = stored(best.join(back, "o").select("c", F.when(root, F.col("c")).otherwise(F.col("o")).alias("p"), *(F.when(root, 0.0).otherwise(F.col(d)).alias(d) for d in off)))
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"), *(F.col(d).alias(f"{d}u") for d in off))
            jumped = stored(parent.join(up, "p").select("c", F.col("pp").alias("p"), *((F.col(d) + F.when(F.col("p") == F.col("c"), 0.0).otherwise(F.col(f"{d}u"))).alias(d) for d in off), (F.col("p") != F.col("pp")).alias("_moved")))
            parent = jumped.drop("_moved")
            if is_empty(jumped.filter("_moved")):
                break
        live = live.join(picked, "_e", "left").withColumn("_tree", F.coalesce("_tree", F.lit(False)))
        for name, sign in (("_a", 1.0), ("_b", -1.0)):
            move = parent.select(F.col("c").alias(name), F.col("p").alias("_p"), *(F.col(d).alias(f"{d}q") for d in off))
            live = live.join(move, name, "left").withColumn(name, F.coalesce("_p", name))
            live = live.withColumns({d: F.col(d) + sign * F.coalesce(f"{d}q", F.lit(0.0)) for d in off}).drop("_p", *(f"{d}q" for d in off))
        live = stored(live)
        closed.append(live.filter("_a = _b").select("_e", "_tree", *off))
        live = live.filter("_a <> _b").drop("_tree")
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.select(F.col("_e").alias(edge_id), F.col("_tree").alias("in_tree"), *(F.col(d).alias(f"closure_{c}") for c, d in zip(offsets, off)))


def track_spanning_tree(edges: DataFrame, order: list[Column], track: str = "track_id") -> DataFrame:
    """Tree edges per track with ``tree_state``: ok, or disconnectedTrack when nodes-1 edges do not exist.

    Tracks of at most SCOPE_EDGES edges are rows that are scanned best edge first, larger ones take the rounds of ``spanning_forest``.
    """
    state = F.when(F.col("tree_edges") == F.col("node_count") - 1, "ok").otherwise("disconnectedTrack")
    known = edges.filter(F.col(track).isNotNull())
    big = large_keys(known, [track], SCOPE_EDGES)
    none_big = is_empty(big)
    small = known if none_big else known.join(big, track, "left_anti")
    rest = [c for c in edges.columns if c != track]
    blank = F.lit(None).cast("string")
    scanned = _reconcile_local(small.withColumns({"view_u": blank, "view_v": blank}), [track], order, "edge_id", tree=True)
    found = scanned.select(track, *rest, "node_count", "tree_edges", state.alias("tree_state"))
    return found if none_big else found.unionByName(_tree_rounds(stored(known.join(big, track, "left_semi")), order, track))


def _tree_rounds(edges: DataFrame, order: list[Column], track: str) -> DataFrame:
    scoped = edges.withColumn("_u", F.struct(track, F.col("u").alias("n"))).withColumn("_v", F.struct(track, F.col("v").alias("n")))
    tree = spanning_forest(scoped, order, "_u", "_v")
    nodes = edges.select(track, F.explode(F.array("u", "v")).alias("n")).distinct().groupBy(track).agg(F.count(F.lit(1)).alias("node_count"))
    out = edges.join(tree, "edge_id", "left_semi")
    count = out.groupBy(track).agg(F.count(F.lit(1)).alias("tree_edges"))
    state = F.when(F.col("tree_edges") == F.col("node_count") - 1, "ok").otherwise("disconnectedTrack")
    return out.join(nodes.join(count, track).withColumn("tree_state", state), track)


SCOPE_EDGES = 1024  # a scope with more edges is not gathered


def _greedy(u: list, v: list, views_u: list, views_v: list, tree: bool = False) -> tuple[list, list]:
    """Of the edges of one scope, best first: which are accepted (with ``tree`` only those that join two parts), and the smallest node of the track of those."""
    parent, seen = {}, {}
    for node, view in ((u, views_u), (v, views_v)):
        for n, w in zip(node, view):
            parent[n] = n
            views = seen.setdefault(n, set())
            if w is not None:
                views.add(w)

    def find(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    accepted = []
    for x, y in zip(u, v):
        a, b = find(x), find(y)
        joins = a != b and seen[a].isdisjoint(seen[b])
        accepted.append(joins or (a == b and not tree))
        if joins:
            a, b = min(a, b), max(a, b)
            parent[b] = a
            seen[a] |= seen.pop(b)
    return accepted, [find(x) if ok else None for x, ok in zip(u, accepted)]


def _reconcile_local(edges: DataFrame, scope: list[str], order: list[Column], edge_id: str, tree: bool = False) -> DataFrame:
    """``edges`` with ``accepted`` and ``root``: a scope is one row of edges in order, scanned one after the other.

    With ``tree`` only the accepted edges, with the numbers of nodes and of accepted edges of their scope."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = edges.columns
    packed = edges.select(*scope, F.struct(F.struct(*order, F.col(edge_id)).alias("k"), F.struct(*names).alias("e")).alias("_r"))
    packed = packed.groupBy(*scope).agg(F.array_sort(F.collect_list("_r")).alias("_l")).select(F.col("_l.e").alias("_l"))

    def scan(batches):
        for batch in batches:
            lists = batch.column(0)
            sizes, flat = pc.list_value_length(lists).to_pylist(), lists.flatten()
            ends = [flat.field(c).to_pylist() for c in ("u", "v", "view_u", "view_v")]
            accepted, roots, at, nodes, taken = [], [], 0, [], []
            for n in sizes:
                own = [c[at: at + n] for c in ends]
                ok, root = _greedy(*own, tree)
                accepted += ok
                roots += root
                if tree:
                    nodes += [len({*own[0], *own[1]})] * n
                    taken += [sum(ok)] * n
                at += n
            cols = {c: flat.field(c) for c in names} | {"accepted": pa.array(accepted, pa.bool_()), "root": pa.array(roots, flat.field("u").type)}
            if tree:
                cols |= {"node_count": pa.array(nodes, pa.int64()), "tree_edges": pa.array(taken, pa.int64())}
            out = pa.RecordBatch.from_pydict(cols)
            yield out.filter(cols["accepted"]) if tree else out

    fields = [*edges.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("root", edges.schema["u"].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("node_count", "tree_edges") if tree]
    return packed.mapInArrow(scan, T.StructType(fields))


def reconcile(edges: DataFrame, scope: list[str], order: list[Column], edge_id: str = "record_id", roots: bool = False) -> DataFrame:
    """Greedy track building: best edge first, two clusters join unless they share a view.

    edges: scope…, edge id, u, v, view_u, view_v and the order columns. Adds ``accepted`` and, with ``roots``, the smallest node of an
    accepted edge's track as ``root``. Scopes of ordinary size are gathered as one row each and scanned in order; larger ones
    (more than SCOPE_EDGES edges) take the same decisions in parallel rounds.
    """
    scoped = edges if scope else edges.withColumn("_one", F.lit(0))
    by = scope or ["_one"]
    big = large_keys(scoped, by, SCOPE_EDGES)
    if is_empty(big):
        out = _reconcile_local(scoped, by, order, edge_id)
    else:
        same = [scoped[c].eqNullSafe(big[c]) for c in by]
        small, large = scoped.join(big, same, "left_anti"), stored(scoped.join(big, same, "left_semi"))
        rounds = _reconcile_rounds(large, by, order, edge_id)
        if roots:
            rounds = stored(rounds)
            place = lambda n: F.struct(F.struct(*by).alias("s"), F.col(n).alias("n")).alias(n)
            tops = components(rounds.filter("accepted").select(place("u"), place("v"))).select(F.col("node").alias("_node"), F.col("component.n").alias("root"))
            rounds = rounds.withColumn("_node", F.when(F.col("accepted"), F.struct(F.struct(*by).alias("s"), F.col("u").alias("n")))).join(tops, "_node", "left").drop("_node")
        out = _reconcile_local(small, by, order, edge_id)
        out = (out if roots else out.drop("root")).unionByName(rounds)
    return out.select(*edges.columns, "accepted", *(("root",) if roots else ()))


def _reconcile_rounds(edges: DataFrame, scope: list[str], order: list[Column], edge_id: str) -> DataFrame:
    """The sequential result in parallel rounds, no step gathers a scope.

    An edge inside one cluster is accepted, one between clusters sharing a view is rejected (view sets only grow). Of the others, each cluster
    points over its best edge. The pointers form trees whose edges get better towards the root, and pointer jumping finds the roots, so a
    chain of rising keys is one tree. Up to the first edge that leaves a tree, nothing from outside touches it, and up to the
    second cluster that brings a view, nothing inside it clashes: that part of the tree joins at once, and where the clash comes first its
    edge is rejected. Rounds grow with the rejections that follow each other along one chain, not with its length. Scopes in which no view
    repeats cannot conflict and are accepted at once.
    """
    e = edges.withColumn("_scope", F.struct(*scope))
    both = lambda df: df.select("_scope", F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("view_u").alias("w")),
                                                            F.struct(F.col("v").alias("n"), F.col("view_v").alias("w")))).alias("p")).select("_scope", "p.*").distinct()
    repeated = stored(both(e).groupBy("_scope", "w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("_scope").distinct())
    clean = e.join(repeated, "_scope", "left_anti").select(F.col(edge_id).alias("_e"), F.lit(True).alias("_ok"))
    held = stored(e.join(repeated, "_scope", "left_semi").select(F.col(edge_id).alias("_e"), F.struct(F.struct(*order).alias("o"), F.col(edge_id).alias("e")).alias("_key"),
                                                                "_scope", "u", "v", "view_u", "view_v"))
    keys = _numbered(held.select(F.col("_key").alias("a"))).select(F.col("a.e").alias("_e"), F.col("i").alias("_k"))
    nodes = stored(both(held).withColumn("a", F.struct("_scope", "n")).groupBy("a").agg(F.collect_set("w").alias("w")))
    ids = _numbered(nodes.select("a"))
    named = lambda name, to: ids.select(F.col("a").alias(name), F.col("i").alias(to))
    live = held.join(keys, "_e").withColumn("_u", F.struct("_scope", F.col("u").alias("n"))).withColumn("_v", F.struct("_scope", F.col("v").alias("n")))
    live = stored(live.join(named("_u", "_a"), "_u").join(named("_v", "_b"), "_v").select("_e", "_k", "_a", "_b"))
    clusters = stored(nodes.join(ids, "a").select(F.col("i").alias("c"), "w"))
    decided = [live.filter("_a = _b").select("_e", F.lit(True).alias("_ok"))]
    live = live.filter("_a <> _b")
    while not is_empty(live):  # the best edge of all is decided in every round
        seen = live.join(clusters.select(F.col("c").alias("_a"), F.col("w").alias("_wa")), "_a").join(clusters.select(F.col("c").alias("_b"), F.col("w").alias("_wb")), "_b")
        marked = stored(seen.select("_e", "_k", "_a", "_b", F.arrays_overlap("_wa", "_wb").alias("_clash")))
        decided.append(marked.filter("_clash").select("_e", F.lit(False).alias("_ok")))
        open_ = marked.filter("not _clash").drop("_clash")
        ends = open_.select(F.explode(F.array(F.struct(F.col("_a").alias("c"), F.col("_b").alias("o")), F.struct(F.col("_b").alias("c"), F.col("_a").alias("o")))).alias("p"), "_k")
        best = ends.groupBy("p.c").agg(F.min(F.struct("_k", "p.o")).alias("m")).select("c", F.col("m.o").alias("p"), F.col("m._k").alias("t"))
        tree = stored(best)
        # t: the edge over which a cluster enters its tree; the smaller end of the best edge of a tree is the root, which is there from the start
        root = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))
        back = tree.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        tree = stored(tree.join(back, "p").select("c", F.when(root, F.col("c")).otherwise(F.col("p")).alias("p"), F.when(root, F.lit(-1)).otherwise(F.col("t")).alias("t")))
        while True:
            up = tree.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = stored(tree.join(up, "p").select("c", F.col("pp").alias("p"), "t", (F.col("p") != F.col("pp")).alias("_moved")))
            tree = jumped.drop("_moved")
            if is_empty(jumped.filter("_moved")):
                break
        tree = tree.withColumnRenamed("p", "r")
        of = lambda c, to: tree.select(F.col("c").alias(c), F.col("r").alias(to))
        leaving = open_.join(of("_a", "_ra"), "_a").join(of("_b", "_rb"), "_b").filter("_ra <> _rb")
        leaving = leaving.select(F.explode(F.array("_ra", "_rb")).alias("r"), "_k").groupBy("r").agg(F.min("_k").alias("leave"))
        brought = tree.join(clusters, "c").select("r", "t", F.explode("w").alias("w"))
        first = brought.groupBy("r", "w").agg(F.min("t").alias("t0"))
        again = brought.join(first, ["r", "w"]).filter("t > t0").groupBy("r").agg(F.min("t").alias("clash"))
        limits = tree.select("r").distinct().join(leaving, "r", "left").join(again, "r", "left")
        bounded = stored(tree.join(limits, "r"))
        taken = bounded.filter("(leave is null or t < leave) and (clash is null or t < clash)").select("c", "r")
        cuts = bounded.filter("t = clash and (leave is null or t < leave)").select(F.col("t").alias("_k"), F.lit(True).alias("_cut"))
        to = lambda c, name: taken.select(F.col("c").alias(c), F.col("r").alias(name))
        moved = open_.join(to("_a", "_na"), "_a", "left").join(to("_b", "_nb"), "_b", "left").join(cuts, "_k", "left")
        moved = stored(moved.select("_e", "_k", F.coalesce("_na", "_a").alias("_a"), F.coalesce("_nb", "_b").alias("_b"), F.coalesce("_cut", F.lit(False)).alias("_cut")))
        decided.append(moved.filter("_cut or _a = _b").select("_e", (~F.col("_cut")).alias("_ok")))
        live = moved.filter("not _cut and _a <> _b").drop("_cut")
        # the views of a cluster are all different, so the list is as long as the network has views at most
        clusters = stored(clusters.join(taken, "c", "left").groupBy(F.coalesce("r", "c").alias("c")).agg(F.flatten(F.collect_list("w")).alias("w")))
    verdict = clean
    for d in decided:
        verdict = verdict.unionByName(d)
    return edges.join(verdict.withColumnRenamed("_e", edge_id), edge_id).withColumnRenamed("_ok", "accepted")


# --- order-dependent clustering -----------------------------------------------------------

SLICE_ROWS = 50_000  # points a task scans; the result does not depend on it


class _Leaders:
    """Running-mean clusters within reach of a scan line, found through a grid of their centres."""

    def __init__(self, tolerance: float, front: list[float], dims: int):
        self.tolerance, self.size, self.dims = tolerance, tolerance * 1.001, dims  # a hair wider: cells of rounded quotients still touch
        self.around = list(product((-1, 0, 1), repeat=dims))
        self.first, self.centre, self.mass, self.cells = [], [], [], {}
        step = 2 * dims + 1
        for k in range(0, len(front), step):
            self._start(tuple(front[k:k + dims]), tuple(front[k + dims:k + 2 * dims]), front[k + step - 1])

    def _cell(self, p: tuple) -> tuple:
        return tuple(int(x // self.size) for x in p)

    def _start(self, first: tuple, centre: tuple, mass: float) -> int:
        self.first.append(first), self.centre.append(centre), self.mass.append(mass)
        self.cells.setdefault(self._cell(centre), []).append(len(self.first) - 1)
        return len(self.first) - 1

    def add(self, p: tuple, weight: float) -> int:
        at, hit, near = self._cell(p), -1, float("inf")
        for o in self.around:
            for k in self.cells.get(tuple(a + b for a, b in zip(at, o)), ()):
                d = sum((a - b) ** 2 for a, b in zip(self.centre[k], p)) ** 0.5
                if d < near or (d == near and k < hit):
                    hit, near = k, d
        if hit < 0 or near > self.tolerance:
            return self._start(p, p, weight)
        old = self._cell(self.centre[hit])
        self.mass[hit] += weight
        share = weight / self.mass[hit]
        self.centre[hit] = tuple(c + (x - c) * share for c, x in zip(self.centre[hit], p))
        new = self._cell(self.centre[hit])
        if new != old:
            self.cells[old].remove(hit)
            self.cells.setdefault(new, []).append(hit)
        return hit

    def front(self, lead: float) -> list[float]:
        """Clusters that points from ``lead`` on can still reach, in order of creation: first point, centre, mass."""
        return [x for f, c, m in zip(self.first, self.centre, self.mass) if lead - c[0] <= self.tolerance for x in (*f, *c, m)]


def _scan_slice(pdf: pd.DataFrame, by: list[str], coords: list[str], tolerance: float, front: list[float]) -> tuple[pd.DataFrame, list[float]]:
    """Points of one slice with the first point, centre and mass of their cluster at the end of the slice, and the front it hands on.

    ``front`` is what the slice before handed on; it concerns the first patch of the slice."""
    pdf = pdf.sort_values([*by, "_patch", *coords], kind="mergesort")
    points, weights = list(zip(*(pdf[c].tolist() for c in coords))), pdf["_w"].tolist()
    patch = pdf.groupby([*by, "_patch"], sort=False, dropna=False).ngroup().to_numpy()
    borders = [0, *(np.flatnonzero(np.diff(patch)) + 1).tolist(), len(points)]
    first, centre, mass = [], [], []
    for a, b in zip(borders, borders[1:]):
        if b - a == 1 and not front and b < len(points):  # most patches are one point
            first.append(points[a]), centre.append(points[a]), mass.append(weights[a])
            continue
        leaders = _Leaders(tolerance, front, len(coords))
        front = []
        hits = [leaders.add(points[i], weights[i]) for i in range(a, b)]
        first += [leaders.first[h] for h in hits]
        centre += [leaders.centre[h] for h in hits]
        mass += [leaders.mass[h] for h in hits]
    more = {f"_f{j}": [p[j] for p in first] for j in range(len(coords))} | {f"_m{j}": [p[j] for p in centre] for j in range(len(coords))}
    return pdf.assign(**more, _mass=mass), leaders.front(points[-1][0])


def _fronts(long: DataFrame, unit: list[str], by: list[str], coords: list[str], tolerance: float) -> DataFrame:
    """``unit``…, _in: the front every slice of a cut patch starts with. All slices are scanned at once; a slice whose front turned
    out different is scanned again until none is. The first slice is right at once and each round makes at least one more right."""
    keys = T.StructType([long.schema[c] for c in unit])
    schema = T.StructType([*keys.fields, T.StructField("_in", T.ArrayType(T.DoubleType())), T.StructField("_out", T.ArrayType(T.DoubleType()))])

    def scan(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        front = [] if start.empty else [float(x) for x in start["_new"].iloc[0]]
        out = pdf[unit].head(1).copy()
        out["_in"], out["_out"] = [front], [_scan_slice(pdf, by, coords, tolerance, front)[1]]
        return out

    nothing = F.array().cast("array<double>")
    todo = stored(long.select(*unit).distinct().withColumn("_new", nothing))
    state = None
    while not is_empty(todo):
        redone = long.join(todo.select(*unit), unit, "left_semi").groupBy(*unit).cogroup(todo.groupBy(*unit)).applyInPandas(scan, schema)
        state = stored(redone if state is None else state.filter("_in <=> _new").select(*unit, "_in", "_out").unionByName(redone))
        handed = state.select(*unit[:-1], (F.col(unit[-1]) + 1).alias(unit[-1]), F.col("_out").alias("_new"))
        met = state.unionByName(handed, allowMissingColumns=True).groupBy(*unit).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("_in", "_out", "_new")))
        state = stored(met.filter("_in is not null").withColumn("_new", F.coalesce("_new", nothing)))
        todo = state.filter("not (_in <=> _new)").select(*unit, "_new")
    return todo.select(*unit, F.col("_new").alias("_in")) if state is None else state.select(*unit, "_in")


def leader_clusters(points: DataFrame, by: list[str], coords: list[str], tolerance: float, number: str = "cluster") -> DataFrame:
    """Scan points in coordinate order; each joins the nearest running-mean centre within tolerance, else starts one.

    Adds the cluster number (order of creation per key) and its centre. Equal points always share a cluster, so they are
    merged with a weight first. A joining point lies within 2*tolerance of the cluster's latest member, so points
    in unconnected 2*tolerance cells never meet: each connected patch of occupied cells is scanned on its own. Patches are cut
    into slices of bounded size, however large a patch is; a slice starts with the clusters the one before it leaves in reach.
    """
    size = 2.0 * tolerance
    merged = points.groupBy(*by, *coords).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    cell = F.array(*(F.floor(F.col(c) / size).cast("bigint") for c in coords))
    merged = merged.withColumn("_cell", cell)
    # patches only group the scan, so a 64-bit cell number is enough: a collision would merely scan two patches together
    number_of = lambda cell: F.xxhash64(*by, cell)
    merged = stored(merged.withColumn("_node", number_of(F.col("_cell"))))
    occupied = merged.select("_node").distinct()
    steps = [o for o in np.ndindex(*(3,) * len(coords))]
    ahead = [tuple(x - 1 for x in o) for o in steps if tuple(x - 1 for x in o) > (0,) * len(coords)]
    shift = F.array(*(F.array(*(F.lit(x).cast("bigint") for x in o)) for o in ahead))
    near = merged.select(*by, "_cell", "_node").distinct().select(*by, "_cell", F.col("_node").alias("u"), F.explode(shift).alias("_o"))
    near = near.select("u", number_of(F.zip_with("_cell", "_o", lambda a, b: a + b)).alias("_node"))
    links = near.join(occupied, "_node").select("u", F.col("_node").alias("v"))
    patch = components(links).select(F.col("node").alias("_node"), F.col("component").alias("_patch"))
    merged = merged.join(patch, "_node", "left").withColumn("_patch", F.coalesce("_patch", "_node"))
    placed = stored(merged.drop("_cell", "_node"))
    slices = placed.count() // SLICE_ROWS + 1
    # every bound is a row, so the slices of a patch have consecutive numbers
    placed = stored(placed.repartitionByRange(slices, *by, "_patch", *coords).withColumn("_slice", F.spark_partition_id()))
    extra = [T.StructField(f"_{x}{j}", T.DoubleType()) for x in "fm" for j in range(len(coords))] + [T.StructField("_mass", T.DoubleType())]
    schema = T.StructType(placed.schema.fields + extra)
    unit = [*by, "_patch", "_slice"]
    cut = placed.groupBy(*by, "_patch").agg(F.min("_slice").alias("a"), F.max("_slice").alias("b")).filter("a < b").select(*by, "_patch")
    # whole patches share a bucket, so Python is entered once per bucket and not once per patch
    bucket = F.pmod(F.xxhash64(*by, "_patch"), F.lit(max(8, slices)))
    whole = placed.join(cut, by + ["_patch"], "left_anti").withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(
        lambda pdf: _scan_slice(pdf.drop(columns="_bucket"), by, coords, tolerance, [])[0], schema)
    long = stored(placed.join(cut, by + ["_patch"], "left_semi"))
    fronts = _fronts(long, unit, by, coords, tolerance)

    def last(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return _scan_slice(pdf, by, coords, tolerance, [float(x) for x in start["_in"].iloc[0]])[0]

    joined = stored(whole.unionByName(long.groupBy(*unit).cogroup(fronts.groupBy(*unit)).applyInPandas(last, schema)))
    firsts, means = [f"_f{j}" for j in range(len(coords))], [f"_m{j}" for j in range(len(coords))]
    # a cluster is known by its first point; the slice that saw it last has its centre
    heads = joined.groupBy(*by, *firsts).agg(F.max(F.struct("_mass", *means)).alias("m"))
    ranked = rank_rows(heads, by, firsts, number).select(*by, *firsts, number, *(F.col(f"m.{m}").alias(f"centre_{c}") for m, c in zip(means, coords)))
    labelled = joined.select(*by, *coords, *firsts).join(ranked, by + firsts).drop(*firsts)
    return points.join(labelled, by + coords)


def cluster_endpoints(endpoints: DataFrame, tolerance: float, view: str = "view_id", row: str = "row", col: str = "col") -> DataFrame:
    """Endpoint observations per view, ids ``view:obs-000001`` in order of creation."""
    out = leader_clusters(endpoints, [view], [row, col], tolerance, "_number")
    return out.withColumn("obs_id", F.concat(F.col(view), F.lit(":obs-"), F.lpad(F.col("_number").cast("string"), 6, "0"))).drop("_number")


def split_modes(records: DataFrame, separation: float | None, component: str = "component") -> DataFrame:
    """Mode key per record: explicit hints apart, the rest one mode, or clustered by provisional point."""
    hinted = records.filter(F.col("mode_id") != "").withColumn("mode_key", F.concat(F.lit("hint:"), "mode_id"))
    auto = records.filter(F.col("mode_id") == "")
    if separation is None:
        auto = auto.withColumn("mode_key", F.lit("auto:1"))
    else:
        auto = leader_clusters(auto, [component], ["pair_x", "pair_y", "pair_z"], separation, "_number")
        auto = auto.withColumn("mode_key", F.concat(F.lit("auto:"), F.col("_number"))).drop("_number", "centre_pair_x", "centre_pair_y", "centre_pair_z")
    return hinted.unionByName(auto)


# --- cycles ----------------------------------------------------------------------------------

def triangles(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Closed triples u < v < w of accepted edges. Edges are oriented from lower to higher degree, so a hub never
    pairs up all its neighbours."""
    e = edges.select(*scope, F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).filter("lo <> hi").distinct()
    deg = e.select(*scope, F.explode(F.array("lo", "hi")).alias("n")).groupBy(*scope, "n").agg(F.count(F.lit(1)).alias("d"))
    d1 = deg.select(*scope, F.col("n").alias("lo"), F.col("d").alias("dl"))
    d2 = deg.select(*scope, F.col("n").alias("hi"), F.col("d").alias("dh"))
    o = e.join(d1, scope + ["lo"]).join(d2, scope + ["hi"])
    up = F.struct("dl", "lo") < F.struct(F.col("dh").alias("dl"), F.col("hi").alias("lo"))
    o = stored(o.select(*scope, F.when(up, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("b")))
    left = o.select(*scope, "a", F.col("b").alias("b1"))
    right = o.select(*scope, "a", F.col("b").alias("b2"))
    wedge = left.join(right, scope + ["a"]).filter("b1 < b2")
    closing = e.select(*scope, F.col("lo").alias("b1"), F.col("hi").alias("b2"))
    t = wedge.join(closing, scope + ["b1", "b2"])
    s = F.array_sort(F.array("a", "b1", "b2"))
    return t.select(*scope, s[0].alias("n1"), s[1].alias("n2"), s[2].alias("n3"))
