"""View tables: pairs by footprint overlap, pair graphs, schedules, sequences and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raytable.functions.geometry import Plane, intersect_plane
from raytable.functions.scalars import pair_id
from raytable.functions.vec import Vec, acos_degrees
from raytable.runtime import is_empty, materialize, stored

from .graph import spanning_forest
from .ordered import rank_rows


def footprints(corner_rays: DataFrame, plane: Plane, view: str = "view_id") -> DataFrame:
    """Bounding box of each view's corner rays on a plane; at least three hits and a non-empty box, else unavailable."""
    hit = intersect_plane(corner_rays, Vec.prefixed("o"), Vec.prefixed("d"), plane).withColumn("_ok", F.col("valid"))
    g = hit.groupBy(view).agg(F.count_if("_ok").alias("hits"), F.min("plane_x").alias("x0"), F.max("plane_x").alias("x1"),
                              F.min("plane_y").alias("y0"), F.max("plane_y").alias("y1"))
    ok = (F.col("hits") >= 3) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    g = g.withColumn("available", F.coalesce(ok, F.lit(False)))
    return g.select(view, "hits", "available", *(F.when(F.col("available"), F.col(c)).alias(c) for c in ("x0", "x1", "y0", "y1")))


def view_pairs(views: DataFrame, cell: float) -> DataFrame:
    """Unordered view pairs whose footprints overlap, with overlap = shared area / smaller area.

    Footprints are cut into grid cells and joined per cell; a pair is emitted only in the cell holding the lower
    corner of its intersection, so there is no duplicate and no all-pairs product. Pairs without overlap (which can
    only be rejected) are not listed.
    """
    floor = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    span = lambda a, b: F.sequence(floor(a), floor(b))
    cells = views.select("view_id", "position", "x0", "x1", "y0", "y1", F.explode(span("x0", "x1")).alias("_cx"), "pass_id", "pixel_count")
    cells = cells.withColumn("_cy", F.explode(span("y0", "y1")))
    a, b = (cells.select("_cx", "_cy", *(F.col(c).alias(f"{c}_{s}") for c in ("view_id", "position", "x0", "x1", "y0", "y1", "pass_id", "pixel_count"))) for s in "ab")
    p = a.join(b, ["_cx", "_cy"]).filter("position_a < position_b")
    for c, f in (("x0", F.greatest), ("y0", F.greatest), ("x1", F.least), ("y1", F.least)):
        p = p.withColumn("_" + c, f(f"{c}_a", f"{c}_b"))
    own = (F.floor(F.col("_x0") / cell) == F.col("_cx")) & (F.floor(F.col("_y0") / cell) == F.col("_cy"))
    p = p.filter(own & (F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0")))
    area = lambda s: (F.col(f"x1_{s}") - F.col(f"x0_{s}")) * (F.col(f"y1_{s}") - F.col(f"y0_{s}"))
    overlap = (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")) / F.least(area("a"), area("b"))
    return p.select(F.col("view_id_a").alias("view_a"), F.col("view_id_b").alias("view_b"), "position_a", "position_b", "pass_id_a", "pass_id_b",
                    "pixel_count_a", "pixel_count_b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), overlap)).alias("overlap"))


def score_pairs(pairs: DataFrame, geometry: Column | None = None, radiometric: Column | None = None) -> DataFrame:
    """Seven-term quality of a candidate pair; unknown geometry and radiometry count one half."""
    sep = F.abs(F.col("position_b") - F.col("position_a"))
    same = F.col("pass_id_a") == F.col("pass_id_b")
    near = F.try_divide(F.lit(1.0), sep)
    temporal = F.when(same, near).otherwise(F.greatest(near, F.lit(0.75)))
    geo = F.lit(0.5) if geometry is None else F.coalesce(geometry, F.lit(0.5))
    rad = F.lit(0.5) if radiometric is None else F.coalesce(radiometric, F.lit(0.5))
    quality = 0.30 * F.col("overlap") + 0.20 * geo + 0.15 * temporal + 0.15 * rad + 0.10 * near + 0.05 * 0.5 + 0.05 * 0.5
    return (pairs.withColumn("pair_id", pair_id(F.col("view_a"), F.col("view_b"), checked=False)).withColumn("separation", sep).withColumn("same_pass", same)
            .withColumn("quality", quality).withColumn("cost", (F.col("pixel_count_a") + F.col("pixel_count_b")) / 1e6))


def axis_geometry(a: Vec, b: Vec) -> Column:
    """Sine of the angle between optical axes, capped at 90 degrees."""
    return F.sin(F.radians(F.least(acos_degrees(a.dot(b)), F.lit(90.0))))


def apply_overrides(candidates: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Forced inclusion and exclusion by pair id; unknown ids are an error."""
    ids = include.select("pair_id").unionByName(exclude.select("pair_id")).distinct()
    if not is_empty(ids.join(candidates.select("pair_id"), "pair_id", "left_anti")):
        raise ValueError("forced pair ids must identify candidate pairs")
    df = candidates.join(include.select("pair_id", F.lit(True).alias("_in")).distinct(), "pair_id", "left")
    df = df.join(exclude.select("pair_id", F.lit(True).alias("_out")).distinct(), "pair_id", "left")
    out = F.coalesce("_out", F.lit(False))
    return (df.withColumn("plausible", ~out).withColumn("forced", out | F.coalesce("_in", F.lit(False)))
            .withColumn("rejection_reason", F.when(out, "excludedByOperator").otherwise("")).drop("_in", "_out"))


def pair_graph(candidates: DataFrame, view_count: int, policy: str = "balanced", max_pairs: int | None = None) -> DataFrame:
    """Select pairs: forced edges, a maximum spanning forest by quality, then loop chords; every pair gets a state and reason.

    candidates: pair_id, view_a, view_b, quality, separation, same_pass, pass_id_a/b, plausible, forced, rejection_reason.
    """
    c = materialize(candidates)
    live = c.filter("plausible").withColumn("_force", F.col("forced").cast("int"))
    counts = live.agg(F.count(F.lit(1)).alias("n"), F.sum("_force").alias("f")).first()
    budget = min(counts["n"], max_pairs) if max_pairs is not None else counts["n"]
    if (counts["f"] or 0) > budget:
        raise ValueError("forced inclusions exceed the maximum pair count")
    order = [(-F.col("_force")).alias("f"), (-F.col("quality")).alias("q")]
    tree = spanning_forest(live.withColumnRenamed("pair_id", "edge_id"), order, "view_a", "view_b").withColumnRenamed("edge_id", "pair_id")
    base = live.join(tree.withColumn("_tree", F.lit(True)), "pair_id", "left").withColumn("_tree", F.coalesce("_tree", F.lit(False)))
    picked = base.filter("_tree or forced").orderBy(F.desc("_force"), F.desc("quality"), "pair_id").limit(budget)
    picked = materialize(picked.withColumn("role", F.when(F.col("_tree"), "tree").otherwise("chord")).withColumn(
        "selection_reason", F.when(F.col("forced") & F.col("_tree"), "forcedTree").when(F.col("forced"), "forcedChord").otherwise("qualitySpanningForest")))
    taken = picked.count()
    extra = {"fast": 0, "balanced": max(1, -(-view_count // 3)), "quality": max(1, view_count), "all": counts["n"]}[policy]
    target = min(taken + extra, counts["n"], budget)
    chords = select_chords(live, picked, view_count, target - taken)
    sel = picked.select("pair_id", "role", "selection_reason").unionByName(
        chords.select("pair_id", F.lit("chord").alias("role"), F.lit("loopClosingQuality").alias("selection_reason")))
    full = taken + max(0, target - taken) >= budget
    left_over = "budgetLimit" if full else "qualityPolicy"
    out = c.join(sel, "pair_id", "left")
    chosen = F.col("role").isNotNull()
    return (out.withColumn("state", F.when(chosen, "selected").otherwise("rejected"))
            .withColumn("rejection_reason", F.when(chosen, "").when(F.col("plausible"), left_over).otherwise(F.col("rejection_reason"))))


def _spread(d: DataFrame) -> DataFrame:
    """Candidates with their base score and what their score depends on: two uses of each view and cross-pass pair, one of a separation."""
    passes = F.concat_ws("|", F.least("pass_id_a", "pass_id_b"), F.greatest("pass_id_a", "pass_id_b"))
    use = lambda tag, c, room: F.struct(F.concat(F.lit(tag), c.cast("string")).alias("use"), F.lit(room).alias("room"))
    plain = [use("v", F.col("view_a"), 2), use("v", F.col("view_b"), 2), use("s", F.col("separation"), 1)]
    uses = F.when(~F.col("same_pass"), F.array(*plain, use("p", passes, 2))).otherwise(F.array(*plain))
    return d.withColumn("_uses", F.filter(uses, lambda u: u["use"].isNotNull()))


def select_chords(candidates: DataFrame, selected: DataFrame, view_count: int, wanted: int) -> DataFrame:
    """Best-scoring chords one after another, scores refreshed after every choice; equal to the sequential choice.

    A score depends on earlier choices only through the uses left of its views, its pass pair and its separation, and it
    can only fall. So the sequence runs down the final scores, ties by pair id, and a candidate's score is final as soon
    as, at each of these, fewer open candidates stand before it than uses are left. A round settles all such candidates at
    once; candidates whose uses are all spent settle at once however many they are. Rounds end when as many as
    wanted are settled above everything open; candidates that fell below that many are dropped from later rounds.
    Only counts and one bound reach the driver. A NULL score comes last.
    """
    pool = _spread(candidates.join(selected.select("pair_id"), "pair_id", "left_anti").withColumn("separation", F.col("separation").cast("long")))
    base = F.col("quality") + 0.10 * F.least(F.lit(1.0), F.col("separation") / max(1, view_count - 1))
    pool = stored(pool.select("pair_id", "view_a", "view_b", "separation", "same_pass", "quality", base.alias("_base"), "_uses"))
    spent = _spread(selected).select(F.explode("_uses.use").alias("use")).groupBy("use").agg(F.count(F.lit(1)).alias("_n"))
    spent, live = stored(spent), pool.select("pair_id", "_base", "_uses")
    done = live.sparkSession.createDataFrame([], f"pair_id {pool.schema['pair_id'].dataType.simpleString()}, _score double")
    first = Window.partitionBy("use").orderBy(F.desc("_score"), "pair_id")
    while wanted > 0:
        e = live.select("*", F.explode("_uses").alias("_u")).join(spent.withColumnRenamed("use", "_use"), F.col("_u.use") == F.col("_use"), "left")
        left = F.col("_u.room") - F.coalesce("_n", F.lit(0))
        kind = F.substring("_u.use", 1, 1)
        s = e.groupBy("pair_id").agg(
            F.first("_base").alias("_base"), F.first("_uses").alias("_uses"), F.count_if((kind == "v") & (left > 0)).alias("_v"),
            F.count_if((kind == "p") & (left > 0)).alias("_p"), F.count_if((kind == "s") & (left <= 0)).alias("_s"),
            F.collect_list(F.when(left > 0, F.struct("_u.use", left.alias("left")))).alias("_left"))  # at most four
        score = F.col("_base") + 0.08 * F.col("_v") + F.when(F.col("_p") > 0, 0.08).otherwise(0.0) - F.when(F.col("_s") > 0, 0.05).otherwise(0.0)
        s = s.withColumn("_score", F.coalesce(score, F.lit(float("-inf"))))
        near = s.select("pair_id", "_score", F.inline("_left")).withColumn("_rn", F.row_number().over(first)).filter("_rn <= 2")
        near = near.filter(F.col("_rn") <= F.col("left")).groupBy("pair_id").agg(F.count(F.lit(1)).alias("_k"))
        s = s.join(near, "pair_id", "left").withColumn("_sure", F.size("_left") == F.coalesce("_k", F.lit(0)))
        s = stored(s.select("pair_id", "_base", "_uses", "_score", "_sure"))
        sure, live = s.filter("_sure"), s.filter("not _sure")
        top = live.agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("pair_id").alias("i"))).alias("t")).first()["t"]
        done = stored(done.unionByName(sure.select("pair_id", "_score")))
        neg = -F.col("_score")
        if top is None:
            break
        ahead = (neg < top["s"]) | ((neg == top["s"]) & (F.col("pair_id") < top["i"]))
        n = done.agg(F.count(F.lit(1)).alias("n"), F.count_if(ahead).alias("ahead")).first()
        if n["ahead"] >= wanted:
            break
        if n["n"] >= wanted:
            cut = done.agg(F.percentile_approx(neg, wanted / n["n"], 10000).alias("c")).first()["c"]
            if done.filter(neg <= cut).count() >= wanted:  # the bound is approximate, its use is not
                live, done = live.filter(neg <= cut), done.filter(neg <= cut)
        spent = stored(spent.unionByName(sure.select(F.explode("_uses.use").alias("use"), F.lit(1).cast("long").alias("_n"))).groupBy("use").agg(F.sum("_n").alias("_n")))
        live = live.select("pair_id", "_base", "_uses")
    ranked = rank_rows(done.withColumn("_neg", -F.col("_score")), [], ["_neg", "pair_id"]).filter(F.col("rn") <= wanted)
    return pool.drop("_base", "_uses").join(ranked.select("pair_id"), "pair_id", "left_semi")


def rank_candidates(candidates: DataFrame, weights: dict[str, float], maximum: int | None = None) -> DataFrame:
    """Weighted score; candidates beyond the budget are relabelled, not dropped."""
    score = sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    df = candidates.withColumn("score", score)
    if maximum is None:
        return df
    keep = df.filter("decision = 'selected'").orderBy(F.desc("score"), "pair_id").limit(maximum).select("pair_id", F.lit(True).alias("_keep"))
    df = df.join(keep, "pair_id", "left")
    over = (F.col("decision") == "selected") & F.col("_keep").isNull()
    return (df.withColumn("selection_reason", F.when(over, "pairBudget").otherwise(F.col("selection_reason")))
            .withColumn("decision", F.when(over, "rejected").otherwise(F.col("decision"))).drop("_keep"))


def validation_view(views: DataFrame, forced: DataFrame, position: str = "position") -> DataFrame:
    """Last view untouched by a forced pair; needs at least four views."""
    used = forced.select(F.explode(F.array("view_a", "view_b")).alias("view_id")).distinct()
    free = views.join(used, "view_id", "left_anti").agg(F.max_by("view_id", position).alias("view_id"))
    n = views.agg(F.count(F.lit(1)).alias("n"))
    df = n.crossJoin(F.broadcast(free))  # one row against one row
    return df.select(F.when(F.col("n") >= 4, F.col("view_id")).alias("view_id"),
                     F.when(F.col("n") < 4, "fewerThanFourViews").when(F.col("view_id").isNull(), "forcedIncludesUseEveryView")
                     .otherwise("stableHeldOutView").alias("reason"))


def schedule_pairs(views: DataFrame, strategy: str, reference: str, position: str = "position") -> DataFrame:
    """Ordered pairs over the view order: adjacentChain, centerOut, centerStar or hybrid (ordered union)."""
    ranked = materialize(rank_rows(views.select("view_id", position).withColumn("_one", F.lit(0)), ["_one"], [position, "view_id"], "p").select("view_id", "p"))
    nxt = ranked.select(F.col("view_id").alias("view_b"), (F.col("p") - 1).alias("p"))
    if strategy == "adjacentChain":
        return ranked.join(nxt, "p").select(F.col("p").alias("ord"), F.col("view_id").alias("view_a"), "view_b")
    ref = ranked.filter(F.col("view_id") == reference).select(F.col("view_id").alias("ref"), F.col("p").alias("rp"))
    others = ranked.crossJoin(F.broadcast(ref)).filter("p <> rp")  # the reference is one row
    d = F.abs(F.col("p") - F.col("rp"))
    others = others.withColumn("ord", 2 * d + F.when(F.col("p") < F.col("rp"), 0).otherwise(1))
    star = others.select("ord", F.col("view_id").alias("view_a"), F.col("ref").alias("view_b"))
    toward = others.withColumn("q", F.when(F.col("p") < F.col("rp"), F.col("p") + 1).otherwise(F.col("p") - 1))
    out = toward.join(ranked.select(F.col("p").alias("q"), F.col("view_id").alias("near")), "q").select("ord", F.col("view_id").alias("view_a"), F.col("near").alias("view_b"))
    if strategy == "centerStar":
        return star
    if strategy == "centerOut":
        return out
    if strategy == "hybrid":
        both = out.withColumn("part", F.lit(0)).unionByName(star.withColumn("part", F.lit(1)))
        first = both.groupBy(F.least("view_a", "view_b").alias("_l"), F.greatest("view_a", "view_b").alias("_h")).agg(
            F.min(F.struct("part", "ord", "view_a", "view_b")).alias("m"))
        return first.select((F.col("m.part") * 1000000000 + F.col("m.ord")).alias("ord"), F.col("m.view_a").alias("view_a"), F.col("m.view_b").alias("view_b"))
    raise ValueError(f"unknown strategy {strategy!r}")


def uncovered(views: DataFrame, selected: DataFrame) -> DataFrame:
    """Views touched by no selected pair."""
    return views.select("view_id").distinct().exceptAll(selected.select(F.explode(F.array("view_a", "view_b")).alias("view_id")).distinct().intersect(views.select("view_id")))


def preserved_modes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("mode_id").intersect(b.select("mode_id"))


def covering_pairs(pairs: DataFrame, order: list[str]) -> DataFrame:
    """A pair stays iff it is the first row holding one of its views."""
    key = F.struct(*order)
    firsts = pairs.select(F.explode(F.array("view_a", "view_b")).alias("view"), key.alias("_k")).groupBy("view").agg(F.min("_k").alias("_k")).select("_k").distinct()
    return pairs.withColumn("_k", key).join(firsts, "_k", "left_semi").drop("_k")


def resolve_ids(refs: DataFrame, dim: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Attach current rows to stable ids; an unknown or duplicated id fails the query."""
    d = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_hits"), *(F.first(a).alias(a) for a in attributes))
    df = refs.join(d, key, "left")
    ok = F.assert_true(F.coalesce(F.col("_hits") == 1, F.lit(False)), "id is unknown or not unique").isNull()
    return df.filter(ok).drop("_hits")


def plan_output_grid(layers: DataFrame, by: list[str], maximum_pixels: int = 100_000_000, target: tuple[int, int] | None = None) -> DataFrame:
    """Finest resolution candidate per group, bounds, size; optionally coarsened by powers of two and snapped.

    layers: by…, x0, x1, y0, y1, resolution (candidate, NULL or non-positive ignored).
    """
    good = F.when(F.col("resolution") > 0, F.col("resolution"))
    g = layers.groupBy(*by).agg(F.min(good).alias("resolution"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    g = g.filter(F.assert_true(F.col("resolution").isNotNull(), "no resolution candidate").isNull())
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    if target is not None:
        need = F.greatest(h / (max(target[0] - 1, 1) * F.col("resolution")), w / (max(target[1] - 1, 1) * F.col("resolution")))
        g = g.withColumn("resolution", F.when(need > 1, F.col("resolution") * F.pow(F.lit(2.0), F.ceil(F.log2(need)))).otherwise(F.col("resolution")))
        for c, f in (("x0", F.floor), ("x1", F.ceil), ("y0", F.floor), ("y1", F.ceil)):
            q = F.col(c) / F.col("resolution")
            g = g.withColumn(c, F.col("resolution") * F.when(F.abs(q - F.round(q)) <= 0.05, F.round(q)).otherwise(f(q)))
        g = g.withColumn("rows", F.round(h / F.col("resolution")).cast("bigint") + 1).withColumn("cols", F.round(w / F.col("resolution")).cast("bigint") + 1)
    else:
        g = g.withColumn("rows", F.greatest(F.lit(1), F.ceil(h / F.col("resolution")) + 1).cast("bigint"))
        g = g.withColumn("cols", F.greatest(F.lit(1), F.ceil(w / F.col("resolution")) + 1).cast("bigint"))
    return g.withColumn("within_cap", F.col("rows") * F.col("cols") <= maximum_pixels)


# --- sequences -------------------------------------------------------------------------------

def time_thirds(views: DataFrame, order: str = "event_id") -> DataFrame:
    """early / middle / late third per pass by time; layer order for a pass with any missing time."""
    timed = views.groupBy("pass_id").agg(F.bool_and(F.col("start_ts").isNotNull()).alias("_timed"))
    v = views.join(timed, "pass_id").withColumn("_t", F.when(F.col("_timed"), F.unix_micros("start_ts")).otherwise(F.lit(0)))
    r = rank_rows(v, ["pass_id"], ["_t", order], "_rn", total="_n")
    fr = (F.col("_rn") - 0.5) / F.col("_n")
    third = F.when(fr <= 1 / 3, "early").when(fr > 2 / 3, "late").otherwise("middle")
    return (r.withColumn("interval_id", F.concat_ws(":", "pass_id", third))
            .withColumn("basis", F.when(F.col("_timed"), "acquisitionTime").otherwise("layerOrderFallback")).drop("_t", "_rn", "_n", "_timed"))


def motion_sequence(views: DataFrame, order: str = "event_id", wrap: bool = False) -> DataFrame:
    """Frame position over passes (first appearance), time inside a pass or id order without comparable clocks; previous and next frame."""
    p = views.groupBy("pass_id").agg(F.min(order).alias("_first"), F.bool_and(F.col("start_ts").isNotNull()).alias("_timed"))
    v = views.join(p, "pass_id")
    v = (v.withColumn("_t", F.when(F.col("_timed"), F.unix_micros("start_ts")).otherwise(F.lit(0)))
         .withColumn("_s", F.when(F.col("_timed"), F.lpad(F.col(order).cast("string"), 20, "0")).otherwise(F.col("view_id"))).withColumn("_one", F.lit(0)))
    keys = ["_first", "_t", "_s"]
    r = materialize(rank_rows(v, ["_one"], keys, "position", total="_n").drop("_one"))
    link = r.select("position", "view_id")
    prev = link.select((F.col("position") + 1).alias("position"), F.col("view_id").alias("previous_view"))
    nxt = link.select((F.col("position") - 1).alias("position"), F.col("view_id").alias("next_view"))
    if wrap:
        n = r.agg(F.max("_n")).first()[0]
        prev = prev.withColumn("position", F.when(F.col("position") > n, 1).otherwise(F.col("position")))
        nxt = nxt.withColumn("position", F.when(F.col("position") < 1, n).otherwise(F.col("position")))
    out = r.join(prev, "position", "left").join(nxt, "position", "left")
    return out.withColumn("stable_fallback", ~F.col("_timed")).drop("_first", "_t", "_s", "_n", "_timed")
