"""Match ledgers: marking filters that keep every row and record why it was rejected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raytable.runtime import is_empty, materialize

from .quantiles import attach, median, median_mad

MAD_TO_SIGMA = 1.4826
# stages that record a mask but do not decide acceptance
NEUTRAL_STAGES = ("spatialSelection", "solverObservation", "residualAccepted")
# fixed reason text where it differs from the stage name
STAGE_REASON = {"spatialSelection": "spatialRedundancy"}


def start_ledger(df: DataFrame) -> DataFrame:
    return (df.withColumn("accepted", F.lit(True)).withColumn("state", F.lit("accepted"))
            .withColumn("first_rejected_stage", F.lit(""))
            .withColumn("rejection_reasons", F.array().cast("array<string>")))


def apply_stage(df: DataFrame, stage: str, mask: Column) -> DataFrame:
    """Record one stage: mask column, first rejecting stage, ordered-unique reasons, state."""
    name = f"mask_{stage}"
    df = df.withColumn(name, F.coalesce(mask, F.lit(False)))
    reason = STAGE_REASON.get(stage, stage)
    dropped = F.col("accepted") & ~F.col(name)
    df = (df.withColumn("first_rejected_stage",
                        F.when(dropped & (F.col("first_rejected_stage") == ""), reason).otherwise(F.col("first_rejected_stage")))
          .withColumn("rejection_reasons",
                      F.when(dropped, F.array_union("rejection_reasons", F.array(F.lit(reason)))).otherwise(F.col("rejection_reasons"))))
    if stage not in NEUTRAL_STAGES:
        df = (df.withColumn("state", F.when(F.col(name), "accepted").otherwise("rejected"))
              .withColumn("accepted", F.col(name)))
    return df


Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def filter_pipeline(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Run stages in order; each callable adds a boolean ``_mask`` given the live rows (``accepted``)."""
    df = start_ledger(df)
    for name, fn in stages:
        df = fn(df)
        df = apply_stage(df, name, F.col("accepted") & F.col("_mask")).drop("_mask")
    return df


def stage_counts(ledger: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Survivors after every stage in one aggregation."""
    return ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("initial"),
        *(F.count_if(f"mask_{s}").alias(s) for s in stages),
        F.count_if("accepted").alias("final"))


def stage_funnel(counts: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Stage counts as rows: key, position, stage, survivors."""
    names = ["initial", *stages, "final"]
    rows = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("stage"), F.col(n).alias("survivors"))
                     for i, n in enumerate(names)))
    return counts.select(*by, F.inline(rows))


# --- masks -------------------------------------------------------------------------

def score_of(metric: Column) -> Column:
    return 1 / (1 + metric)


def score_mask(df: DataFrame, score: Column, minimum: float | None) -> DataFrame:
    return df.withColumn("_mask", F.lit(True) if minimum is None else score >= minimum)


def ratio_mask(df: DataFrame, metric: Column, maximum: float | None) -> DataFrame:
    return df.withColumn("_mask", F.lit(True) if maximum is None else metric <= maximum)


def overlap_mask(df: DataFrame, cells: DataFrame, moving: tuple[Column, Column], reference: tuple[Column, Column],
                 by: list[str] | None = None) -> DataFrame:
    """Both endpoints, rounded to the nearest cell, fall on a true mask cell (cells: by…, r, c; one row per true cell)."""
    by = by or []
    nearest = lambda v: F.floor(v + 0.5).cast("bigint")
    for tag, (row, col) in (("m", moving), ("r", reference)):
        hit = cells.select(*by, F.col("r").cast("bigint").alias(f"_{tag}r"), F.col("c").cast("bigint").alias(f"_{tag}c"),
                           F.lit(True).alias(f"_{tag}hit")).distinct()
        df = df.withColumn(f"_{tag}r", nearest(row)).withColumn(f"_{tag}c", nearest(col))
        df = df.join(hit, by + [f"_{tag}r", f"_{tag}c"], "left")
    return (df.withColumn("_mask", F.coalesce("_mhit", F.lit(False)) & F.coalesce("_rhit", F.lit(False)))
            .drop("_mr", "_mc", "_rr", "_rc", "_mhit", "_rhit"))


def mad_displacement(df: DataFrame, by: list[str], dx: Column, dy: Column, scale: float = 3.0, floor: float = 1.0,
                     maximum: float | None = None) -> DataFrame:
    """Distance to the group's median displacement against median + k * max(1.4826 MAD, floor)."""
    df = df.withColumn("_dx", dx).withColumn("_dy", dy)
    live = materialize(df.select(*by, "_dx", "_dy", "accepted")).filter("accepted")
    mx = median(live, by, F.col("_dx"), "_mdx").withColumnRenamed("_n", "_live")
    my = median(live, by, F.col("_dy"), "_mdy").drop("_n")
    df = attach(attach(df, mx, by), my, by)
    df = df.withColumn("_res", F.hypot(F.col("_dx") - F.col("_mdx"), F.col("_dy") - F.col("_mdy")))
    spread = median_mad(materialize(df.select(*by, "_res", "accepted")).filter("accepted"), by, F.col("_res")).drop("_n")
    df = attach(df, spread, by)
    limit = F.col("median") + scale * F.greatest(MAD_TO_SIGMA * F.col("mad"), F.lit(float(floor)))
    ok = F.col("_res") <= limit
    if maximum is not None:
        ok = ok & (F.hypot("_dx", "_dy") <= maximum)
    few = F.coalesce("_live", F.lit(0)) < 3
    return df.withColumn("_mask", few | F.coalesce(ok, F.lit(False))).drop(
        "_dx", "_dy", "_mdx", "_mdy", "_res", "median", "mad", "_live")


def coplanarity_filter(df: DataFrame, by: list[str], residual: Column, scale: float = 3.0, floor: float = 1e-3,
                       maximum: float | None = None) -> DataFrame:
    """Centred residual filter; groups with fewer than three valid residuals keep their valid rows only."""
    df = df.withColumn("_cop", residual)
    # pinned before filtering: a predicate on the residual must not be pushed into its own expression
    valid = materialize(df.select(*by, "_cop", "accepted")).filter(F.col("accepted") & F.col("_cop").isNotNull())
    stats = median_mad(valid, by, F.col("_cop")).withColumnRenamed("_n", "_valid")
    df = attach(df, stats, by)
    limit = scale * F.greatest(MAD_TO_SIGMA * F.col("mad"), F.lit(float(floor)))
    if maximum is not None:
        limit = F.least(limit, F.lit(float(maximum)))
    inside = F.abs(F.col("_cop") - F.col("median")) <= limit
    ok = F.when(F.col("_cop").isNull(), False).when(F.coalesce("_valid", F.lit(0)) < 3, True).otherwise(inside)
    return df.withColumn("_mask", F.coalesce(ok, F.lit(False))).drop("_cop", "median", "mad", "_valid")


def roi_stage(ledger: DataFrame, rect: tuple[float, float, float, float], x: str, y: str) -> DataFrame:
    """Mark rows whose plane coordinates lie inside a closed rectangle (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = rect
    return apply_stage(ledger, "roi", F.col("accepted") & F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def curation_stage(ledger: DataFrame, edits: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Latest edit per record decides (enabled / disabled / deleted); adds ``edge_eligible``.

    A manual state is kept whether or not an earlier stage rejected the row; only enabled, accepted rows are eligible.
    """
    latest = edits.groupBy(id_col).agg(F.max_by("action", "seq").alias("_action"))
    df = ledger.join(latest, id_col, "left")
    keep = F.coalesce(F.col("_action") == "enabled", F.lit(True))
    df = apply_stage(df, "manual", F.col("accepted") & keep)
    state = F.when(F.col("_action").isin("disabled", "deleted"), F.col("_action")).otherwise(F.col("state"))
    return df.withColumn("state", state).withColumn("edge_eligible", F.col("accepted")).drop("_action")


def custom_mask(df: DataFrame, fn: Callable[[DataFrame], Column]) -> DataFrame:
    """User predicate over the ledger; it must give a boolean column."""
    out = df.withColumn("_mask", fn(df))
    if out.schema["_mask"].dataType.simpleString() != "boolean":
        raise TypeError("a custom mask must be boolean")
    return out


def unique_match_mask(df: DataFrame, by: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """One-to-one rows: scanning in ``order``, a row is kept iff neither feature was used by a kept row.

    Exact by rounds: a row that comes first for both of its features can be decided at once; rows that
    share a feature with a kept row are rejected. ``order`` must be unique per key.
    """
    key = F.struct(*order)
    live = df.select(*by, left, right, *order)
    kept = None
    while True:
        ranked = live.withColumn("_k", key)
        first_l = ranked.groupBy(*by, left).agg(F.min("_k").alias("_kl"))
        first_r = ranked.groupBy(*by, right).agg(F.min("_k").alias("_kr"))
        won = materialize(ranked.join(first_l, by + [left]).filter("_k = _kl").join(first_r, by + [right])
                          .filter("_k = _kr").select(*by, left, right, *order))
        if is_empty(won):
            break
        kept = won if kept is None else kept.unionByName(won)
        live = materialize(live.join(won.select(*by, left), by + [left], "left_anti")
                           .join(won.select(*by, right), by + [right], "left_anti"))
    if kept is None:
        return df.withColumn("_mask", F.lit(False))
    flags = kept.select(*by, *order, F.lit(True).alias("_hit"))
    return df.join(flags, by + order, "left").withColumn("_mask", F.coalesce("_hit", F.lit(False))).drop("_hit")


def unique_match_mask_one_sided(df: DataFrame, by: list[str], right: str, order: list[str]) -> DataFrame:
    """Same, when the other side is already unique per key: the first row of each feature."""
    first = df.groupBy(*by, right).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, by + [right]).withColumn("_mask", F.struct(*order) == F.col("_first")).drop("_first")


# --- residuals and decisions -----------------------------------------------------------

LOSS_COLUMNS = {"projectionPlane2D": "plane", "rayToRay3D": "ray", "epipolarCoplanarity": "coplanarity"}


def attach_residuals(ledger: DataFrame, residuals: DataFrame, loss: str, id_col: str = "record_id") -> DataFrame:
    """Join solver before/after residuals and copy them to the column pair named by the loss."""
    if loss not in LOSS_COLUMNS:
        raise ValueError(f"unknown loss mode {loss!r}")
    res = residuals.select(id_col, F.col("before").alias("active_before"), F.col("after").alias("active_after"),
                           F.lit(True).alias("_solver"))
    df = ledger.join(res, id_col, "left")
    df = apply_stage(df, "solverObservation", F.coalesce("_solver", F.lit(False)))
    df = df.withColumn("state", F.when(F.col("mask_solverObservation"), "solverObservation").otherwise(F.col("state")))
    df = df.withColumn("active_loss", F.when(F.col("mask_solverObservation"), loss))
    for mode, prefix in LOSS_COLUMNS.items():
        for side in ("before", "after"):
            df = df.withColumn(f"{prefix}_{side}", F.col(f"active_{side}") if mode == loss else F.lit(None).cast("double"))
    return df.drop("_solver")


def combine_ledgers(*ledgers: DataFrame) -> DataFrame:
    out = ledgers[0]
    for df in ledgers[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def precheck(records: DataFrame, angle: float = 0.1, texture: float = 0.05, navigation: float = 0.05,
             radiometric: float = 0.05) -> DataFrame:
    """First failing rule of eight names the reason; '' means the record may become a graph edge."""
    reason = (F.when(F.col("match_state") != "valid", F.concat(F.lit("matchState:"), F.col("match_state")))
              .when(~(F.col("consistent_a") & F.col("consistent_b")), "observationIdentityConflict")
              .when(~F.col("pair_forward_valid"), "pairForwardInvalid")
              .when(F.col("pair_angle_degrees") < angle, "nearlyParallel")
              .when(F.col("texture") < texture, "insufficientTexture")
              .when(F.least("nav_a", "nav_b") < navigation, "weakNavigation")
              .when(F.col("radiometric") < radiometric, "radiometricInconsistent")
              .when((F.col("visibility_a") == "occluded") | (F.col("visibility_b") == "occluded"), "visibilityConflict")
              .otherwise(""))
    return df_state(records.withColumn("association_reason", reason))


def df_state(df: DataFrame) -> DataFrame:
    return df.withColumn("association_state", F.when(F.col("association_reason") == "", "candidate").otherwise("rejected"))


def select_points(points: DataFrame, roi: dict[str, tuple[float, float]], valid: Column | None = None) -> DataFrame:
    """Region and validity selection with an explicit rejection reason per row ('' = selected)."""
    inside = F.lit(True)
    for name, (lo, hi) in roi.items():
        inside = inside & F.col(name).between(lo, hi)
    reason = F.when(~(F.lit(True) if valid is None else valid), "invalidPoint")
    for name in roi:
        reason = reason.when(F.col(name).isNull() | F.isnan(name), "nonfinitePoint")
    return points.withColumn("selection_reason", reason.when(~inside, "outsideRoi").otherwise(""))


def select_points_for_grid(points: DataFrame, excluded: DataFrame, surface: str = "surface_height",
                           id_col: str = "point_id") -> DataFrame:
    """Registration selection: invalid point, missing covariance, explicit exclusion, outside the grid."""
    df = points.join(excluded.select(id_col, F.lit(True).alias("_ex")).distinct(), id_col, "left")
    reason = (F.when(~F.col("valid"), "invalidPoint").when(F.col("sigma").isNull(), "missingCovariance")
              .when(F.col("_ex"), "explicitExclusion").when(F.col(surface).isNull(), "outsideGrid").otherwise(""))
    return df.withColumn("selection_reason", reason).drop("_ex")


def uncertainty_filter(points: DataFrame, sigma: str, limit: float) -> DataFrame:
    """View of a product: finite and at most the limit; the source is untouched."""
    return points.filter(F.col(sigma).isNotNull() & ~F.isnan(sigma) & (F.col(sigma) <= limit))


CANDIDATE_CHECKS = (("overlap", "insufficientOverlap"), ("conditioning", "weakConditioning"),
                    ("texture", "insufficientTexture"), ("radiometric", "radiometricMismatch"),
                    ("visibility", "insufficientVisibility"))


def classify_candidates(df: DataFrame, minimums: dict[str, float], forced_in: DataFrame | None = None,
                        forced_out: DataFrame | None = None, held_out_view: Column | None = None) -> DataFrame:
    """Decision and reason per candidate pair: overrides, then held-out view, then the first failing check."""
    for name, ids in (("_out", forced_out), ("_in", forced_in)):
        if ids is None:
            df = df.withColumn(name, F.lit(False))
        else:
            df = df.join(ids.select("pair_id", F.lit(True).alias(name)).distinct(), "pair_id", "left")
            df = df.withColumn(name, F.coalesce(name, F.lit(False)))
    held = F.lit(False) if held_out_view is None else F.coalesce(
        (F.col("view_a") == held_out_view) | (F.col("view_b") == held_out_view), F.lit(False))
    failed = F.lit(None).cast("string")
    for name, reason in reversed(CANDIDATE_CHECKS):
        failed = F.when(~(F.col(name) >= minimums.get(name, float("-inf"))), reason).otherwise(failed)
    df = df.withColumn("_failed", failed)
    return (df.withColumn("decision", F.when(F.col("_out"), "rejected").when(F.col("_in"), "selected")
                          .when(held, "validation").when(F.col("_failed").isNotNull(), "rejected").otherwise("selected"))
            .withColumn("selection_reason", F.when(F.col("_out"), "operatorExcluded").when(F.col("_in"), "operatorIncluded")
                        .when(held, "reservedValidationView").otherwise(F.coalesce("_failed", F.lit("qualityRank"))))
            .withColumn("forced", F.col("_out") | F.col("_in")).drop("_out", "_in", "_failed"))


def safe_policy(df: DataFrame, hard_minimum: int = 3, preferred_minimum: int = 8, fail_on_bound: bool = True,
                degradation: float = 0.05, improvement: float = 0.0, enabled: bool = True) -> DataFrame:
    """Hard reasons and warnings per solve, and the decision passed / review / rejected / disabled."""
    before, after, n = F.col("rms_before"), F.col("rms_after"), F.col("min_match_count")
    degraded = F.when(before > 2.220446049250313e-16, (after - before) / before > degradation).otherwise(
        after > 1.4901161193847656e-08)
    gain = F.when(before > 2.220446049250313e-16, (before - after) / before)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    hard = F.array(
        F.when(no(F.col("converged")), "notConverged"),
        F.when(before.isNull() | after.isNull(), "residualStateMissing"),
        F.when(n < hard_minimum, "tooFewObservations"),
        F.when(F.lit(fail_on_bound) & F.col("bound_hit"), "boundHit"),
        F.when(F.col("unobservable"), "unobservableMode"),
        F.when(F.coalesce(degraded, F.lit(False)), "residualDegraded"))
    warn = F.array(
        F.when((n >= hard_minimum) & (n < preferred_minimum), "fewObservations"),
        F.when(no(degraded) & (gain < improvement), "smallImprovement"))
    df = (df.withColumn("hard_reasons", F.array_compact(hard)).withColumn("warnings", F.array_compact(warn)))
    decision = (F.lit("disabled") if not enabled else
                F.when(F.size("hard_reasons") > 0, "rejected").when(F.size("warnings") > 0, "review").otherwise("passed"))
    return df.withColumn("decision", decision).withColumn("apply_allowed", F.col("decision") != "rejected")
