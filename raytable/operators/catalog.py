"""Versioned corrections and product catalogs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raytable.functions.scalars import content_id
from raytable.runtime import is_empty, stored

from .ordered import lag_rows, last_known, rank_rows
from .quantiles import median
from .voxels import mode_centroid

# fixed values: what a position change makes stale, and what must run again
INVALIDATED = ("rawMatches", "filteredMatches", "alignmentSolve", "denseObservations", "multiRayPoints", "fusionProducts",
               "surfaceProducts", "demRegistration")
RECOMPUTE = ("alignmentMatch", "alignmentFilter", "alignmentSolve", "denseReconstruction", "surfaceFusion", "demRegistration")


def check_lifecycle(log: DataFrame) -> DataFrame:
    """Reason per log row: '' if the transition is legal after the same generation's previous one.

    propose starts a generation; accept needs the store's latest proposal; apply follows accept; revert follows apply;
    reject and supersede end a proposed or accepted generation.
    """
    df = lag_rows(log, ["store_id", "generation_id"], ["seq"], "transition", "_before")
    df = df.withColumn("_proposal", F.when(F.col("transition") == "propose", F.col("generation_id")))
    df = last_known(df, ["store_id"], ["seq"], "_proposal", "_current")
    t, b = F.col("transition"), F.col("_before")
    reason = (F.when((t == "propose") & b.isin("propose", "accept", "apply"), "alreadyActive")
              .when((t == "accept") & ~F.coalesce(b == "propose", F.lit(False)), "notProposed")
              .when((t == "accept") & (F.col("_current") != F.col("generation_id")), "notCurrentProposal")
              .when((t == "apply") & ~F.coalesce(b == "accept", F.lit(False)), "notAccepted")
              .when((t == "revert") & ~F.coalesce(b == "apply", F.lit(False)), "notApplied")
              .when(t.isin("reject", "supersede") & ~F.coalesce(b.isin("propose", "accept"), F.lit(False)), "notProposedOrAccepted")
              .otherwise(""))
    return df.withColumn("reason", reason).drop("_before", "_proposal", "_current")


def current(log: DataFrame, at: int | None = None) -> DataFrame:
    """Proposed, accepted and applied generation per store at a sequence number (point in time)."""
    seen = log if at is None else log.filter(F.col("seq") <= at)
    state = seen.groupBy("store_id", "generation_id").agg(F.max_by("transition", "seq").alias("t"), F.max("seq").alias("seq"))
    pick = lambda t: F.max_by(F.when(F.col("t") == t, F.col("generation_id")), F.when(F.col("t") == t, F.col("seq")))
    return state.groupBy("store_id").agg(pick("propose").alias("proposed"), pick("accept").alias("accepted"), pick("apply").alias("applied"))


def fingerprint(prefix: str = "geometry-") -> Column:
    return content_id(prefix, view=F.col("view_id"), x=F.col("x"), y=F.col("y"), z=F.col("z"))


def apply_correction(views: DataFrame, deltas: DataFrame, parent: str | None = None, expected_parent: str | None = None, sign: int = 1) -> DataFrame:
    """Add (or take back) per-view shifts: all scoped views must exist and the parent generation must match."""
    if parent != expected_parent:
        raise ValueError("correction parent does not match the current generation")
    if not is_empty(deltas.select("view_id").join(views.select("view_id"), "view_id", "left_anti")):
        raise ValueError("a scoped view is not in the scene")
    df = views.withColumn("fingerprint_before", fingerprint()).join(deltas.select("view_id", "dx", "dy", "dz", F.lit(True).alias("_in")), "view_id", "left")
    for c in "xyz":
        df = df.withColumn(c, F.col(c) + sign * F.coalesce(F.col("d" + c), F.lit(0.0)))
    return df.withColumn("corrected", F.coalesce("_in", F.lit(False))).withColumn("fingerprint_after", fingerprint()).drop("dx", "dy", "dz", "_in")


def revert(views: DataFrame, deltas: DataFrame) -> DataFrame:
    return apply_correction(views.drop("fingerprint_before", "fingerprint_after", "corrected"), deltas, sign=-1)


def invalidate(products: DataFrame, effect: Column) -> DataFrame:
    """Stale flag and required job of every product after a geometry change."""
    spark = products.sparkSession
    rows = [(k, True, k) for k in INVALIDATED]
    manifest = F.broadcast(spark.createDataFrame(rows, "kind string, _stale boolean, _k string"))  # eight fixed rows
    df = products.join(manifest, "kind", "left")
    job = (F.when(F.col("kind") == "rawMatches", RECOMPUTE[0]).when(F.col("kind") == "filteredMatches", RECOMPUTE[1]).when(F.col("kind") == "alignmentSolve", RECOMPUTE[2])
           .when(F.col("kind").isin("denseObservations", "multiRayPoints"), RECOMPUTE[3]).when(F.col("kind").isin("fusionProducts", "surfaceProducts"), RECOMPUTE[4])
           .when(F.col("kind") == "demRegistration", RECOMPUTE[5]))
    stale = F.coalesce("_stale", F.lit(False)) & effect
    return df.withColumn("stale", stale).withColumn("recompute", F.when(F.col("stale"), job)).drop("_stale", "_k")


CATALOG_FIELDS = ("point_id", "mode_id", "x", "y", "z", "uncertainty", "view_count", "pass_count")


def build_catalog(points: DataFrame, voxels: DataFrame, uncertainty_limit: float) -> DataFrame:
    """Products as one long table: raw, robust, uncertainty-filtered, fused centroids and voxels."""
    cast = lambda df: df.select("product", "point_id", "mode_id", "x", "y", "z", F.col("uncertainty").cast("double"), F.col("view_count").cast("bigint"), F.col("pass_count").cast("bigint"))
    raw = points.select(F.lit("raw-pairwise").alias("product"), "point_id", "mode_id", "x", "y", "z", F.col("sigma").alias("uncertainty"), F.lit(2).alias("view_count"), F.lit(1).alias("pass_count"))
    robust = points.filter("pass_count > 1").select(F.lit("robust-multi-view").alias("product"), "point_id", "mode_id", "x", "y", "z", F.col("sigma").alias("uncertainty"), (F.col("pass_count") + 1).alias("view_count"), "pass_count")
    limited = robust.filter(F.col("uncertainty") <= uncertainty_limit).withColumn("product", F.lit("uncertainty-filtered"))
    c = mode_centroid(points)
    fused = c.select(F.lit("fused").alias("product"), F.concat(F.lit("mode-"), "mode_id").alias("point_id"), "mode_id", "x", "y", "z", F.lit(None).alias("uncertainty"), F.col("views").alias("view_count"), F.col("passes").alias("pass_count"))
    vox = voxels.select(F.lit("voxel").alias("product"), "point_id", "mode_id", "x", "y", "z", F.sqrt(3 * F.col("variance")).alias("uncertainty"), F.col("views").alias("view_count"), F.col("passes").alias("pass_count"))
    out = cast(raw)
    for p in (robust, limited, fused, vox):
        out = out.unionByName(cast(p))
    return out


def product_stats(catalog: DataFrame, limit: float) -> DataFrame:
    """Counts, finite and filtered points and median uncertainty per product; the catalog is made once."""
    catalog = stored(catalog.select("product", "uncertainty"))
    s = catalog.groupBy("product").agg(F.count(F.lit(1)).alias("points"), F.count("uncertainty").alias("finite_uncertainty"),
                                       F.count_if(F.col("uncertainty") <= limit).alias("filtered_points"))
    return s.join(median(catalog, ["product"], F.col("uncertainty"), "median_uncertainty").drop("_n"), "product", "left")


def network_stats(points: DataFrame) -> DataFrame:
    """Views, passes, points, and median independent pass count of a network."""
    s = points.agg(F.count_distinct("view_id").alias("views"), F.count_distinct("pass_id").alias("passes"), F.count(F.lit(1)).alias("points"))
    return s.crossJoin(F.broadcast(median(points, [], F.col("pass_count"), "median_passes").drop("_n")))  # one row each


def work_estimate(stats: DataFrame, catalog_pairs: int, policy: str) -> DataFrame:
    """Scheduled pairs and relative work for a schedule policy."""
    potential = F.col("views") * F.greatest(F.col("views") - 1, F.lit(0)) / 2
    eligible = F.least(F.lit(catalog_pairs).cast("double"), potential)
    scheduled = {"fast": F.least(F.lit(1.0), eligible), "balanced": F.ceil(eligible / 2).cast("double"), "quality": eligible, "allPlausible": eligible}[policy]
    return stats.withColumn("potential_pairs", potential).withColumn("scheduled_pairs", scheduled).withColumn("work_units", F.col("scheduled_pairs") * F.greatest("points", F.lit(1)))


def registered_product(points: DataFrame, preview: DataFrame, variance: float) -> DataFrame:
    """Shifted points with added covariance and grid difference; the preview must cover every point."""
    df = points.join(preview.select("point_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), "dem_difference", F.lit(True).alias("_hit")), "point_id", "left")
    df = df.filter(F.assert_true(F.coalesce("_hit", F.lit(False)), "the preview must cover the whole point set").isNull())
    for c in "xyz":
        df = df.withColumn(c, F.col("_" + c))
    return (df.withColumn("uncertainty", F.sqrt(3 * (F.col("sigma") * F.col("sigma") + F.lit(float(variance))))).withColumn("fusion_method", F.lit("demRegistrationPreview"))
            .drop("_x", "_y", "_z", "_hit"))


def observation_links(members: DataFrame, observations: DataFrame) -> DataFrame:
    """Point -> source pixels through its contributing observation ids (members: point_id, node)."""
    return members.select("point_id", "node").distinct().join(observations.select("node", "view_id", "row", "col"), "node")


def attribute(points: DataFrame, mode: str) -> DataFrame:
    """Display attribute by name. Missing values take the product's minimum; a product without any is 0 with a reason."""
    plain = {"sourceIntensity": "intensity", "worldZ": "z", "viewCount": "view_count", "passCount": "pass_count", "residual": "residual", "uncertainty": "uncertainty",
             "conditioning": "condition", "demDifference": "dem_difference", "evidenceWeight": "weight", "localUp": "local_up", "HAE": "height_above_ellipsoid"}
    missing = {"localUp": "localUpUnavailableForUnknownWorldFrame", "HAE": "absoluteHeightUnavailableForWorldFrame"}
    if mode in plain:
        c = plain[mode]
        df = points.withColumn("_v", F.col(c).cast("double") if c in points.columns else F.lit(None).cast("double"))
        low = df.agg(F.min(F.nanvl("_v", F.lit(None))).alias("_low"))
        df = df.crossJoin(F.broadcast(low))  # one row
        ok = F.col("_low").isNotNull()
        why = missing.get(mode, "selectedProductHasNoFiniteValues") if mode not in plain or c not in points.columns else "selectedProductHasNoFiniteValues"
        return (df.withColumn("value", F.when(ok, F.coalesce(F.nanvl("_v", F.lit(None)), F.col("_low"))).otherwise(0.0))
                .withColumn("available", ok).withColumn("reason", F.when(ok, "").otherwise(why)).drop("_v", "_low"))
    label = {"fusionMethod": "fusion_method", "pairPass": "pair_pass"}[mode]
    ranks = rank_rows(points.select(F.col(label)).distinct().withColumn("_one", F.lit(0)), ["_one"], [label], "_rank").select(label, "_rank")
    return points.join(ranks, label).withColumn("value", F.col("_rank").cast("double")).withColumn("available", F.lit(True)).withColumn("reason", F.lit("")).drop("_rank")


def audit_matches(matches: DataFrame, by: list[str]) -> DataFrame:
    """Separation of matched terrain points where both sides see each other; excluded matches are counted.

    matches: by…, separation, visible_a, visible_b (visibility of each side's point from the other view).
    """
    from .quantiles import pctl

    mutual = (F.col("visible_a") == "visibleTerrain") & (F.col("visible_b") == "visibleTerrain")
    m = matches.withColumn("_s", F.when(mutual, F.col("separation")))
    s = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("_s").alias("mutually_visible"), (F.count(F.lit(1)) - F.count("_s")).alias("excluded"), F.max("_s").alias("maximum"))
    p = pctl(m, by, F.col("_s"), {"median": (0.5, "linear"), "p95": (0.95, "linear")}).drop("_n")
    return s.join(p, by, "left")
