"""Regular grids as node tables: stencils, bilinear sampling, ray lookup, visibility, poses, registration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raytable.functions.vec import Vec, with_vec
from raytable.runtime import materialize

from .ordered import lag_rows, last_known
from .quantiles import median_mad


@dataclass(frozen=True)
class GridSpec:
    """Node (r, c) sits at (x0 + c dx, y0 + r dy)."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    @staticmethod
    def over(nodes: DataFrame, x0: float, y0: float, dx: float, dy: float) -> "GridSpec":
        m = nodes.agg((F.max("r") + 1).alias("r"), (F.max("c") + 1).alias("c")).first()
        return GridSpec(x0, y0, dx, dy, int(m["r"]), int(m["c"]))


def stencil(nodes: DataFrame, by: list[str], offsets: dict[str, tuple[int, int]], values: list[str]) -> DataFrame:
    """Bring neighbouring nodes onto one row: column ``name`` is a struct of the node at (r+dr, c+dc), NULL if absent.

    Every node is sent to the rows that need it and merged there by one aggregation: no windows over long columns.
    """
    send = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, (dr, dc) in offsets.items()))
    s = nodes.select(*by, "r", "c", F.struct(*values).alias("_v"), F.explode(send).alias("_o"))
    s = s.select(*by, (F.col("r") - F.col("_o.dr")).alias("r"), (F.col("c") - F.col("_o.dc")).alias("c"), F.col("_o.n").alias("_n"), "_v")
    return s.groupBy(*by, "r", "c").agg(*(F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in offsets))


CROSS = {"here": (0, 0), "left": (0, -1), "right": (0, 1), "low": (-1, 0), "high": (1, 0)}
CORNERS = {"n00": (0, 0), "n01": (0, 1), "n10": (1, 0), "n11": (1, 1)}


def gradient(nodes: DataFrame, by: list[str], value: str, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Central differences inside, one-sided at edges; NULL next to a void node. Adds slope_x and slope_y."""
    s = stencil(nodes, by, CROSS, [value]).filter("here is not null")

    def slope(a, b, h):
        va, vb, v0 = F.col(f"{a}.{value}"), F.col(f"{b}.{value}"), F.col(f"here.{value}")
        return (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (vb - va) / (2 * h))
                .when(F.col(b).isNotNull(), (vb - v0) / h).when(F.col(a).isNotNull(), (v0 - va) / h))

    return s.select(*by, "r", "c", F.col(f"here.{value}").alias(value), slope("left", "right", dx).alias("slope_x"), slope("low", "high", dy).alias("slope_y"))


def cell_table(nodes: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row per grid cell with its four corner values."""
    return stencil(nodes, by, CORNERS, values).filter("n00 is not null and n01 is not null and n10 is not null and n11 is not null")


def locate(points: DataFrame, spec: GridSpec, x: Column, y: Column) -> DataFrame:
    """Cell index and fractions of a position (the last node row and column belong to the last cell)."""
    u, v = (x - spec.x0) / spec.dx, (y - spec.y0) / spec.dy
    inside = u.between(0, spec.cols - 1) & v.between(0, spec.rows - 1)
    c = F.least(F.floor(u), F.lit(spec.cols - 2)).cast("bigint")
    r = F.least(F.floor(v), F.lit(spec.rows - 2)).cast("bigint")
    df = points.withColumn("_c", F.when(inside, c)).withColumn("_r", F.when(inside, r))
    return df.withColumn("_fc", u - F.col("_c")).withColumn("_fr", v - F.col("_r"))


def bilinear(name: str) -> Column:
    g = lambda n: F.col(f"{n}.{name}")
    fc, fr = F.col("_fc"), F.col("_fr")
    return (1 - fr) * ((1 - fc) * g("n00") + fc * g("n01")) + fr * ((1 - fc) * g("n10") + fc * g("n11"))


def sample_cells(points: DataFrame, cells: DataFrame, spec: GridSpec, x: Column, y: Column, out: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Bilinear values at points by one equi-join with the cell table; NULL outside or beside a void."""
    by = by or []
    df = locate(points, spec, x, y)
    df = df.join(cells.withColumnRenamed("r", "_r").withColumnRenamed("c", "_c"), by + ["_r", "_c"], "left")
    for name, value in out.items():
        df = df.withColumn(name, bilinear(value))
    return df.drop("_r", "_c", "_fr", "_fc", *CORNERS)


def sample_grid(points: DataFrame, nodes: DataFrame, spec: GridSpec, x: Column, y: Column, value: str = "up") -> DataFrame:
    """Value and both slopes at points (slopes are node differences, then interpolated)."""
    cells = cell_table(gradient(nodes, [], value, spec.dx, spec.dy), [], [value, "slope_x", "slope_y"])
    return sample_cells(points, cells, spec, x, y, {"surface": value, "surface_slope_x": "slope_x", "surface_slope_y": "slope_y"})


def lookup_rays(obs: DataFrame, ray_nodes: DataFrame, spec: GridSpec, row: Column, col: Column) -> DataFrame:
    """Ray of a pixel from a sampled ray grid: origin linear along columns, direction bilinear; status outsideSampledMesh."""
    names = [f"{p}{c}" for p in "od" for c in "xyz"]
    cells = cell_table(ray_nodes, [], names)
    df = locate(obs, spec, col, row).join(cells.withColumnRenamed("r", "_r").withColumnRenamed("c", "_c"), ["_r", "_c"], "left")
    for c in "xyz":
        df = df.withColumn("ray_o" + c, (1 - F.col("_fc")) * F.col(f"n00.o{c}") + F.col("_fc") * F.col(f"n01.o{c}"))
        df = df.withColumn("ray_d" + c, bilinear("d" + c))
    df = df.withColumn("ray_status", F.when(F.col("n00").isNull(), "outsideSampledMesh").otherwise("ok"))
    return df.drop("_r", "_c", "_fr", "_fc", *CORNERS)


def visibility(rays: DataFrame, cells: DataFrame, spec: GridSpec, top: float, bottom: float, samples: int = 33,
               tolerance: float = 0.05, id_col: str = "ray_id") -> DataFrame:
    """First downward crossing of the height field along origin->target, against the target's range.

    Samples between the top and bottom heights join the grid cells; per ray the first sign change is refined linearly.
    """
    df = rays.withColumn("_len", F.sqrt(F.pow(F.col("tx") - F.col("ox"), 2) + F.pow(F.col("ty") - F.col("oy"), 2) + F.pow(F.col("tz") - F.col("oz"), 2)))
    for c in "xyz":
        df = df.withColumn("_d" + c, F.try_divide(F.col("t" + c) - F.col("o" + c), F.col("_len")))
    df = df.withColumn("_t0", F.try_divide(top - F.col("oz"), F.col("_dz"))).withColumn("_t1", F.try_divide(bottom - F.col("oz"), F.col("_dz")))
    good = (F.col("_len") > 0) & (F.col("_dz") < -2.220446049250313e-16) & (F.col("_t0") > 0) & (F.col("_t1") > F.col("_t0"))
    df = df.withColumn("_good", F.coalesce(good, F.lit(False)))
    s = df.filter("_good").select(id_col, "ox", "oy", "oz", "_dx", "_dy", "_dz", "_t0", "_t1", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    s = s.withColumn("t", F.col("_t0") + F.col("k") / F.lit(float(samples - 1)) * (F.col("_t1") - F.col("_t0")))
    s = s.select(id_col, "k", "t", *((F.col("o" + c) + F.col("_d" + c) * F.col("t")).alias("s" + c) for c in "xyz"))
    h = sample_cells(s, cells, spec, F.col("sx"), F.col("sy"), {"_h": "up"}).filter("_h is not null").withColumn("res", F.col("sz") - F.col("_h"))
    crossing = (h.groupBy(id_col).agg(F.min(F.when(F.col("res") <= 0, F.struct("k", "t", "res"))).alias("hit"),
                                      F.array_agg(F.struct("k", "t", "res")).alias("_all")))  # at most ``samples`` entries
    crossing = crossing.withColumn("_prev", F.filter("_all", lambda e: e["k"] == F.col("hit")["k"] - 1))
    prev = F.get("_prev", F.lit(0))
    frac = prev["res"] / (prev["res"] - F.col("hit.res"))
    hit = F.when(prev.isNull(), F.when(F.col("hit.k") == 0, F.col("hit.t"))).otherwise(prev["t"] + frac * (F.col("hit.t") - prev["t"]))
    out = df.join(crossing.select(id_col, hit.alias("hit_range")), id_col, "left")
    out = sample_cells(out, cells, spec, F.col("tx"), F.col("ty"), {"_ground": "up"})
    ok = F.col("_good") & (F.abs(F.col("tz") - F.col("_ground")) <= tolerance) & F.col("hit_range").isNotNull()
    status = (F.when(~F.coalesce(ok, F.lit(False)), "invalidGeometry").when(F.abs(F.col("hit_range") - F.col("_len")) <= tolerance, "visibleTerrain")
              .when(F.col("hit_range") < F.col("_len") - tolerance, "terrainOcclusion").otherwise("invalidGeometry"))
    return out.select(id_col, "hit_range", F.col("_len").alias("target_range"), status.alias("visibility_status"))


# --- poses between knots ---------------------------------------------------------------------------

def _with_slopes(knots: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """Shape-preserving cubic slopes per knot (interior harmonic mean, three-point ends)."""
    k = knots.withColumn("_here", F.struct(F.col(t).alias("t"), F.col(v).alias("v"))).withColumn("_back", -F.col(t))
    k = lag_rows(k, by, [t], "_here", "_p1")
    k = lag_rows(k, by, [t], "_p1", "_p2")
    k = lag_rows(k, by, ["_back"], "_here", "_q1")
    k = lag_rows(k, by, ["_back"], "_q1", "_q2")
    seg = lambda a, b: (F.col(b)["t"] - F.col(a)["t"], F.try_divide(F.col(b)["v"] - F.col(a)["v"], F.col(b)["t"] - F.col(a)["t"]))
    (h0, d0), (h1, d1) = seg("_p1", "_here"), seg("_here", "_q1")
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(d0 * d1 <= 0, 0.0).otherwise((w1 + w2) / (w1 / d0 + w2 / d1))

    def end(ha, da, hb, db):
        m = ((2 * ha + hb) * da - ha * db) / (ha + hb)
        m = F.when(F.signum(m) != F.signum(da), 0.0).when((F.signum(da) != F.signum(db)) & (F.abs(m) > 3 * F.abs(da)), 3 * da).otherwise(m)
        return F.coalesce(m, da, F.lit(0.0))

    (ha, da), (hb, db) = seg("_q1", "_q2"), seg("_p2", "_p1")
    slope = F.when(F.col("_p1").isNull(), end(h1, d1, ha, da)).when(F.col("_q1").isNull(), end(h0, d0, hb, db)).otherwise(inner)
    return k.withColumn("_slope_" + v, slope).drop("_here", "_back", "_p1", "_p2", "_q1", "_q2")


def pose_at(times: DataFrame, knots: DataFrame, by: list[str], t: str, values: list[str], id_col: str, method: str = "linear") -> DataFrame:
    """Interpolated knot values at times: an as-of join in both directions; NULL outside the knots."""
    k = knots.select(*by, t, *values)
    if method == "pchip":
        for v in values:
            k = _with_slopes(k, by, t, v)
    elif method != "linear":
        raise ValueError(f"unknown method {method!r}")
    cols = [c for c in k.columns if c not in by]
    knot = k.select(*by, F.col(t), F.lit(0).alias("_kind"), F.lit(None).cast(times.schema[id_col].dataType).alias(id_col), F.struct(*cols).alias("_knot"))
    ask = times.select(*by, F.col(t), F.lit(1).alias("_kind"), id_col, F.lit(None).cast(knot.schema["_knot"].dataType).alias("_knot"))
    both = knot.unionByName(ask)
    lo = last_known(both, by, [t, "_kind", id_col], "_knot", "_lo")
    lo = lo.withColumn("_kind2", -F.col("_kind"))
    both2 = last_known(lo, by, [t, "_kind2", id_col], "_knot", "_hi", forward=False)
    q = both2.filter("_kind = 1")
    h = F.col("_hi")[t] - F.col("_lo")[t]
    s = F.when(h > 0, (F.col(t) - F.col("_lo")[t]) / h).otherwise(0.0)
    q = q.withColumn("_s", s).withColumn("_h", h)
    for v in values:
        a, b, s = F.col("_lo")[v], F.col("_hi")[v], F.col("_s")
        if method == "linear":
            e = a + s * (b - a)
        else:
            m0, m1, h = F.col("_lo")["_slope_" + v], F.col("_hi")["_slope_" + v], F.col("_h")
            e = (2 * s * s * s - 3 * s * s + 1) * a + (s * s * s - 2 * s * s + s) * h * m0 + (3 * s * s - 2 * s * s * s) * b + (s * s * s - s * s) * h * m1
        q = q.withColumn(v, e)
    return q.select(*by, id_col, t, *values)


# --- registration -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class RegistrationOptions:
    horizontal_sigma: float = 0.5
    vertical_sigma: float = 0.25
    slope_scale: float = 1.0
    minimum_variance: float = 1e-6
    minimum_huber: float = 0.05
    huber: float | None = None
    maximum_step: float = 5.0
    tolerance: float = 1e-4
    iterations: int = 20
    minimum_support: int = 10
    rank_tolerance: float = 1e-10
    covariance_floor: float = 1e-6


def registration_rows(points: DataFrame, cells: DataFrame, spec: GridSpec, shift, opt: RegistrationOptions) -> DataFrame:
    """Shifted points with normal, residual and base weight; rows off the surface have NULL residual."""
    p = points
    for c, s in zip("xyz", shift):
        p = p.withColumn("_" + c, F.col(c) + F.lit(float(s)))
    p = sample_cells(p, cells, spec, F.col("_x"), F.col("_y"), {"_h": "up", "_sx": "slope_x", "_sy": "slope_y"})
    n = F.sqrt(1 + F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy"))
    p = p.withColumn("_norm", n).withColumn("nx", -F.col("_sx") / F.col("_norm")).withColumn("ny", -F.col("_sy") / F.col("_norm")).withColumn("nz", 1 / F.col("_norm"))
    p = p.withColumn("residual", F.col("nz") * (F.col("_z") - F.col("_h")))
    dem = opt.horizontal_sigma ** 2 * (F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")) + opt.vertical_sigma ** 2 * F.col("nz") * F.col("nz")
    slope = 1 / (1 + (F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy")) / opt.slope_scale ** 2)
    cond = 1 / (1 + F.log10(F.greatest(F.lit(1.0), F.col("condition"))))
    weight = slope * cond / F.greatest(F.lit(opt.minimum_variance), F.col("sigma") * F.col("sigma") + dem)
    return p.withColumn("base_weight", weight).drop("_norm", "_h", "_sx", "_sy")


def registration_sums(rows: DataFrame, huber: float) -> DataFrame:
    """The nine sums of the normal equation, support and residual variance: one combining aggregate."""
    w = F.col("base_weight") * F.least(F.lit(1.0), huber / F.greatest(F.abs("residual"), F.lit(2.220446049250313e-16)))
    u = rows.filter("residual is not null").withColumn("_w", w)
    n = [F.col("nx"), F.col("ny"), F.col("nz")]
    aggs = [F.sum(F.col("_w") * n[i] * n[j]).alias(f"n{i}{j}") for i in range(3) for j in range(i, 3)]
    aggs += [F.sum(F.col("_w") * n[i] * F.col("residual")).alias(f"g{i}") for i in range(3)]
    return u.agg(F.count(F.lit(1)).alias("support"), F.avg(F.col("residual") * F.col("residual")).alias("mean_square"), *aggs)


def register_to_dem(points: DataFrame, nodes: DataFrame, spec: GridSpec, opt: RegistrationOptions = RegistrationOptions()) -> DataFrame:
    """Translation aligning points to the surface. Each iteration is a grid join and one aggregate; the driver solves 3x3."""
    spark = points.sparkSession
    cells = materialize(cell_table(gradient(nodes, [], "up", spec.dx, spec.dy), [], ["up", "slope_x", "slope_y"]))
    pts = materialize(points.select("point_id", "x", "y", "z", "sigma", "condition"))
    shift, converged, used = np.zeros(3), False, 0

    def normal(at):
        rows = materialize(registration_rows(pts, cells, spec, at, opt).select("residual", "base_weight", "nx", "ny", "nz"))
        scale = opt.huber
        if scale is None:
            mm = median_mad(rows, [], F.col("residual")).first()
            scale = max(opt.minimum_huber, 1.4826 * (mm["mad"] if mm else 0.0))
        s = registration_sums(rows, scale).first()
        if not s["support"]:
            return s, np.zeros((3, 3)), np.zeros(3)
        m = np.array([[s[f"n{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
        return s, m, np.array([s[f"g{i}"] for i in range(3)])

    for used in range(1, opt.iterations + 1):
        s, m, g = normal(shift)
        if s["support"] < opt.minimum_support or np.linalg.matrix_rank(m, tol=opt.rank_tolerance) < 3:
            break
        step = -np.linalg.solve(m, g)
        size = np.linalg.norm(step)
        if size > opt.maximum_step:
            step *= opt.maximum_step / size
        shift = shift + step
        if np.linalg.norm(step) <= opt.tolerance:
            converged = True
            break
    s, m, _ = normal(shift)
    cov = np.diag([opt.horizontal_sigma ** 2] * 2 + [opt.vertical_sigma ** 2])
    full = s["support"] >= opt.minimum_support and np.linalg.matrix_rank(m, tol=opt.rank_tolerance) == 3
    status = "sharedDemAccuracyFloorOnly"
    if full:
        cov = cov + max(opt.covariance_floor, s["mean_square"]) * np.linalg.pinv(m)
        status = "posteriorWithSharedDemAccuracyFloor"
    row = (*(float(v) for v in shift), bool(converged), int(used), int(s["support"]), float(np.linalg.cond(m)) if full else None, status,
           *(float(cov[i, j]) for i in range(3) for j in range(i, 3)))
    return spark.createDataFrame([row], "shift_x double, shift_y double, shift_z double, converged boolean, iterations int, support bigint, condition double, "
                                        "covariance_status string, cov_xx double, cov_xy double, cov_xz double, cov_yy double, cov_yz double, cov_zz double")


def audit_registration(trials: DataFrame, by: list[str]) -> DataFrame:
    """Per trial set: RMSE, empirical covariance, and the share of errors inside the 90 % Mahalanobis bound.

    trials: by…, trial, ex, ey, ez and reported variances vx, vy, vz.
    """
    m2 = sum((F.col("e" + c) * F.col("e" + c) / F.col("v" + c) for c in "xyz"), F.lit(0.0))
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"), F.sqrt(F.avg(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez"))).alias("rmse"),
        *(F.covar_samp("e" + a, "e" + b).alias(f"cov_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")),
        F.avg((m2 <= 6.2514).cast("double")).alias("coverage"))
