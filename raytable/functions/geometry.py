"""Ray, plane, camera and frame geometry as column expressions (no UDFs)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import Vec, acos_degrees, with_vec

RAY_TOLERANCE = 1e-12
PAIR_PARALLEL_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Plane:
    """Point plus right-handed orthonormal basis; a handful of literals, never a table."""

    origin: tuple[float, float, float]
    axis_x: tuple[float, float, float]
    axis_y: tuple[float, float, float]
    normal: tuple[float, float, float]

    def __post_init__(self):
        axes = (self.axis_x, self.axis_y, self.normal)
        for i, a in enumerate(axes):
            for j, b in enumerate(axes):
                if abs(sum(p * q for p, q in zip(a, b)) - (i == j)) > 1e-9:
                    raise ValueError("plane basis is not orthonormal")


@dataclass(frozen=True)
class FrameCamera:
    centre: tuple[float, float, float]
    focal_plane: Plane

    @staticmethod
    def looking_along(centre, direction, focal_length: float, reference: Plane) -> "FrameCamera":
        """Camera whose +X is the reference plane's +X projected into the focal plane."""
        n = _unit(direction)
        x = reference.axis_x
        along = sum(a * b for a, b in zip(x, n))
        ax = _unit(tuple(a - along * b for a, b in zip(x, n)))
        ay = (n[1] * ax[2] - n[2] * ax[1], n[2] * ax[0] - n[0] * ax[2], n[0] * ax[1] - n[1] * ax[0])
        p0 = tuple(c + focal_length * d for c, d in zip(centre, n))
        return FrameCamera(tuple(centre), Plane(p0, ax, ay, n))


def _unit(v):
    n = math.sqrt(sum(a * a for a in v))
    return tuple(a / n for a in v)


# --- planes -----------------------------------------------------------------

def intersect_plane(df: DataFrame, origin: Vec, direction: Vec, plane: Plane,
                    tolerance: float = RAY_TOLERANCE) -> DataFrame:
    """Forward ray/plane hit: adds status, valid, range, world and plane coordinates."""
    n, p0 = Vec.lit(*plane.normal), Vec.lit(*plane.origin)
    df = (df.withColumn("_usable", origin.finite() & direction.finite() & (direction.norm() > tolerance))
          .withColumn("_denominator", n.dot(direction)))
    df = df.withColumn("range", F.when(F.col("_usable") & (F.abs("_denominator") > tolerance),
                                       F.try_divide(n.dot(p0 - origin), F.col("_denominator"))))
    df = df.withColumn(
        "status",
        F.when(~F.col("_usable"), "invalid")
        .when(F.abs("_denominator") <= tolerance, "parallel")
        .when(F.isnan("range") | (F.col("range") <= tolerance), "behind")
        .otherwise("ok"))
    df = df.withColumn("valid", F.col("status") == "ok")
    hit = origin + direction.scale(F.col("range"))
    df = with_vec(df, "world", hit)
    for name, axis in (("plane_x", plane.axis_x), ("plane_y", plane.axis_y)):
        df = df.withColumn(name, F.when(F.col("valid"), Vec.lit(*axis).dot(Vec.field("world") - p0)))
    for name in "xyz":
        df = df.withColumn(f"world_{name}", F.when(F.col("valid"), F.col(f"world.{name}")))
    return df.drop("_usable", "_denominator", "world")


def world_to_plane(point: Vec, plane: Plane) -> tuple[Column, Column]:
    delta = point - Vec.lit(*plane.origin)
    return Vec.lit(*plane.axis_x).dot(delta), Vec.lit(*plane.axis_y).dot(delta)


def plane_to_world(u: Column, v: Column, plane: Plane) -> Vec:
    return Vec.lit(*plane.origin) + Vec.lit(*plane.axis_x).scale(u) + Vec.lit(*plane.axis_y).scale(v)


def map_plane(u: Column, v: Column, source: Plane, target: Plane) -> tuple[Column, Column]:
    return world_to_plane(plane_to_world(u, v, source), target)


# --- frame camera -------------------------------------------------------------

def to_camera(df: DataFrame, point: Vec, camera: FrameCamera) -> DataFrame:
    """Adds camera_x, camera_y and status (ok / behindCamera)."""
    c, f = Vec.lit(*camera.centre), camera.focal_plane
    df = with_vec(df, "_view", point - c)
    view, n = Vec.field("_view"), Vec.lit(*f.normal)
    df = df.withColumn("depth", n.dot(view))
    df = df.withColumn("status", F.when(F.col("depth") <= RAY_TOLERANCE, "behindCamera").otherwise("ok"))
    ok = F.col("status") == "ok"
    hit = c + view.scale(F.try_divide(n.dot(Vec.lit(*f.origin) - c), F.col("depth")))
    u, v = world_to_plane(hit, f)
    return df.withColumn("camera_x", F.when(ok, u)).withColumn("camera_y", F.when(ok, v)).drop("_view")


def from_camera(u: Column, v: Column, camera: FrameCamera) -> Vec:
    """View vector of a focal-plane position."""
    return plane_to_world(u, v, camera.focal_plane) - Vec.lit(*camera.centre)


def camera_to_plane(df: DataFrame, u: Column, v: Column, camera: FrameCamera, plane: Plane) -> DataFrame:
    return intersect_plane(df, Vec.lit(*camera.centre), from_camera(u, v, camera), plane)


# --- two rays -------------------------------------------------------------------

def triangulate_pair(df: DataFrame, oa: Vec, va: Vec, ob: Vec, vb: Vec, prefix: str = "pair_") -> DataFrame:
    """Closest midpoint of two rays with ranges, separation, angle, condition and validity."""
    df = with_vec(with_vec(df, "_a", va.unit()), "_b", vb.unit())
    a, b, w = Vec.field("_a"), Vec.field("_b"), oa - ob
    df = (df.withColumn("_cos", a.dot(b)).withColumn("_d", a.dot(w)).withColumn("_e", b.dot(w)))
    cos, d, e = F.col("_cos"), F.col("_d"), F.col("_e")
    df = df.withColumn("_den", F.when(F.abs(1 - cos * cos) > PAIR_PARALLEL_TOLERANCE, 1 - cos * cos))
    df = (df.withColumn(prefix + "range_a", (cos * e - d) / F.col("_den"))
          .withColumn(prefix + "range_b", (e - cos * d) / F.col("_den")))
    df = with_vec(df, "_na", oa + a.scale(F.col(prefix + "range_a")))
    df = with_vec(df, "_nb", ob + b.scale(F.col(prefix + "range_b")))
    na, nb = Vec.field("_na"), Vec.field("_nb")
    mid = (na + nb).scale(0.5)
    df = (df.withColumn(prefix + "separation", (na - nb).norm())
          .withColumn(prefix + "angle_degrees", acos_degrees(F.abs(cos)))
          .withColumn(prefix + "condition", F.sqrt(F.try_divide(1 + F.abs(cos), 1 - F.abs(cos))))
          .withColumn(prefix + "forward_valid", F.coalesce(
              (F.col(prefix + "range_a") > 0) & (F.col(prefix + "range_b") > 0), F.lit(False))))
    ok = F.col(prefix + "forward_valid")
    for name, v in zip("xyz", mid):
        df = df.withColumn(prefix + name, F.when(ok, v))
    return df.drop("_a", "_b", "_cos", "_d", "_e", "_den", "_na", "_nb")


def closest_approach(df: DataFrame, oa: Vec, va: Vec, ob: Vec, vb: Vec, name: str = "gap",
                     tolerance: float = PAIR_PARALLEL_TOLERANCE) -> DataFrame:
    """Vector between the nearest points of two lines; parallel lines use the perpendicular offset."""
    delta = oa - ob
    df = (df.withColumn("_aa", va.dot(va)).withColumn("_ab", va.dot(vb)).withColumn("_bb", vb.dot(vb))
          .withColumn("_ad", va.dot(delta)).withColumn("_bd", vb.dot(delta)))
    aa, ab, bb, ad, bd = (F.col(c) for c in ("_aa", "_ab", "_bb", "_ad", "_bd"))
    df = df.withColumn("_det", aa * bb - ab * ab).withColumn("_par", F.abs("_det") <= tolerance)
    det = F.col("_det")
    df = (df.withColumn("_s", F.when(F.col("_par"), -F.try_divide(ad, aa)).otherwise(F.try_divide(ab * bd - bb * ad, det)))
          .withColumn("_t", F.when(F.col("_par"), F.lit(0.0)).otherwise(F.try_divide(aa * bd - ab * ad, det))))
    df = with_vec(df, name, delta + va.scale(F.col("_s")) - vb.scale(F.col("_t")))
    return df.drop("_aa", "_ab", "_bb", "_ad", "_bd", "_det", "_par", "_s", "_t")


@dataclass(frozen=True)
class CoplanarityLimits:
    baseline: float = 1e-6
    direction: float = 1e-12
    ray_cross: float = 1e-8
    denominator: float = 1e-8


def coplanarity(df: DataFrame, oa: Vec, va: Vec, ob: Vec, vb: Vec,
                limits: CoplanarityLimits = CoplanarityLimits()) -> DataFrame:
    """Signed Sampson-normalised coplanarity residual with a first-failure status."""
    df = with_vec(with_vec(with_vec(df, "_m", va.unit()), "_r", vb.unit()), "_base", ob - oa)
    m, r, base = Vec.field("_m"), Vec.field("_r"), Vec.field("_base")
    df = df.withColumn("baseline", base.norm())
    df = with_vec(with_vec(df, "_bu", base.div(F.col("baseline"))), "_mr", m.cross(r))
    bu, mr = Vec.field("_bu"), Vec.field("_mr")
    df = with_vec(with_vec(df, "_rb", r.cross(bu)), "_bm", bu.cross(m))
    rb, bm = Vec.field("_rb"), Vec.field("_bm")
    df = df.withColumn("sampson_denominator", F.sqrt(rb.dot(rb) + bm.dot(bm)))
    df = df.withColumn(
        "coplanarity_status",
        F.when(~(oa.finite() & va.finite() & ob.finite() & vb.finite()), "nonfiniteRay")
        .when((va.norm() <= limits.direction) | (vb.norm() <= limits.direction), "zeroDirection")
        .when(F.col("baseline") <= limits.baseline, "negligibleBaseline")
        .when(mr.norm() <= limits.ray_cross, "nearlyParallelRays")
        .when(F.col("sampson_denominator") <= limits.denominator, "degenerateNormalization")
        .otherwise("valid"))
    df = df.withColumn("coplanarity", F.when(F.col("coplanarity_status") == "valid",
                                             F.try_divide(bu.dot(mr), F.col("sampson_denominator"))))
    return df.drop("_m", "_r", "_base", "_bu", "_mr", "_rb", "_bm")


# --- frames -----------------------------------------------------------------------

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)


def geodetic_to_ecef(df: DataFrame, lat: Column, lon: Column, h: Column, name: str) -> DataFrame:
    """Degrees and metres to earth-centred coordinates, stored as a struct."""
    la, lo = F.radians(lat), F.radians(lon)
    df = df.withColumn("_n", F.lit(WGS84_A) / F.sqrt(1 - WGS84_E2 * F.sin(la) * F.sin(la)))
    n = F.col("_n")
    return with_vec(df, name, Vec((n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo),
                                  (n * (1 - WGS84_E2) + h) * F.sin(la))).drop("_n")


def _ecef_scalar(lat: float, lon: float, h: float):
    la, lo = math.radians(lat), math.radians(lon)
    n = WGS84_A / math.sqrt(1 - WGS84_E2 * math.sin(la) ** 2)
    return ((n + h) * math.cos(la) * math.cos(lo), (n + h) * math.cos(la) * math.sin(lo),
            (n * (1 - WGS84_E2) + h) * math.sin(la))


def _enu_rows(lat: float, lon: float):
    la, lo = math.radians(lat), math.radians(lon)
    return ((-math.sin(lo), math.cos(lo), 0.0),
            (-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)),
            (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)))


def geodetic_to_enu(df: DataFrame, lat: Column, lon: Column, h: Column, origin, name: str = "enu") -> DataFrame:
    """Local east/north/up about ``origin`` = (lat, lon, height)."""
    df = geodetic_to_ecef(df, lat, lon, h, "_ecef")
    delta = Vec.field("_ecef") - Vec.lit(*_ecef_scalar(*origin))
    rows = _enu_rows(origin[0], origin[1])
    return with_vec(df, name, Vec(*(Vec.lit(*r).dot(delta) for r in rows))).drop("_ecef")


def enu_to_geodetic(df: DataFrame, enu: Vec, origin, steps: int = 5) -> DataFrame:
    """Inverse of :func:`geodetic_to_enu`; latitude by a fixed number of unrolled steps."""
    rows, base = _enu_rows(origin[0], origin[1]), _ecef_scalar(*origin)
    cols = list(zip(*rows))
    df = with_vec(df, "_ecef", Vec.lit(*base) + Vec(*(Vec.lit(*c).dot(enu) for c in cols)))
    p = F.hypot(F.col("_ecef.x"), F.col("_ecef.y"))
    df = df.withColumn("_p", p).withColumn("_lat", F.atan2(F.col("_ecef.z"), F.col("_p") * (1 - WGS84_E2)))
    for _ in range(steps):
        df = df.withColumn("_n", F.lit(WGS84_A) / F.sqrt(1 - WGS84_E2 * F.sin("_lat") * F.sin("_lat")))
        df = df.withColumn("_lat", F.atan2(F.col("_ecef.z") + WGS84_E2 * F.col("_n") * F.sin("_lat"), F.col("_p")))
    df = df.withColumn("_n", F.lit(WGS84_A) / F.sqrt(1 - WGS84_E2 * F.sin("_lat") * F.sin("_lat")))
    return (df.withColumn("lat", F.degrees("_lat"))
            .withColumn("lon", F.degrees(F.atan2(F.col("_ecef.y"), F.col("_ecef.x"))))
            .withColumn("h", F.col("_p") * F.cos("_lat") + F.col("_ecef.z") * F.sin("_lat")
                        - F.lit(WGS84_A) * F.sqrt(1 - WGS84_E2 * F.sin("_lat") * F.sin("_lat")))
            .drop("_ecef", "_p", "_lat", "_n"))


def affine_frame(v: Vec, rows, offset) -> Vec:
    """Rotate by three literal rows, then shift (east/north/up to project world and back)."""
    return Vec(*(Vec.lit(*r).dot(v) for r in rows)) + Vec.lit(*offset)


# --- rotations ----------------------------------------------------------------------

def rotate_opk(v: Vec, omega: Column, phi: Column, kappa: Column) -> Vec:
    """Rz(kappa) * Ry(phi) * Rx(omega) applied to a vector, angles in radians."""
    co, so, cp, sp, ck, sk = F.cos(omega), F.sin(omega), F.cos(phi), F.sin(phi), F.cos(kappa), F.sin(kappa)
    y1, z1 = co * v.y - so * v.z, so * v.y + co * v.z
    x2, z2 = cp * v.x + sp * z1, cp * z1 - sp * v.x
    return Vec(ck * x2 - sk * y1, sk * x2 + ck * y1, z2)


def rotate_vector(df: DataFrame, v: Vec, rot: Vec, name: str) -> DataFrame:
    """Rodrigues rotation by a rotation vector, with the series form for tiny angles."""
    df = df.withColumn("_angle", rot.norm())
    a = F.col("_angle")
    small = a < 1e-10
    df = (df.withColumn("_k1", F.when(small, 1 - a * a / 6).otherwise(F.try_divide(F.sin(a), a)))
          .withColumn("_k2", F.when(small, F.lit(0.5)).otherwise(F.try_divide(1 - F.cos(a), a * a))))
    df = with_vec(df, "_c", rot.cross(v))
    c = Vec.field("_c")
    out = v + c.scale(F.col("_k1")) + rot.cross(c).scale(F.col("_k2"))
    return with_vec(df, name, out).drop("_angle", "_k1", "_k2", "_c")


def project_ray_grid(df: DataFrame, origin: Vec, direction: Vec, angles, offset, plane: Plane) -> DataFrame:
    """Rotate sampled rays, hit the plane and shift: one mesh vertex per (view, row, col)."""
    df = with_vec(df, "_turned", rotate_opk(direction, *(F.lit(float(a)) for a in angles)))
    df = intersect_plane(df, origin, Vec.field("_turned"), plane)
    world = Vec.cols("world_x", "world_y", "world_z") + Vec.lit(*offset)
    df = with_vec(df, "_shifted", world)
    u, v = world_to_plane(Vec.field("_shifted"), plane)
    df = df.withColumn("plane_x", u).withColumn("plane_y", v)
    for n in "xyz":
        df = df.withColumn(f"world_{n}", F.col(f"_shifted.{n}"))
    return (df.withColumn("vertex_state", F.when(F.col("status") == "ok", "valid")
                          .when(F.col("status") == "behind", "behindSource").otherwise("rejected"))
            .drop("_turned", "_shifted"))


# --- covariance ---------------------------------------------------------------------

PACKED = ("xx", "xy", "xz", "yy", "yz", "zz")


def packed(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in PACKED}


def rotate_cov(c: dict[str, Column], rows) -> dict[str, Column]:
    """R C R' for a packed symmetric 3x3 and a literal rotation."""
    full = {("x", "x"): c["xx"], ("x", "y"): c["xy"], ("x", "z"): c["xz"],
            ("y", "y"): c["yy"], ("y", "z"): c["yz"], ("z", "z"): c["zz"]}

    def at(p, q):
        return full[(p, q)] if (p, q) in full else full[(q, p)]

    out = {}
    for key in PACKED:
        i, j = "xyz".index(key[0]), "xyz".index(key[1])
        total = None
        for a, p in enumerate("xyz"):
            for b, q in enumerate("xyz"):
                w = float(rows[i][a]) * float(rows[j][b])
                if w:
                    term = at(p, q) * F.lit(w)
                    total = term if total is None else total + term
        out[key] = total if total is not None else F.lit(0.0)
    return out


def radial_sigma(c: dict[str, Column]) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), c["xx"] + c["yy"] + c["zz"]))


# --- line times -----------------------------------------------------------------------

def line_seconds(start: Column, line: Column, line_count: Column, rate: Column, decreasing: Column) -> Column:
    """Seconds of a scan line; a decreasing scan counts lines from the far end."""
    index = F.when(decreasing, line_count - line).otherwise(line - 1)
    return start + F.try_divide(index.cast("double"), rate.cast("double"))
