"""Geometry expressions over rays and points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from raytable.functions import geometry as G
from raytable.functions.scalars import round6 as r6
from raytable.functions.vec import Vec

from .base import query

PLANE = G.Plane((1.0, 2.0, 50.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
# second plane: rotated a quarter turn about z, shifted
PLANE2 = G.Plane((-3.0, 5.0, 50.0), (0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
# tilted by a 3-4-5 triangle about x
TILTED = G.Plane((0.0, 0.0, 40.0), (1.0, 0.0, 0.0), (0.0, 0.8, 0.6), (0.0, -0.6, 0.8))
CAMERA = G.FrameCamera.looking_along((8.0, 8.0, 4.0), (0.0, 0.0, 1.0), 2.0, PLANE)



def ray():
    return Vec.prefixed("o"), Vec.prefixed("d")


def ends():
    return tuple(Vec.prefixed(p) for p in ("ao", "ad", "bo", "bd"))


@query("geo_01_intersect_plane", "fx_rays", sql="""
with s as (select *, 0*dx-0.6*dy+0.8*dz as den, (-0.6*(0-oy)+0.8*(40-oz)) as num from fx_rays),
t as (select *, num/nullif(den,0) as rng from s)
select obs_id, case when abs(den)<=1e-12 then 'parallel' when rng<=1e-12 then 'behind' else 'ok' end as status,
 round(rng,6) as range,
 case when rng>1e-12 then round(ox+dx*rng,6)+0.0 end as px,
 case when rng>1e-12 then round(0.8*(oy+dy*rng)+0.6*(oz+dz*rng-40),6)+0.0 end as py,
 case when rng>1e-12 then round(oz+dz*rng,6)+0.0 end as wz from t""")
def _(rays):
    df = G.intersect_plane(rays, *ray(), TILTED)
    return df.select("obs_id", "status", r6(F.col("range")).alias("range"), r6(F.col("plane_x")).alias("px"),
                     r6(F.col("plane_y")).alias("py"), r6(F.col("world_z")).alias("wz"))


@query("geo_02_plane_coordinates", "fx_points", sql="""
select point_id, x-1 as u, y-2 as v, (y-2)+2-5 as u2, -((x-1)+1+3) as v2, x as bx, y as by, cast(50 as double) as bz from fx_points""")
def _(points):
    u, v = G.world_to_plane(Vec.cols("x", "y", "z"), PLANE)
    df = points.withColumn("u", u).withColumn("v", v)
    u2, v2 = G.map_plane(F.col("u"), F.col("v"), PLANE, PLANE2)
    back = G.plane_to_world(F.col("u"), F.col("v"), PLANE)
    return df.select("point_id", "u", "v", u2.alias("u2"), v2.alias("v2"), back.x.alias("bx"), back.y.alias("by"), back.z.alias("bz"))


@query("geo_03_frame_camera", "fx_points", sql="""
with s as (select point_id, x-8 as vx, y-8 as vy, (z-9)-4+4 as depth from fx_points)
select point_id, case when depth<=1e-12 then 'behindCamera' else 'ok' end as status,
 case when depth>1e-12 then round(vx*2/depth,6)+0.0 end as cx, case when depth>1e-12 then round(vy*2/depth,6)+0.0 end as cy,
 case when depth>1e-12 then round(8+vx/depth*46,6)+0.0 end as wx, case when depth>1e-12 then round(8+vy/depth*46,6)+0.0 end as wy from s""")
def _(points):
    # points are lowered by 9 so that some lie behind the camera centre
    df = points.withColumn("z0", F.col("z") - 9 + 4)
    df = G.to_camera(df, Vec.cols("x", "y", "z0"), CAMERA).drop("x", "y")
    st = df.select("point_id", F.col("status").alias("st"), "camera_x", "camera_y")
    back = G.camera_to_plane(st, F.col("camera_x"), F.col("camera_y"), CAMERA, PLANE)
    return back.select("point_id", F.col("st").alias("status"), r6(F.col("camera_x")).alias("cx"),
                       r6(F.col("camera_y")).alias("cy"), r6(F.col("world_x")).alias("wx"), r6(F.col("world_y")).alias("wy"))


UNIT = """u as (select *, sqrt(adx*adx+ady*ady+adz*adz) as na, sqrt(bdx*bdx+bdy*bdy+bdz*bdz) as nb from fx_records),
w as (select *, adx/na as ax, ady/na as ay, adz/na as az, bdx/nb as bx, bdy/nb as byy, bdz/nb as bz,
 aox-box as wx, aoy-boy as wy, aoz-boz as wz from u)"""


@query("geo_04_triangulate_pair", "fx_records", sql=f"""
with {UNIT}, k as (select *, ax*bx+ay*byy+az*bz as b, ax*wx+ay*wy+az*wz as d, bx*wx+byy*wy+bz*wz as e from w),
r as (select *, (b*e-d)/(1-b*b) as s, (e-b*d)/(1-b*b) as t from k),
p as (select *, aox+ax*s as ux, aoy+ay*s as uy, aoz+az*s as uz, box+bx*t as vx, boy+byy*t as vy, boz+bz*t as vz from r)
select record_id, round(s,6) as ra, round(t,6) as rb, round(sqrt((ux-vx)*(ux-vx)+(uy-vy)*(uy-vy)+(uz-vz)*(uz-vz)),5) as sep,
 round(degrees(acos(least(1,abs(b)))),5) as angle, round(sqrt((1+abs(b))/(1-abs(b))),4) as cond,
 case when s>0 and t>0 then round((ux+vx)/2,6)+0.0 end as x, case when s>0 and t>0 then round((uy+vy)/2,6)+0.0 end as y,
 case when s>0 and t>0 then round((uz+vz)/2,6)+0.0 end as z from p""")
def _(rec):
    df = G.triangulate_pair(rec, *ends())
    return df.select("record_id", r6(F.col("pair_range_a")).alias("ra"), r6(F.col("pair_range_b")).alias("rb"),
                     F.round("pair_separation", 5).alias("sep"), F.round("pair_angle_degrees", 5).alias("angle"),
                     F.round("pair_condition", 4).alias("cond"),
                     *(r6(F.col("pair_" + c)).alias(c) for c in "xyz"))


@query("geo_05_closest_approach", "fx_records", sql="""
with k as (select *, adx*adx+ady*ady+adz*adz as a, adx*bdx+ady*bdy+adz*bdz as b, bdx*bdx+bdy*bdy+bdz*bdz as c,
 adx*(aox-box)+ady*(aoy-boy)+adz*(aoz-boz) as d, bdx*(aox-box)+bdy*(aoy-boy)+bdz*(aoz-boz) as e from fx_records),
r as (select *, case when abs(a*c-b*b)<=1e-10 then -d/a else (b*e-c*d)/(a*c-b*b) end as s,
 case when abs(a*c-b*b)<=1e-10 then 0 else (a*e-b*d)/(a*c-b*b) end as t from k)
select record_id, round(aox-box+adx*s-bdx*t,5)+0.0 as gx, round(aoy-boy+ady*s-bdy*t,5)+0.0 as gy, round(aoz-boz+adz*s-bdz*t,5)+0.0 as gz from r""")
def _(rec):
    df = G.closest_approach(rec, *ends())
    return df.select("record_id", *((F.round(f"gap.{c}", 5) + F.lit(0.0)).alias("g" + c) for c in "xyz"))


COPLANAR = f"""{UNIT}, c1 as (select *, -wx as ex, -wy as ey, -wz as ez, sqrt(wx*wx+wy*wy+wz*wz) as bl,
 ay*bz-az*byy as cx, az*bx-ax*bz as cy, ax*byy-ay*bx as cz from w),
c2 as (select *, ex/nullif(bl,0) as fx, ey/nullif(bl,0) as fy, ez/nullif(bl,0) as fz from c1),
c3 as (select *, fx*cx+fy*cy+fz*cz as num, sqrt(
 (byy*fz-bz*fy)*(byy*fz-bz*fy)+(bz*fx-bx*fz)*(bz*fx-bx*fz)+(bx*fy-byy*fx)*(bx*fy-byy*fx)
 +(fy*az-fz*ay)*(fy*az-fz*ay)+(fz*ax-fx*az)*(fz*ax-fx*az)+(fx*ay-fy*ax)*(fx*ay-fy*ax)) as den,
 sqrt(cx*cx+cy*cy+cz*cz) as cn from c2),
cop as (select *, case when bl<=1e-6 then 'negligibleBaseline' when cn<=1e-8 then 'nearlyParallelRays'
 when den<=1e-8 then 'degenerateNormalization' else 'valid' end as st from c3)"""


@query("geo_06_coplanarity", "fx_records", sql=f"""
with {COPLANAR} select record_id, st as status, case when st='valid' then round(num/den,6)+0.0 end as residual from cop""")
def _(rec):
    df = G.coplanarity(rec, *ends())
    return df.select("record_id", F.col("coplanarity_status").alias("status"), r6(F.col("coplanarity")).alias("residual"))


SITE = (40.0, -105.0, 1600.0)
_E0, _ROWS = G._ecef_scalar(*SITE), G._enu_rows(SITE[0], SITE[1])


@query("geo_07_geodetic_enu", "fx_dem", sql=f"""
with g as (select r, c, radians(40+r*0.00024) as la, radians(-105+c*0.00024) as lo, 1600.00013+coalesce(up,0) as h from fx_dem),
n as (select *, 6378137.0/sqrt(1-{G.WGS84_E2!r}*sin(la)*sin(la)) as n from g),
e as (select *, (n+h)*cos(la)*cos(lo)-({_E0[0]!r}) as ex, (n+h)*cos(la)*sin(lo)-({_E0[1]!r}) as ey, (n*{1 - G.WGS84_E2!r}+h)*sin(la)-({_E0[2]!r}) as ez from n)
select r, c, {', '.join(f"round(({w[0]!r})*ex+({w[1]!r})*ey+({w[2]!r})*ez,3)+0.0 as {k}" for k, w in zip(('e', 'n', 'u'), _ROWS))},
 round(degrees(la),6) as lat, round(degrees(lo),6) as lon, round(h,4) as h from e""")
def _(dem):
    df = dem.withColumn("h0", 1600.00013 + F.coalesce("up", F.lit(0.0)))
    df = G.geodetic_to_enu(df, 40 + F.col("r") * 0.00024, -105 + F.col("c") * 0.00024, F.col("h0"), SITE)
    df = G.enu_to_geodetic(df, Vec.field("enu"), SITE)
    return df.select("r", "c", *((F.round(f"enu.{a}", 3) + F.lit(0.0)).alias(n) for a, n in zip("xyz", "enu")),
                     F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("h", 4).alias("h"))


@query("geo_08_rotate", "fx_rays", sql="""
with a as (select *, 0.01 as w, -0.02 as f, 0.03 as k, dz/cast(4096 as double) as rx, 0.0 as ry, dx/cast(4096 as double) as rz from fx_rays),
x as (select *, cos(w)*dy-sin(w)*dz as y1, sin(w)*dy+cos(w)*dz as z1 from a),
y as (select *, cos(f)*dx+sin(f)*z1 as x2, cos(f)*z1-sin(f)*dx as z2 from x),
r as (select *, sqrt(rx*rx+ry*ry+rz*rz) as t, ry*dz-rz*dy as cx, rz*dx-rx*dz as cy, rx*dy-ry*dx as cz from y)
select obs_id, round(cos(k)*x2-sin(k)*y1,6)+0.0 as ex, round(sin(k)*x2+cos(k)*y1,6)+0.0 as ey, round(z2,6)+0.0 as ez,
 round(dx+cx*sin(t)/t+(ry*cz-rz*cy)*(1-cos(t))/(t*t),6)+0.0 as vx, round(dy+cy*sin(t)/t+(rz*cx-rx*cz)*(1-cos(t))/(t*t),6)+0.0 as vy,
 round(dz+cz*sin(t)/t+(rx*cy-ry*cx)*(1-cos(t))/(t*t),6)+0.0 as vz from r""")
def _(rays):
    e = G.rotate_opk(ray()[1], F.lit(0.01), F.lit(-0.02), F.lit(0.03))
    df = G.rotate_vector(rays, ray()[1], Vec(F.col("dz") / 4096, F.lit(0.0), F.col("dx") / 4096), "rv")
    return df.select("obs_id", *(r6(v).alias("e" + n) for n, v in zip("xyz", e)),
                     *(r6(F.col(f"rv.{n}")).alias("v" + n) for n in "xyz"))


@query("geo_09_covariance_frame", "fx_points", sql="""
with c as (select point_id, sigma*sigma as xx, sigma/16 as xy, cast(0 as double) as xz, 2*sigma*sigma as yy, sigma/32 as yz, 3*sigma*sigma as zz from fx_points)
select point_id, round(xx,6) as xx, round(0.8*xy-0.6*xz,6)+0.0 as xy, round(0.6*xy+0.8*xz,6)+0.0 as xz,
 round(0.64*yy-0.96*yz+0.36*zz,6)+0.0 as yy, round(0.48*yy+0.28*yz-0.48*zz,6)+0.0 as yz,
 round(0.36*yy+0.96*yz+0.64*zz,6)+0.0 as zz, round(sqrt(greatest(0,xx+yy+zz)),6) as sigma_r from c""")
def _(points):
    s = F.col("sigma")
    c = {"xx": s * s, "xy": s / 16, "xz": F.lit(0.0), "yy": 2 * s * s, "yz": s / 32, "zz": 3 * s * s}
    out = G.rotate_cov(c, ((1, 0, 0), (0, 0.8, -0.6), (0, 0.6, 0.8)))
    return points.select("point_id", *(r6(out[k]).alias(k) for k in G.PACKED), r6(G.radial_sigma(c)).alias("sigma_r"))


@query("geo_13_line_times", "fx_view_times", sql="""
select view_id, cast(case when user_id%2=0 then epoch_us(start_ts) + cast(round(1000000*(99-user_id%100)/cast(line_rate as double)) as bigint)
 else epoch_us(start_ts) + cast(round(1000000*(user_id%100)/cast(line_rate as double)) as bigint) end as bigint) as line_us from fx_view_times""")
def _(views):
    sec = G.line_seconds(F.lit(0.0), 1 + F.col("user_id") % 100, F.lit(100), F.col("line_rate"), F.col("user_id") % 2 == 0)
    return views.select("view_id", (F.unix_micros("start_ts") + F.round(sec * 1000000).cast("bigint")).alias("line_us"))


@query("geo_14_project_ray_grid", "fx_rays", sql="""
with t as (select obs_id, ox, oy, oz, -dy as dx, dx as dy, dz from fx_rays),
h as (select *, 50/dz as rng from t)
select obs_id, 'valid' as vertex_state, round(ox+dx*rng+0.5-1,6)+0.0 as px, round(oy+dy*rng-0.25-2,6)+0.0 as py, round(oz+dz*rng+2,6) as wz from h""")
def _(rays):
    df = G.project_ray_grid(rays, *ray(), (0.0, 0.0, math.pi / 2), (0.5, -0.25, 2.0), PLANE)
    return df.select("obs_id", "vertex_state", r6(F.col("plane_x")).alias("px"), r6(F.col("plane_y")).alias("py"), r6(F.col("world_z")).alias("wz"))
