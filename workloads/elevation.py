"""Elevation grids: ingestion, sampling, visibility, poses and registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from raytable.functions.scalars import round6 as r6
from raytable.operators import grids as G
from raytable.operators import ledger as L
from raytable.sources.dem import ingest_dem

from .base import query


@query("src_04_ingest_dem", "fx_dem", sql="""
with v as (select *, up is not null and up<>8 and c%32<>31 as ok from fx_dem)
select count(*) as cells, count_if(ok) as valid_cells, min(case when ok then up end) as minimum, max(case when ok then up end) as maximum, max(r)+1 as rows, max(c)+1 as cols, round(count_if(ok)/count(*),6) as coverage from v""")
def _(d):
    _, info = ingest_dem(d.withColumn("ex", F.col("c") % 32 == 31), 8.0, "ex")
    return info.withColumn("coverage", r6(F.col("coverage")))


GRD = """nd as (select a.r, a.c, a.up, case when l.r is not null and q.r is not null then (q.up-l.up)/0.5 when q.r is not null then (q.up-a.up)/0.25 else (a.up-l.up)/0.25 end as sx,
 case when lo.r is not null and hi.r is not null then (hi.up-lo.up)/0.5 when hi.r is not null then (hi.up-a.up)/0.25 else (a.up-lo.up)/0.25 end as sy
 from fx_dem a left join fx_dem l on l.r=a.r and l.c=a.c-1 left join fx_dem q on q.r=a.r and q.c=a.c+1 left join fx_dem lo on lo.c=a.c and lo.r=a.r-1 left join fx_dem hi on hi.c=a.c and hi.r=a.r+1),
sz as (select max(r)+1 as nr, max(c)+1 as nc from fx_dem)"""


def _bil(v):
    return f"(1-fr)*((1-fc)*a.{v}+fc*b.{v})+fr*((1-fc)*d.{v}+fc*e.{v})"


def _sample(points, x, y, extra=""):
    return f"""pq as (select p.*, ({x})/0.25 as u, ({y})/0.25 as w from {points} p),
pc as (select pq.*, least(floor(u),nc-2) as ci, least(floor(w),nr-2) as ri from pq cross join sz where u between 0 and nc-1 and w between 0 and nr-1),
pf as (select *, u-ci as fc, w-ri as fr from pc),
ss as (select pf.*, {_bil('up')} as h, {_bil('sx')} as hx, {_bil('sy')} as hy from pf left join nd a on a.r=ri and a.c=ci left join nd b on b.r=ri and b.c=ci+1 left join nd d on d.r=ri+1 and d.c=ci left join nd e on e.r=ri+1 and e.c=ci+1)"""


def spec(d):
    return G.GridSpec.over(d, 0.0, 0.0, 0.25, 0.25)


@query("jon_05_sample_grid", "fx_points", "fx_dem", sql=f"""
with {GRD}, {_sample('fx_points', 'x+0.0625', 'y+0.125')} select p.point_id, round(h,6)+0.0 as h, round(hx,6)+0.0 as sx, round(hy,6)+0.0 as sy from fx_points p left join ss using (point_id)""")
def _(p, d):
    out = G.sample_grid(p, d, spec(d), F.col("x") + 0.0625, F.col("y") + 0.125)
    return out.select("point_id", r6(F.col("surface")).alias("h"), r6(F.col("surface_slope_x")).alias("sx"), r6(F.col("surface_slope_y")).alias("sy"))


@query("flt_08_select_for_grid", "fx_points", "fx_dem", sql=f"""
with {GRD}, {_sample('fx_points', 'x+0.0625', 'y+0.125')} select p.point_id, case when p.o_custkey%13=0 then 'invalidPoint' when p.o_custkey%17=0 then 'missingCovariance' when p.o_custkey%19=0 then 'explicitExclusion' when ss.h is null then 'outsideGrid' else '' end as reason
from fx_points p left join ss using (point_id)""")
def _(p, d):
    s = G.sample_grid(p, d, spec(d), F.col("x") + 0.0625, F.col("y") + 0.125).withColumnRenamed("surface", "surface_height")
    s = s.withColumn("valid", F.col("o_custkey") % 13 != 0).withColumn("sigma", F.when(F.col("o_custkey") % 17 != 0, F.col("sigma")))
    out = L.select_points_for_grid(s, p.filter("o_custkey % 19 = 0").select("point_id"))
    return out.select("point_id", F.col("selection_reason").alias("reason"))


def ray_nodes(d):
    return d.select("r", "c", *((e).cast("double").alias(n) for n, e in (
        ("ox", F.col("c") * 2), ("oy", F.lit(0)), ("oz", F.lit(100)), ("dx", F.col("c") / 64), ("dy", (F.col("r") % 16) / 16), ("dz", -1 - F.col("r") % 3))))


@query("jon_13_lookup_rays", "fx_points", "fx_dem", sql="""
with sz as (select max(r)+1 as nr, max(c)+1 as nc from fx_dem), nd as (select r, c, cast(c*2 as double) as ox, c/64.0::double as dx, (r%16)/16.0::double as dy, cast(-1-r%3 as double) as dz from fx_dem),
q as (select point_id, x*4+0.25-8 as u, y*4+0.5-2 as w from fx_points), f as (select *, least(floor(u),nc-2) as ci, least(floor(w),nr-2) as ri from q cross join sz where u between 0 and nc-1 and w between 0 and nr-1),
s as (select point_id, (1-(u-ci))*a.ox+(u-ci)*b.ox as ox, (1-(w-ri))*((1-(u-ci))*a.dx+(u-ci)*b.dx)+(w-ri)*((1-(u-ci))*d.dx+(u-ci)*e.dx) as dx, (1-(w-ri))*((1-(u-ci))*a.dy+(u-ci)*b.dy)+(w-ri)*((1-(u-ci))*d.dy+(u-ci)*e.dy) as dy
 from f join nd a on a.r=ri and a.c=ci join nd b on b.r=ri and b.c=ci+1 join nd d on d.r=ri+1 and d.c=ci join nd e on e.r=ri+1 and e.c=ci+1)
select point_id, case when s.ox is null then 'outsideSampledMesh' else 'ok' end as ray_status, round(s.ox,6) as ox, round(s.dx,6) as dx, round(s.dy,6) as dy from fx_points left join s using (point_id)""")
def _(p, d):
    g = G.GridSpec.over(d, 0.0, 0.0, 1.0, 1.0)
    out = G.lookup_rays(p.select("point_id", "x", "y"), ray_nodes(d), g, F.col("y") * 4 + 0.5 - 2, F.col("x") * 4 + 0.25 - 8)
    return out.select("point_id", "ray_status", r6(F.col("ray_ox")).alias("ox"), r6(F.col("ray_dx")).alias("dx"), r6(F.col("ray_dy")).alias("dy"))


@query("flt_12_visibility", "fx_points", "fx_dem")
def _(p, d):
    g = spec(d)
    pts = G.sample_grid(p, d, g, F.col("x") + 0.0625, F.col("y") + 0.125).filter("surface is not null")
    rays = pts.select(F.col("point_id").alias("ray_id"), F.lit(8.0).alias("ox"), F.col("y").alias("oy"), F.lit(40.0).alias("oz"), (F.col("x") + 0.0625).alias("tx"), (F.col("y") + 0.125).alias("ty"), F.col("surface").alias("tz"))
    out = G.visibility(rays, G.cell_table(d, [], ["up"]), g, 30.0, 7.0)
    return out.select("ray_id", "visibility_status", F.round("hit_range", 4).alias("hit_range"), F.round("target_range", 4).alias("target_range"))


POSE = """kn as (select user_id, epoch_us(start_ts)/1000000.0::double as t, cast(event_id%64 as double) as px from fx_view_times where start_ts is not null and event_id%3=0),
qs as (select user_id, view_id, epoch_us(start_ts)/1000000.0::double as t from fx_view_times where start_ts is not null and event_id%3<>0)"""


@query("jon_08_pose_at", "fx_view_times", sql=f"""
with {POSE}, lo as (select q.user_id, view_id, q.t, k.t as t0, k.px as p0 from qs q asof left join kn k on q.user_id=k.user_id and q.t>=k.t), hi as (select q.view_id, k.t as t1, k.px as p1 from qs q asof left join kn k on q.user_id=k.user_id and q.t<=k.t)
select view_id, round(p0+case when t1>t0 then (t-t0)/(t1-t0) else 0 end*(p1-p0),4)+0.0 as px from lo join hi using (view_id)""")
def _(v):
    v = v.filter("start_ts is not null").withColumn("t", F.unix_micros("start_ts") / 1000000.0).withColumn("px", (F.col("event_id") % 64).cast("double"))
    out = G.pose_at(v.filter("event_id % 3 <> 0"), v.filter("event_id % 3 = 0"), ["user_id"], "t", ["px"], "view_id")
    return out.select("view_id", (F.round("px", 4) + F.lit(0.0)).alias("px"))


@query("jon_08_pose_at_pchip", "fx_view_times")
def _(v):
    v = v.filter("start_ts is not null").withColumn("t", F.unix_micros("start_ts") / 1000000.0).withColumn("px", (F.col("event_id") % 64).cast("double"))
    out = G.pose_at(v.filter("event_id % 3 <> 0"), v.filter("event_id % 3 = 0"), ["user_id"], "t", ["px"], "view_id", "pchip")
    return out.select("view_id", F.round("px", 4).alias("px"))


@query("slv_05_registration_sums", "fx_points", "fx_dem", sql=f"""
with {GRD}, p0 as (select point_id, x+0.0625 as px, y+0.125 as py, z+0.5 as pz, sigma from fx_points), {_sample('p0', 'px', 'py')},
n as (select *, sqrt(1+hx*hx+hy*hy) as nn from ss where h is not null and hx is not null and hy is not null), m as (select *, -hx/nn as nx, -hy/nn as ny, 1/nn as nz, (pz-h)/nn as res from n),
w as (select *, 1/(1+hx*hx+hy*hy)/greatest(1e-6, sigma*sigma+0.25*(nx*nx+ny*ny)+0.0625*nz*nz)*least(1, 1.0/greatest(abs(res),2.220446049250313e-16)) as wt from m)
select count(*) as support, round(avg(res*res),4) as mean_square, round(sum(wt*nx*nx),3) as n00, round(sum(wt*nx*nz),3)+0.0 as n02, round(sum(wt*nz*nz),3) as n22, round(sum(wt*nz*res),3) as g2 from w""")
def _(p, d):
    g = spec(d)
    opt = G.RegistrationOptions()
    cells = G.cell_table(G.gradient(d, [], "up", g.dx, g.dy), [], ["up", "slope_x", "slope_y"])
    pts = p.select("point_id", "x", "y", "z", "sigma").withColumn("condition", F.lit(1.0))
    s = G.registration_sums(G.registration_rows(pts, cells, g, (0.0625, 0.125, 0.5), opt), 1.0)
    return s.select("support", F.round("mean_square", 4).alias("mean_square"), *(F.round(c, 3).alias(c) for c in ("n00", "n02", "n22", "g2")))


@query("slv_05_register_to_dem", "fx_points", "fx_dem")
def _(p, d):
    g = spec(d)
    pts = G.sample_grid(p, d, g, F.col("x") + 0.0625, F.col("y") + 0.125).filter("surface is not null")
    pts = pts.select("point_id", (F.col("x") + 0.0625 - 0.05).alias("x"), (F.col("y") + 0.125 + 0.03).alias("y"), (F.col("surface") + 0.4 + F.col("o_custkey") % 5 / 100).alias("z"), "sigma", F.lit(2.0).alias("condition"))
    return G.register_to_dem(pts, d, g)


@query("aud_06_audit_registration", "fx_points", sql="""
with t as (select mode_id, (x-8)/16 as ex, (o_custkey%9-4)/16.0::double as ey, (z-10)/8 as ez, sigma*sigma as vx, 0.0625::double as vy, 2*sigma*sigma as vz from fx_points)
select mode_id, count(*) as trials, round(sqrt(avg(ex*ex+ey*ey+ez*ez)),6) as rmse, round(covar_samp(ex,ex),6) as cov_xx, round(covar_samp(ex,ey),6)+0.0 as cov_xy, round(covar_samp(ez,ez),6) as cov_zz,
 round(avg(case when ex*ex/vx+ey*ey/vy+ez*ez/vz<=6.2514 then 1.0 else 0 end),6) as coverage from t group by mode_id""")
def _(p):
    t = p.select("mode_id", ((F.col("x") - 8) / 16).alias("ex"), ((F.col("o_custkey") % 9 - 4) / 16).alias("ey"), ((F.col("z") - 10) / 8).alias("ez"),
                 (F.col("sigma") * F.col("sigma")).alias("vx"), F.lit(0.0625).alias("vy"), (2 * F.col("sigma") * F.col("sigma")).alias("vz"))
    a = G.audit_registration(t, ["mode_id"])
    return a.select("mode_id", "trials", *(r6(F.col(c)).alias(c) for c in ("rmse", "cov_xx", "cov_xy", "cov_zz", "coverage")))
