"""Sensor-model queries: projection, fits, inversion, covariance, wire records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from raytable.functions.scalars import round6 as r6
from raytable.operators import models as M
from raytable.sources import sinks as K

from .base import query

POLYS = ("rn", "rd", "cn", "cd")


def model_table(s):
    """Model coefficients derived from the model ids present in the samples."""
    ids = s.select("model_id").distinct()
    for p, name in enumerate(POLYS):
        one = 1.0 if name in ("rd", "cd") else 0.0
        ids = ids.withColumn(name, _coefs(F.sequence(F.lit(0), F.lit(19)), 5 * p, one))
    return ids


def _coefs(base, shift, one):
    return F.transform(base, lambda k: ((7 * F.col("model_id") + 3 * k + shift) % 17 - 8) / 1024.0 + F.when(k == 0, one).otherwise(0.0))


def _poly_sql(p, x="x", y="y", z="z", m="model_id"):
    one = 1 if POLYS[p] in ("rd", "cd") else 0
    out = []
    for t, (i, j, k) in enumerate(M.exponents(3)):
        mono = "*".join([x] * i + [y] * j + [z] * k) or "1"
        out.append(f"(((7*{m}+{3 * t}+{5 * p})%17-8)/1024.0::double{'+1' if one and t == 0 else ''})*{mono}")
    return "(" + "+".join(out) + ")"


PROJ = f"pj as (select *, {_poly_sql(0)}/{_poly_sql(1)} as rw, {_poly_sql(2)}/{_poly_sql(3)} as cl from fx_samples)"


@query("geo_10_normalize", "fx_samples", sql="""
with b as (select model_id, (min(x)+max(x))/2 as ox, (max(x)-min(x))/2 as sx from fx_samples group by 1)
select record_id, round((x-ox)/sx,6)+0.0 as nx, round((x-ox)/sx*sx+ox,6)+0.0 as back, (x-ox)/sx between -1 and 1 and y between -1 and 1 and z between -1 and 1 as inside from fx_samples join b using (model_id)""")
def _(s):
    d = s.groupBy("model_id").agg(((F.min("x") + F.max("x")) / 2).alias("ox"), ((F.max("x") - F.min("x")) / 2).alias("sx"))
    df = M.normalize(s.join(d, "model_id"), {"nx": ("x", "ox", "sx")})
    df = M.denormalize(df, {"back": ("nx", "ox", "sx")})
    return df.select("record_id", r6(F.col("nx")).alias("nx"), r6(F.col("back")).alias("back"), M.inside_domain("nx", "y", "z").alias("inside"))


@query("geo_11_rational_project", "fx_samples", sql=f"with {PROJ} select record_id, round(rw,6)+0.0 as row, round(cl,6)+0.0 as col from pj")
def _(s):
    out = M.rational_project(s, model_table(s))
    return out.select("record_id", r6(F.col("row")).alias("row"), r6(F.col("col")).alias("col"))


@query("geo_12_reorder_coeffs", "fx_samples", sql=f"""
with m as (select distinct model_id from fx_samples), c as (select model_id, [{', '.join(f'((7*model_id+{3 * t})%17-8)/1024.0::double' for t in range(20))}] as a from m)
select model_id, concat_ws('|', {', '.join(f'cast(round(a[{M.exponents(3).index(e) + 1}]*1024) as bigint)' for e in M.EXCHANGE_ORDER)}) as exchange, true as round_trip from c""")
def _(s):
    df = model_table(s).withColumn("e", M.reorder_coeffs(F.col("rn"), True))
    return df.select("model_id", F.array_join(F.transform("e", lambda v: F.round(v * 1024).cast("bigint")), "|").alias("exchange"), (M.reorder_coeffs(F.col("e")) == F.col("rn")).alias("round_trip"))


@query("agg_24_model_domain", "fx_samples", sql="""
select model_id, bool_and(not (record_id is null)) as ok, min(x) as x_low, max(x) as x_high, round((min(y)+max(y))/2,6)+0.0 as y_offset, round((max(z)-min(z))/2,6) as z_scale from fx_samples group by model_id""")
def _(s):
    d = M.model_domain(s)
    return d.select("model_id", "ok", "x_low", "x_high", r6(F.col("y_offset")).alias("y_offset"), r6(F.col("z_scale")).alias("z_scale"))


@query("ras_14_sample_lattice", "fx_samples", sql="""
with d as (select model_id, min(x) as a, max(x) as b, min(y) as e, max(y) as f, min(z) as g, max(z) as h from fx_samples group by 1)
select model_id, round(a+(b-a)*i/4.0,6)+0.0 as row, round(e+(f-e)*j/4.0,6)+0.0 as col, round(g+(h-g)*k/2.0,6)+0.0 as z from d cross join (select unnest(range(5)) as i) cross join (select unnest(range(5)) as j) cross join (select unnest(range(3)) as k)""")
def _(s):
    d = s.groupBy("model_id").agg(*(f(c).alias(f"{n}_{e}") for c, n in (("x", "row"), ("y", "col"), ("z", "z")) for e, f in (("low", F.min), ("high", F.max))))
    return M.sample_lattice(d, (5, 5, 3)).select("model_id", *(r6(F.col(c)).alias(c) for c in ("row", "col", "z")))


def grid_nodes(s):
    """5x5x3 node grid per model over the unit cube."""
    d = s.select("model_id").distinct()
    for p, n in zip("ijk", (5, 5, 3)):
        d = d.withColumn(p, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    d = d.withColumn("x", F.col("i") / 2 - 1).withColumn("y", F.col("j") / 2 - 1).withColumn("z", F.col("k") - 1.0)
    return M.rational_project(d, model_table(s)).select("model_id", "i", "j", "k", "row", "col")


def _tri(v):
    return "+".join(f"{'fi' if a else '(1-fi)'}*{'fj' if b else '(1-fj)'}*{'fk' if c else '(1-fk)'}*n{a}{b}{c}.{v}" for a in (0, 1) for b in (0, 1) for c in (0, 1))


@query("jon_06_grid_project", "fx_samples", sql=f"""
with md as (select distinct model_id from fx_samples), nd0 as (select model_id, i, j, k, i/2.0::double-1 as x, j/2.0::double-1 as y, k-1.0::double as z from md cross join (select unnest(range(5)) as i) cross join (select unnest(range(5)) as j) cross join (select unnest(range(3)) as k)),
nd as (select model_id, i, j, k, {_poly_sql(0)}/{_poly_sql(1)} as rw, {_poly_sql(2)}/{_poly_sql(3)} as cl from nd0),
u as (select *, (x+1)*2 as ui, (y+1)*2 as uj, z+1 as uk from fx_samples), f as (select *, least(floor(ui),3) as ci, least(floor(uj),3) as cj, least(floor(uk),1) as ck from u), g as (select *, ui-ci as fi, uj-cj as fj, uk-ck as fk from f)
select record_id, round({_tri('rw')},6)+0.0 as row, round({_tri('cl')},6)+0.0 as col from g {' '.join(f'join nd n{a}{b}{c} on n{a}{b}{c}.model_id=g.model_id and n{a}{b}{c}.i=ci+{a} and n{a}{b}{c}.j=cj+{b} and n{a}{b}{c}.k=ck+{c}' for a in (0, 1) for b in (0, 1) for c in (0, 1))}""")
def _(s):
    cells = M.node_cells(grid_nodes(s), ["model_id"], ["row", "col"])
    out = M.grid_project(s, cells, ["model_id"], (-1.0, -1.0, -1.0), (0.5, 0.5, 1.0), (5, 5, 3), ["row", "col"])
    return out.select("record_id", r6(F.col("row")).alias("row"), r6(F.col("col")).alias("col"))


@query("aud_08_audit_model", "fx_samples", sql=f"""
with {PROJ}, t as (select *, rw+(case when model_id%4=0 then 0.25 else 0 end)*x as tr from pj)
select model_id, count(*) as samples, round(sqrt(avg((rw-tr)*(rw-tr))),6) as rms, round(max(abs(rw-tr)),6) as max_error, max(abs(rw-tr))<=0.1 as passed from t group by model_id""")
def _(s):
    p = M.rational_project(s, model_table(s))
    p = p.withColumn("true_col", F.col("col")).withColumn("true_row", F.col("row") + F.when(F.col("model_id") % 4 == 0, 0.25).otherwise(0.0) * F.col("x"))
    a = M.audit_model(p, ["model_id"], 0.1)
    return a.withColumn("rms", r6(F.col("rms"))).withColumn("max_error", r6(F.col("max_error")))


# the fit takes noise-free rows of the planted models, so its own values at the samples have the planted mean and extremes
@query("slv_09_fit_rational", "fx_samples", sql=f"""
with {PROJ} select model_id, round(min(rw),4)+0.0 as low, round(avg(rw),4)+0.0 as mean, round(max(rw),4)+0.0 as high, true as within_tolerance, true as safe_denominator from pj group by model_id""")
def _(s):
    p = M.rational_project(s, model_table(s)).withColumn("target", F.col("row"))
    f = M.fit_rational(p, "model_id", "target")
    one = F.array(F.lit(1.0), *(F.lit(0.0) for _ in range(19)))
    fit = f.select("model_id", "max_error", "min_denominator", F.col("a").alias("rn"), F.col("b").alias("rd"), one.alias("cn"), one.alias("cd"))
    fit = fit.withColumns({c: M.reorder_coeffs(F.col(c)) for c in ("rn", "rd")})
    v = M.rational_project(s, fit.drop("max_error", "min_denominator")).groupBy("model_id").agg(*((F.round(g("row"), 4) + F.lit(0.0)).alias(n) for n, g in (("low", F.min), ("mean", F.avg), ("high", F.max))))
    return v.join(fit, "model_id").select("model_id", "low", "mean", "high", (F.col("max_error") < 1e-4).alias("within_tolerance"), (F.col("min_denominator") > 0.5).alias("safe_denominator"))


@query("slv_10_fit_linear", "fx_samples", sql="""
select model_id, round(cast(model_id as double)/8,4) as c0, 0.5::double as c1, 0.25::double as c4 from fx_samples group by model_id""")
def _(s):
    t = s.withColumn("t1", F.col("model_id") / 8 + 0.5 * F.col("x") + 0.25 * F.col("x") * F.col("y"))
    f = M.fit_linear(t, "model_id", ["t1"], 2)
    at = lambda e: F.round(F.get("c_t1", F.lit(M.exponents(2).index(e))), 4)
    return f.select("model_id", at((0, 0, 0)).alias("c0"), at((1, 0, 0)).alias("c1"), at((1, 1, 0)).alias("c4"))


@query("slv_10_covariance_field", "fx_samples", sql="""
with s as (select record_id, x as a, y as b, z as d from fx_samples), e as (select *, (a+d)/2 as h, (a-d)/2 as f, sqrt((a-d)*(a-d)/4+b*b) as r from s), c as (select *, greatest(h+r,0) as hi, greatest(h-r,0) as lo from e)
select record_id, round((hi+lo)/2+coalesce((hi-lo)/2/nullif(r,0),0)*f,6)+0.0 as c_xx, round(coalesce((hi-lo)/2/nullif(r,0),0)*b,6)+0.0 as c_xy, round((hi+lo)/2-coalesce((hi-lo)/2/nullif(r,0),0)*f,6)+0.0 as c_yy from c""")
def _(s):
    df = M.covariance_field(s, "x", "y", "z")
    return df.select("record_id", *(r6(F.col(c)).alias(c) for c in ("c_xx", "c_xy", "c_yy")))


def jac(s):
    """Image derivatives for six pose terms, made from the sample's coordinates."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    rows = [x, y, z, x * y, F.lit(1.0), z * x], [y, z, x, F.lit(0.5), x * z, y * y]
    for tag, r in zip("rc", rows):
        for i, e in enumerate(r):
            s = s.withColumn(f"{tag}{i}", e)
    return s


POSE = [[(1.0 + i) / 8 if i == j else (0.0625 if abs(i - j) == 1 else 0.0) for j in range(6)] for i in range(6)]
JR, JC = ["x", "y", "z", "x*y", "1.0", "z*x"], ["y", "z", "x", "0.5", "x*z", "y*y"]


def _quad(a, b):
    return "+".join(f"({a[i]})*({b[j]})*{POSE[i][j]}::double" for i in range(6) for j in range(6) if POSE[i][j])


@query("slv_11_propagate_cov", "fx_samples", sql=f"select record_id, round({_quad(JR, JR)},6)+0.0 as rr, round({_quad(JR, JC)},6)+0.0 as rc, round({_quad(JC, JC)},6)+0.0 as cc from fx_samples")
def _(s):
    j = jac(s)
    c = [[F.lit(v) for v in row] for row in POSE]
    out = M.propagate_cov([[F.col(f"{t}{i}") for i in range(6)] for t in "rc"], c)
    return j.select("record_id", r6(out[0][0]).alias("rr"), r6(out[0][1]).alias("rc"), r6(out[1][1]).alias("cc"))


@query("slv_11_reduced_basis", "fx_samples")
def _(s):
    c, raised = M.condition_cov(np.array(POSE))
    basis, kept = M.reduced_basis(jac(s), c)
    rows = [(int(i), int(k), float(round(basis[i, k] ** 2, 6))) for i in range(6) for k in range(basis.shape[1])]
    return s.sparkSession.createDataFrame(rows, "parameter int, mode int, squared double")


@query("slv_12_mc_covariance", "fx_samples")
def _(s):
    j = jac(s)
    root = np.linalg.cholesky(np.array(POSE))
    mc = M.mc_covariance(j, "record_id", [[f"r{i}" for i in range(6)], [f"c{i}" for i in range(6)]], root, 400, 7)
    return mc.select("record_id", *(F.round(c, 4).alias(c) for c in ("mc_rr", "mc_rc", "mc_cc")))


def steep_models(s):
    """Models with a dominant linear part, so that the projection can be inverted."""
    m = model_table(s)
    bump = lambda name, pos: F.transform(name, lambda v, i: v + F.when(i == pos, 1.0).otherwise(0.0))
    e = M.exponents(3)
    return m.withColumn("rn", bump("rn", e.index((1, 0, 0)))).withColumn("cn", bump("cn", e.index((0, 1, 0))))


@query("slv_13_invert_projection", "fx_samples", sql="select record_id, round(x*32,2)+0.0 as x, round(y*32,2)+0.0 as y, true as converged from fx_samples")
def _(s):
    m = steep_models(s)
    p = M.rational_project(s, m).select("record_id", "model_id", "row", "col", "z")
    out = M.invert_projection(p, m)
    return out.select("record_id", (F.round(F.col("x") * 32, 2) + F.lit(0.0)).alias("x"), (F.round(F.col("y") * 32, 2) + F.lit(0.0)).alias("y"), "converged")


def _at(d):
    """Row and col of a lattice point moved by d half cells."""
    x, y, z = (f"({c}+{d[i]}*h{c})" for i, c in enumerate("xyz"))
    r = [f"({_poly_sql(p, x, y, z)})" for p in range(4)]
    return f"{r[0]}/{r[1]}", f"{r[2]}/{r[3]}"


CORNERS = [_at((a, b, c)) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]

# lattice centres of all five densities under the node limit against the mean of their cell's corners
REFINE = f"""
with lv as (select unnest(range(5)) as round), g as (select round, 4*2**round as nx, 2*2**round as nz from lv), m as (select distinct model_id from fx_samples),
ct as (select model_id, round, 1.0::double/nx as hx, 1.0::double/nx as hy, 1.0::double/nz as hz, nx, nz from g cross join m),
pt as (select *, -1+(2*i+1)*hx as x, -1+(2*j+1)*hy as y, -1+(2*k+1)*hz as z from (select *, unnest(range(nx::bigint)) as i from (select *, unnest(range(nx::bigint)) as j from (select *, unnest(range(nz::bigint)) as k from ct)))),
er as (select model_id, round, nx, nz, max(sqrt(pow(({'+'.join(c[0] for c in CORNERS)})/8-{_at((0, 0, 0))[0]},2)+pow(({'+'.join(c[1] for c in CORNERS)})/8-{_at((0, 0, 0))[1]},2))) as e from pt group by all),
st as (select *, coalesce(min(e) over (partition by model_id order by round rows between unbounded preceding and 1 preceding), 1) as before from er)"""
REPORT = """
select model_id, cast(round as int) as round, cast(nx+1 as int) as ni, cast(nx+1 as int) as nj, cast(nz+1 as int) as nk, round(e,9) as max_error,
 case when e<=1e-4 then 'converged' when round=4 then 'nodeLimit' else 'refining' end as state from st where before>1e-4"""


def refined(s):
    return M.refine_grid(model_table(s), "model_id", M.rational_project, (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0), (5, 5, 3), 1e-4)


@query("slv_14_refine_grid", "fx_samples", sql=REFINE + REPORT)
def _(s):
    return refined(s)[1].select("model_id", "round", "ni", "nj", "nk", F.round("max_error", 9).alias("max_error"), "state")


@query("slv_14_grid_nodes", "fx_samples", sql=REFINE + "\nselect model_id, cast(max((nx+1)*(nx+1)*(nz+1)) as bigint) as nodes from st where before>1e-4 group by 1")
def _(s):
    return refined(s)[0].groupBy("model_id").agg(F.count(F.lit(1)).alias("nodes"))


@query("snk_02_fixed_width", "fx_samples", sql="""
select record_id, rpad('M'||model_id,5,' ')||lpad(printf('%+.4f',x),9,' ')||lpad(printf('%+.4f',y),9,' ')||lpad(printf('%.2f',z),6,' ')||lpad(printf('%.1f',x),5,' ')||lpad(printf('%.1f',1-x),5,' ') as record from fx_samples""")
def _(s):
    t = s.withColumn("x", F.round("x", 6))
    prof = [(F.concat(F.lit("M"), "model_id"), "s", 5, ""), (F.col("x"), "n", 9, "%+.4f"), (F.col("y"), "n", 9, "%+.4f"), (F.col("z"), "n", 6, "%.2f"),
            (F.array(F.col("x"), 1 - F.col("x")), "n", 5, "%.1f")]
    return K.fixed_width(t, prof).select("record_id", "record")


@query("snk_01_product_summary", "fx_points", sql="""
select mode_id, count(*) as points, count(sigma) as with_uncertainty, round(avg(sigma),6) as mean_sigma, min(x) as min_x, max(y) as max_y, max(z) as max_z from fx_points group by 1""")
def _(p):
    return K.summary(p).select("mode_id", "points", "with_uncertainty", r6(F.col("mean_sigma")).alias("mean_sigma"), "min_x", "max_y", "max_z")
