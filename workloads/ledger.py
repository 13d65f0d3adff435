"""Filter stages, ledgers, residual summaries and selections over feature matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from raytable.functions import scalars as S
from raytable.functions.geometry import coplanarity
from raytable.functions.scalars import round6 as r6
from raytable.operators import ledger as L
from raytable.operators import quantiles as Q
from raytable.operators import selection as P
from raytable.operators import summaries as M
from raytable.operators.ordered import rank_rows

from .base import query
from .geometry import COPLANAR, ends

PAIR = ["moving_view", "reference_view"]
DX, DY = "reference_col - moving_col", "reference_row - moving_row"


def stages():
    return [
        ("descriptorScore", lambda d: L.score_mask(d, L.score_of(F.col("metric")), 0.9)),
        ("ratio", lambda d: L.ratio_mask(d, F.col("metric"), 0.1)),
        ("nativeDisplacement", lambda d: L.mad_displacement(d, PAIR, F.expr(DX), F.expr(DY), 1.5, 0.25)),
    ]


NAMES = ["descriptorScore", "ratio", "nativeDisplacement"]

PIPE = """a as (select *, 1/(1+metric)>=0.9 as m1, 1/(1+metric)>=0.9 and metric<=0.1 as m2,
 reference_col-moving_col as dx, reference_row-moving_row as dy from fx_matches),
med as (select moving_view, reference_view, count(*) as live, quantile_cont(dx,0.5) as mx, quantile_cont(dy,0.5) as my from a where m2 group by all),
b as (select a.*, live, sqrt((dx-mx)*(dx-mx)+(dy-my)*(dy-my)) as res from a left join med using (moving_view, reference_view)),
m1t as (select moving_view, reference_view, quantile_cont(res,0.5) as mr from b where m2 group by all),
m2t as (select moving_view, reference_view, quantile_cont(abs(res-mr),0.5) as mad from b join m1t using (moving_view, reference_view) where m2 group by all),
pipe as (select b.*, m2 and (live<3 or res<=mr+1.5*greatest(1.4826*mad,0.25)) as m3 from b
 left join m1t using (moving_view, reference_view) left join m2t using (moving_view, reference_view))"""


@query("flt_01_filter_stages", "fx_matches", sql=f"""
with {PIPE} select record_id, m1 as s1, m2 as s2, m3 as s3, case when m3 then 'accepted' else 'rejected' end as state,
 case when not m1 then 'descriptorScore' when not m2 then 'ratio' when not m3 then 'nativeDisplacement' else '' end as first_rejected_stage from pipe""")
def _(m):
    df = L.filter_pipeline(m, stages())
    return df.select("record_id", *(F.col(f"mask_{n}").alias(f"s{i + 1}") for i, n in enumerate(NAMES)), "state", "first_rejected_stage")


@query("flt_01_stage_counts", "fx_matches", sql=f"""
with {PIPE} select moving_view, reference_view, count(*) as initial, count_if(m1) as c1, count_if(m2) as c2, count_if(m3) as c3, count_if(m3) as final
from pipe group by all""")
def _(m):
    c = L.stage_counts(L.filter_pipeline(m, stages()), PAIR, NAMES)
    return c.select(*PAIR, "initial", *(F.col(n).alias(f"c{i + 1}") for i, n in enumerate(NAMES)), "final")


# a neutral stage marks and may name the first rejection of a live row, but does not change acceptance
@query("flt_02_apply_stage", "fx_matches", sql="""
select record_id, case when metric>0.1 then 'ratio' when moving_row>300 then 'spatialRedundancy' when l_returnflag='R' then 'roi' else '' end as first_rejected_stage,
 case when metric>0.1 then 'ratio' when moving_row>300 and l_returnflag='R' then 'spatialRedundancy|roi' when moving_row>300 then 'spatialRedundancy' when l_returnflag='R' then 'roi' else '' end as reasons,
 case when metric>0.1 or l_returnflag='R' then 'rejected' else 'accepted' end as state from fx_matches""")
def _(m):
    df = L.apply_stage(L.start_ledger(m), "ratio", F.col("metric") <= 0.1)
    df = L.apply_stage(df, "spatialSelection", F.col("moving_row") <= 300)
    df = L.apply_stage(df, "roi", F.col("accepted") & (F.col("l_returnflag") != "R"))
    return df.select("record_id", "first_rejected_stage", F.array_join("rejection_reasons", "|").alias("reasons"), "state")


@query("flt_03_score_and_ratio", "fx_matches", sql="""
select record_id, round(1/(1+metric),6) as score, 1/(1+metric)>=0.9 as score_ok, metric<=0.05 as ratio_ok from fx_matches""")
def _(m):
    a = L.score_mask(m, L.score_of(F.col("metric")), 0.9).withColumnRenamed("_mask", "score_ok")
    b = L.ratio_mask(a, F.col("metric"), 0.05).withColumnRenamed("_mask", "ratio_ok")
    return b.select("record_id", r6(L.score_of(F.col("metric"))).alias("score"), "score_ok", "ratio_ok")


@query("flt_04_overlap_mask", "fx_matches", "fx_pixels", sql="""
with c as (select r, c from fx_pixels where layer=0 and valid)
select record_id, exists(select 1 from c where c.r=floor(moving_row/4+0.5) and c.c=floor(moving_col/8+0.5))
 and exists(select 1 from c where c.r=floor(reference_row/4+0.5) and c.c=floor(reference_col/8+0.5)) as ok from fx_matches""")
def _(m, px):
    cells = px.filter("layer = 0 and valid")
    out = L.overlap_mask(m, cells, (F.col("moving_row") / 4, F.col("moving_col") / 8), (F.col("reference_row") / 4, F.col("reference_col") / 8))
    return out.select("record_id", F.col("_mask").alias("ok"))


@query("flt_05_mad_displacement", "fx_matches", sql="""
with a as (select *, reference_col-moving_col as dx, reference_row-moving_row as dy from fx_matches),
med as (select moving_view, reference_view, quantile_cont(dx,0.5) as mx, quantile_cont(dy,0.5) as my from a group by all),
b as (select a.*, sqrt((dx-mx)*(dx-mx)+(dy-my)*(dy-my)) as res from a join med using (moving_view, reference_view)),
m1 as (select moving_view, reference_view, quantile_cont(res,0.5) as mr from b group by all),
m2 as (select moving_view, reference_view, quantile_cont(abs(res-mr),0.5) as mad from b join m1 using (moving_view, reference_view) group by all)
select record_id, res<=mr+1.25*greatest(1.4826*mad,0.5) and sqrt(dx*dx+dy*dy)<=3 as ok from b join m1 using (moving_view, reference_view) join m2 using (moving_view, reference_view)""")
def _(m):
    return L.mad_displacement(L.start_ledger(m), PAIR, F.expr(DX), F.expr(DY), 1.25, 0.5, 3.0).select("record_id", F.col("_mask").alias("ok"))


@query("flt_06_coplanarity_filter", "fx_records", sql=f"""
with {COPLANAR}, v as (select record_id, view_a, view_b, case when st='valid' then num/den end as res from cop),
m1 as (select view_a, view_b, count(res) as n, quantile_cont(res,0.5) as mr from v where res is not null group by all),
m2 as (select view_a, view_b, quantile_cont(abs(res-mr),0.5) as mad from v join m1 using (view_a, view_b) where res is not null group by all)
select record_id, coalesce(case when res is null then false when n<3 then true else abs(res-mr)<=least(3*greatest(1.4826*mad,0.001),0.02) end,false) as ok
from v left join m1 using (view_a, view_b) left join m2 using (view_a, view_b)""")
def _(rec):
    df = L.start_ledger(coplanarity(rec, *ends()))
    return L.coplanarity_filter(df, ["view_a", "view_b"], F.col("coplanarity"), 3.0, 1e-3, 0.02).select("record_id", F.col("_mask").alias("ok"))


@query("flt_08_select_points", "fx_points", sql="""
select point_id, case when o_custkey%11=0 then 'invalidPoint' when x between 2 and 12 and z between 8 and 10.5 then '' else 'outsideRoi' end as reason from fx_points""")
def _(p):
    out = L.select_points(p, {"x": (2.0, 12.0), "z": (8.0, 10.5)}, F.col("o_custkey") % 11 != 0)
    return out.select("point_id", F.col("selection_reason").alias("reason"))


@query("flt_10_uncertainty_filter", "fx_points", sql="select point_id, sigma from fx_points where sigma<=0.25")
def _(p):
    return L.uncertainty_filter(p, "sigma", 0.25).select("point_id", "sigma")


@query("flt_11_safe_policy", "fx_solves", sql="""
with d as (select *, (rms_after-rms_before)/rms_before>0.05 as deg, (rms_before-rms_after)/rms_before as gain from fx_solves),
h as (select *, concat_ws('|', case when not converged then 'notConverged' end, case when min_match_count<3 then 'tooFewObservations' end,
 case when bound_hit then 'boundHit' end, case when unobservable then 'unobservableMode' end, case when deg then 'residualDegraded' end) as hard,
 concat_ws('|', case when min_match_count between 3 and 7 then 'fewObservations' end, case when not deg and gain<0.1 then 'smallImprovement' end) as warn from d)
select solve_id, hard, warn, case when hard<>'' then 'rejected' when warn<>'' then 'review' else 'passed' end as decision from h""")
def _(s):
    df = L.safe_policy(s, improvement=0.1)
    return df.select("solve_id", F.array_join("hard_reasons", "|").alias("hard"), F.array_join("warnings", "|").alias("warn"), "decision")


@query("flt_13_roi_stage", "fx_matches", sql="""
select record_id, moving_row between 100 and 300 and moving_col between 50 and 400 as roi,
 case when moving_row between 100 and 300 and moving_col between 50 and 400 then '' else 'roi' end as first_rejected_stage from fx_matches""")
def _(m):
    df = L.roi_stage(L.start_ledger(m), (50.0, 400.0, 100.0, 300.0), "moving_col", "moving_row")
    return df.select("record_id", F.col("mask_roi").alias("roi"), "first_rejected_stage")


@query("flt_14_curation_stage", "fx_matches", "fx_li", sql="""
with e as (select record_id, l_linenumber*2+1 as seq, case when disc%3=0 then 'disabled' when disc%3=1 then 'enabled' else 'deleted' end as action from fx_li where tax>=4
 union all select record_id, l_linenumber*2+2 as seq, case when tax%2=0 then 'enabled' else 'disabled' end as action from fx_li where tax>=6),
l as (select record_id, max_by(action, seq) as action from e group by record_id)
select m.record_id, case when action in ('disabled','deleted') then action when metric>0.1 then 'rejected' else 'accepted' end as state,
 metric<=0.1 and coalesce(action,'enabled')='enabled' as eligible from fx_matches m left join l using (record_id)""")
def _(m, li):
    e1 = li.filter("tax >= 4").select("record_id", (F.col("l_linenumber") * 2 + 1).alias("seq"),
                                      F.when(F.col("disc") % 3 == 0, "disabled").when(F.col("disc") % 3 == 1, "enabled").otherwise("deleted").alias("action"))
    e2 = li.filter("tax >= 6").select("record_id", (F.col("l_linenumber") * 2 + 2).alias("seq"),
                                      F.when(F.col("tax") % 2 == 0, "enabled").otherwise("disabled").alias("action"))
    df = L.apply_stage(L.start_ledger(m), "ratio", F.col("metric") <= 0.1)
    df = L.curation_stage(df, e1.unionByName(e2))
    return df.select("record_id", "state", F.col("edge_eligible").alias("eligible"))


@query("set_01_combine_ledgers", "fx_matches", sql="""
select l_returnflag, count(*) as n, count(case when l_returnflag='R' then metric end) as with_extra, sum(metric) as total from fx_matches group by l_returnflag""")
def _(m):
    parts = [L.start_ledger(m.filter(F.col("l_returnflag") == f)) for f in "ANR"]
    parts[2] = parts[2].withColumn("extra", F.col("metric"))
    return L.combine_ledgers(*parts).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("with_extra"), F.sum("metric").alias("total"))


@query("aud_09_stage_funnel", "fx_matches", sql=f"""
with {PIPE}, c as (select moving_view, reference_view, count(*) as c0, count_if(m1) as c1, count_if(m2) as c2, count_if(m3) as c3 from pipe group by all)
select moving_view, reference_view, 0 as position, 'initial' as stage, c0 as survivors from c union all
select moving_view, reference_view, 1, 'descriptorScore', c1 from c union all select moving_view, reference_view, 2, 'ratio', c2 from c union all
select moving_view, reference_view, 3, 'nativeDisplacement', c3 from c union all select moving_view, reference_view, 4, 'final', c3 from c""")
def _(m):
    return L.stage_funnel(L.stage_counts(L.filter_pipeline(m, stages()), PAIR, NAMES), PAIR, NAMES)


# before/after residuals of a match, dyadic
RES = "abs(reference_row-moving_row) as before, abs(reference_col-moving_col)/2 as after"


def with_residuals(m):
    return m.selectExpr("*", *[s.strip() for s in RES.split(",")])


@query("jon_14_attach_residuals", "fx_matches", sql=f"""
select record_id, case when metric<=0.1 then 'solverObservation' else 'accepted' end as state,
 case when metric<=0.1 then before end as ray_before, case when metric<=0.1 then after end as ray_after, cast(null as double) as plane_before
from (select *, {RES} from fx_matches)""")
def _(m):
    res = with_residuals(m).filter("metric <= 0.1").select("record_id", "before", "after")
    df = L.attach_residuals(L.start_ledger(m), res, "rayToRay3D")
    return df.select("record_id", "state", "ray_before", "ray_after", "plane_before")


@query("agg_02_residual_summary", "fx_matches", sql=f"""
with r as (select *, {RES} from fx_matches), k as (
 select moving_view||':'||case when moving_row>256.5 then 'bottom' else 'top' end||case when moving_col>256.5 then 'right' else 'left' end as key, before, after from r
 union all select reference_view||':'||case when reference_row>256.5 then 'bottom' else 'top' end||case when reference_col>256.5 then 'right' else 'left' end, before, after from r)
select key, count(*) as n, round(sqrt(avg(before*before)),6) as rms_before, round(sqrt(avg(after*after)),6) as rms_after, max(before) as max_before, max(after) as max_after from k group by key""")
def _(m):
    q = lambda v, r, c: M.view_quadrant(F.col(v), F.col(r), F.col(c), 512, 512)
    keys = F.array(q("moving_view", "moving_row", "moving_col"), q("reference_view", "reference_row", "reference_col"))
    s = M.residual_summary(with_residuals(m), keys)
    return s.withColumn("rms_before", r6(F.col("rms_before"))).withColumn("rms_after", r6(F.col("rms_after")))


@query("agg_03_per_pair_summary", "fx_matches", sql=f"""
with r as (select *, {RES} from fx_matches), w as (select *, row_number() over (partition by moving_view, reference_view order by before desc, record_id) as b,
 row_number() over (partition by moving_view, reference_view order by after desc, record_id) as a from r)
select moving_view, reference_view, count(*) as n, round(sqrt(avg(before*before)),6) as rms_before, round(sqrt(avg(after*after)),6) as rms_after,
 max(before) as max_before, max(after) as max_after, max(case when b=1 then record_id end) as worst_before, max(case when a=1 then record_id end) as worst_after from w group by all""")
def _(m):
    s = M.per_pair_summary(with_residuals(m), PAIR, "record_id")
    return s.withColumn("rms_before", r6(F.col("rms_before"))).withColumn("rms_after", r6(F.col("rms_after")))


@query("agg_04_concentration", "fx_matches", sql=f"""
with r as (select *, {RES} from fx_matches), s as (select moving_view, sqrt(avg(after*after))*(1+(case when moving_view='v3' then 9 else 0 end)) as rms from r group by moving_view)
select (select moving_view from s order by rms desc, moving_view limit 1) as group_id, round(max(rms)/quantile_cont(rms,0.5),6) as ratio,
 count(*)>1 and max(rms)/quantile_cont(rms,0.5)>=2 as concentrated from s""")
def _(m):
    s = M.residual_summary(with_residuals(m), F.col("moving_view"), name="moving_view")
    s = s.withColumn("rms_after", F.col("rms_after") * F.when(F.col("moving_view") == "v3", 10).otherwise(1))
    out = M.concentration(s, "moving_view")
    return out.withColumn("ratio", r6(F.col("ratio")))


@query("agg_05_residual_stats", "fx_matches", sql="""
with r as (select moving_view, (reference_row-moving_row)/4 as x from fx_matches), m as (select moving_view, quantile_cont(x,0.5) as med from r group by 1)
select moving_view, count(*) as n, round(avg(x),6)+0.0 as mean, quantile_cont(x,0.5) as median, round(sqrt(avg(x*x)),6) as rms,
 quantile_cont(abs(x-med),0.5) as mad, quantile_disc(abs(x),0.95) as p95_abs, max(abs(x)) as max_abs from r join m using (moving_view) group by moving_view""")
def _(m):
    s = Q.residual_stats(m, ["moving_view"], (F.col("reference_row") - F.col("moving_row")) / 4)
    return s.withColumn("mean", r6(F.col("mean"))).withColumn("rms", r6(F.col("rms")))


@query("agg_06_percentiles", "lineitem", sql="""
with s as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) as k, count(*) over (partition by l_returnflag) as n from lineitem),
t as (select l_returnflag, v, k, least(n,greatest(1,0.9*n+0.5)) as pos from s)
select l_returnflag, round(quantile_disc(v,0.95),4) as nearest, round(quantile_cont(v,0.25),4) as linear,
 round(max(case when k=floor(pos) then v end)+(max(pos)-floor(max(pos)))*(max(case when k=floor(pos)+1 then v end)-max(case when k=floor(pos) then v end)),4) as midpoint
from t group by l_returnflag""")
def _(li):
    p = Q.pctl(li, ["l_returnflag"], F.col("l_extendedprice"), {"nearest": (0.95, "nearest"), "linear": (0.25, "linear"), "midpoint": (0.9, "midpoint")})
    return p.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("nearest", "linear", "midpoint")))


@query("agg_07_weighted_median", "lineitem", sql="""
with c as (select l_returnflag, l_extendedprice as v, sum(l_quantity) over (partition by l_returnflag order by l_extendedprice) as cum, sum(l_quantity) over (partition by l_returnflag) as tot from lineitem)
select l_returnflag, min(v) as weighted_median from c where cum>=tot/2 group by l_returnflag""")
def _(li):
    return Q.weighted_median(li, ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("agg_08_position_like_residual", "fx_matches", sql=f"""
with r as (select *, {RES} from fx_matches)
select moving_view, round(corr(after,moving_row),6)+0.0 as c1, round(corr(after,moving_col),6)+0.0 as c2, round(corr(after,reference_row),6)+0.0 as c3, round(corr(after,reference_col),6)+0.0 as c4,
 greatest(abs(corr(after,moving_row)),abs(corr(after,moving_col)),abs(corr(after,reference_row)),abs(corr(after,reference_col)))>=0.5 as detected, round(regr_slope(after,moving_row),6)+0.0 as slope
from r group by moving_view""")
def _(m):
    m = with_residuals(m)
    cs = ["moving_row", "moving_col", "reference_row", "reference_col"]
    p = M.position_like_residual(m, ["moving_view"], "after", cs)
    s = M.slope_and_correlation(m, ["moving_view"], "after", "moving_row").drop("corr")
    return p.join(s, "moving_view").select("moving_view", *(r6(F.col(f"corr_{c}")).alias(f"c{i + 1}") for i, c in enumerate(cs)), "detected", r6(F.col("slope")).alias("slope"))


REGION_SQL = """s as (select moving_view, cast(floor((moving_col-1)/64) as bigint) as region_x, cast(floor((moving_row-1)/64) as bigint) as region_y,
 moving_col-reference_col as dx, moving_row-reference_row as dy, metric*16 as uncertainty, 8+metric as depth from fx_matches where metric<=0.01),
reg as (select distinct moving_view, cast(floor((moving_col-1)/64) as bigint) as region_x, cast(floor((moving_row-1)/64) as bigint) as region_y from fx_matches)"""


def seeds_regions(m):
    b = lambda c: F.floor((F.col(c) - 1) / 64).cast("bigint")
    keyed = m.withColumn("region_x", b("moving_col")).withColumn("region_y", b("moving_row"))
    seeds = keyed.filter("metric <= 0.01").selectExpr("record_id", "moving_view", "region_x", "region_y", "moving_col", "moving_row", "moving_col-reference_col as dx",
                                                      "moving_row-reference_row as dy", "metric*16 as uncertainty", "8+metric as depth")
    return seeds, keyed.select("moving_view", "region_x", "region_y").distinct()


@query("agg_14_region_priors", "fx_matches", sql=f"""
with {REGION_SQL}, lm as (select moving_view, region_x, region_y, count(*) as n, quantile_cont(dx,0.5) as cx, quantile_cont(dy,0.5) as cy from s group by all),
lp as (select moving_view, region_x, region_y, any_value(n) as n, any_value(cx) as cx, any_value(cy) as cy, greatest(1, max(uncertainty), max(sqrt((dx-cx)*(dx-cx)+(dy-cy)*(dy-cy)))) as unc, min(dx) as x0, max(dx) as x1 from s join lm using (moving_view, region_x, region_y) group by all),
gm as (select moving_view, quantile_cont(dx,0.5) as cx, quantile_cont(dy,0.5) as cy from s group by all),
gp as (select moving_view, any_value(cx) as cx, greatest(1, max(uncertainty), max(sqrt((dx-cx)*(dx-cx)+(dy-cy)*(dy-cy)))) as unc, min(dx) as x0, max(dx) as x1 from s join gm using (moving_view) group by all)
select reg.*, case when coalesce(lp.n,0)>=3 then 'seeded' when gp.unc is not null then 'unseeded' else 'noSupport' end as state, coalesce(lp.n,0) as seed_count,
 round(case when coalesce(lp.n,0)>=3 then lp.cx else gp.cx end,6)+0.0 as disparity_x,
 round(case when coalesce(lp.n,0)>=3 then lp.x0-4-lp.unc else gp.x0-16-gp.unc end,6)+0.0 as x_low,
 round(case when coalesce(lp.n,0)>=3 then lp.x1+4+lp.unc else gp.x1+16+gp.unc end,6)+0.0 as x_high
from reg left join lp using (moving_view, region_x, region_y) left join gp using (moving_view)""")
def _(m):
    seeds, regions = seeds_regions(m)
    out = M.region_priors(seeds, regions, ["moving_view"])
    return out.select("moving_view", "region_x", "region_y", "state", "seed_count", *(r6(F.col(c)).alias(c) for c in ("disparity_x", "x_low", "x_high")))


@query("jon_09_seeds_by_region", "fx_matches", sql=f"""
with {REGION_SQL} select moving_view, region_x, region_y, count(dx) as seeds, sum(dx) as total from reg left join s using (moving_view, region_x, region_y) group by all""")
def _(m):
    seeds, regions = seeds_regions(m)
    out = M.seeds_by_region(seeds.drop("region_x", "region_y"), regions, ["moving_view"], "moving_col", "moving_row", 64)
    return out.groupBy("moving_view", "region_x", "region_y").agg(F.count("dx").alias("seeds"), F.sum("dx").alias("total"))


@query("agg_15_pair_confidence", "fx_matches", sql="""
with g as (select moving_view, reference_view, count(*) as n, least(count(distinct moving_feature), count(distinct reference_feature)) as feats, count_if(metric<=0.05) as ov from fx_matches group by all)
select moving_view, reference_view, round(least(1,greatest(0,0.6*least(1,n/50)+0.2*(n/greatest(feats,10))+0.2*least(1,ov/100))),6) as confidence from g""")
def _(m):
    g = m.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.least(F.countDistinct("moving_feature"), F.countDistinct("reference_feature")).alias("f"), F.count_if(F.col("metric") <= 0.05).alias("ov"))
    return g.select(*PAIR, r6(M.pair_confidence(F.col("n"), F.col("f"), F.col("ov"))).alias("confidence"))


@query("agg_17_coverage", "fx_matches", sql="""
select moving_view, reference_view, count(*) as n, case when count(*)<2 then 0 else round(least(1,(max(moving_col)-min(moving_col))/640)*least(1,(max(moving_row)-min(moving_row))/480),6) end as coverage from fx_matches group by all""")
def _(m):
    out = M.coverage(m, PAIR, F.col("moving_col"), F.col("moving_row"), F.lit(640.0), F.lit(480.0))
    return out.withColumn("coverage", r6(F.col("coverage")))


def _info_sql():
    c = ["moving_col", "moving_row", "reference_col", "reference_row"]
    z = ["1.0"] + [f"(({k}-m{i})/s{i})" for i, k in enumerate(c)]
    sums = ", ".join(f"sum({z[i]}*{z[j]}){'+1e-12' if i == j else ''} as n{i}{j}" for i in range(5) for j in range(i, 5))
    steps, prev = [], "nn"
    for j in range(5):
        piv = f"sqrt(n{j}{j}" + "".join(f"-l{j}{k}*l{j}{k}" for k in range(j)) + f") as l{j}{j}"
        steps.append(f"p{j} as (select *, {piv} from {prev})")
        cols = [f"(n{j}{i}" + "".join(f"-l{i}{k}*l{j}{k}" for k in range(j)) + f")/l{j}{j} as l{i}{j}" for i in range(j + 1, 5)]
        steps.append(f"q{j} as (select *{''.join(', ' + x for x in cols)} from p{j})")
        prev = f"q{j}"
    return (f"with st as (select moving_view, {', '.join(f'avg({k}) as m{i}, greatest(max({k})-min({k}),1) as s{i}' for i, k in enumerate(c))} from fx_matches group by 1),"
            f"nn as (select moving_view, count(*) as n, {sums} from fx_matches join st using (moving_view) group by 1), {', '.join(steps)}"
            f" select moving_view, n, round(2*(ln(l00)+ln(l11)+ln(l22)+ln(l33)+ln(l44)),4) as log_det, round(n11,5) as n11, round(n12,5)+0.0 as n12 from {prev}")


@query("agg_18_information", "fx_matches", sql=_info_sql())
def _(m):
    out = M.information(m, ["moving_view"], ["moving_col", "moving_row", "reference_col", "reference_row"])
    return out.select("moving_view", "n", F.round("log_det", 4).alias("log_det"), F.round("n11", 5).alias("n11"), (F.round("n12", 5) + F.lit(0.0)).alias("n12"))


@query("ras_11_disparity_range", "fx_matches", sql="""
with a as (select moving_view, reference_view, (reference_row-moving_row)*l as d, w from (select *, 8+60*(cast(substr(moving_view,2) as int)%2) as l, 1000-80*cast(substr(reference_view,2) as int) as w from fx_matches)),
g as (select moving_view, reference_view, floor(min(d)-32) as a1, ceil(max(d)+32) as b1, quantile_cont(d,0.5) as mid, max(w)-1 as lim from a group by all),
h as (select *, case when b1-a1>256 then floor(mid-128) else a1 end as a2, case when b1-a1>256 then ceil(mid+128) else b1 end as b2 from g),
k as (select *, least(greatest(a2,-lim),lim) as a3, least(greatest(b2,-lim),lim) as b3 from h)
select moving_view, reference_view, cast(case when b3-a3<16 then least(greatest(floor((a3+b3)/2-8),-lim),lim) else a3 end as bigint) as low,
 cast(case when b3-a3<16 then least(greatest(ceil((a3+b3)/2+8),-lim),lim) else b3 end as bigint) as high from k""")
def _(m):
    num = lambda c: F.substring(c, 2, 9).cast("int")
    a = m.withColumn("d", (F.col("reference_row") - F.col("moving_row")) * (8 + 60 * (num("moving_view") % 2))).withColumn("w", 1000 - 80 * num("reference_view"))
    return M.disparity_range(a, PAIR, "d", F.col("w"))


def _evidence_sql(cap):
    return f"""
with z0 as (select *, 1/(1+metric) as score from fx_matches),
st as (select moving_view, count(*) as n, min(score) as qlo, max(score) as qhi, min(moving_col) as a0, max(moving_col) as a1, min(moving_row) as b0, max(moving_row) as b1,
 min(reference_col) as c0, max(reference_col) as c1, min(reference_row) as d0, max(reference_row) as d1 from z0 group by 1),
z1 as (select z0.*, n, (score-qlo)/(qhi-qlo) as q, (moving_col-a0)/(a1-a0) as ua, (moving_row-b0)/(b1-b0) as ub, (reference_col-c0)/(c1-c0) as uc, (reference_row-d0)/(d1-d0) as ud from z0 join st using (moving_view)),
z2 as (select *, q+0.25*((ua-0.5)*(ua-0.5)+(ub-0.5)*(ub-0.5)+(uc-0.5)*(uc-0.5)+(ud-0.5)*(ud-0.5)) as s,
 least(4,floor(ua*4)+1)*10+least(4,floor(ub*4)+1) as cm, least(4,floor(uc*4)+1)*10+least(4,floor(ud*4)+1) as cr from z1),
z3 as (select *, row_number() over (partition by moving_view, cm order by s desc, record_id)=1 or row_number() over (partition by moving_view, cr order by s desc, record_id)=1 as cover,
 row_number() over (partition by moving_view order by moving_col, record_id)=1 or row_number() over (partition by moving_view order by moving_col desc, record_id)=1
 or row_number() over (partition by moving_view order by moving_row, record_id)=1 or row_number() over (partition by moving_view order by moving_row desc, record_id)=1
 or row_number() over (partition by moving_view order by reference_col, record_id)=1 or row_number() over (partition by moving_view order by reference_col desc, record_id)=1
 or row_number() over (partition by moving_view order by reference_row, record_id)=1 or row_number() over (partition by moving_view order by reference_row desc, record_id)=1 as forced from z2),
z4 as (select *, row_number() over (partition by moving_view order by cover desc, s desc, record_id)<={cap} as keep, greatest({cap}, count_if(forced) over (partition by moving_view)) as lim from z3),
z5 as (select *, row_number() over (partition by moving_view order by forced desc, s desc, record_id) as t from z4 where keep or forced)
select moving_view, record_id from z5 where t<=lim"""


@query("win_01_select_evidence", "fx_matches", sql=_evidence_sql(60))
def _(m):
    m = m.withColumn("score", L.score_of(F.col("metric")))
    out = P.select_evidence(m, ["moving_view"], "record_id", "score", ("moving_col", "moving_row"), ("reference_col", "reference_row"), (4, 4), 60)
    return out.filter("selected").select("moving_view", "record_id")


@query("win_02_select_spatially", "fx_matches", sql="""
with z as (select *, (least(10,floor((moving_col+0.5)/512*10)+1)-1)*10+least(10,floor((moving_row+0.5)/512*10)+1) as cell from fx_matches),
q as (select *, row_number() over (partition by moving_view, cell order by metric, moving_row, moving_col, record_id) as q from z),
r as (select *, row_number() over (partition by moving_view order by q, metric, moving_row, moving_col, record_id) as r from q)
select moving_view, record_id from r where r<=100""")
def _(m):
    m = m.withColumn("x", F.col("moving_col") + 1).withColumn("y", F.col("moving_row") + 1)
    out = P.select_spatially(m, ["moving_view"], 100, "x", "y", 512, 512, [F.col(c) for c in ("metric", "moving_row", "moving_col", "record_id")])
    return out.select("moving_view", "record_id")


@query("win_05_decimate", "fx_points", sql="""
with r as (select point_id, mode_id, row_number() over (partition by mode_id order by o_orderkey) as rn, count(*) over (partition by mode_id) as n from fx_points),
k as (select unnest(range(0,500)) as k), t as (select distinct mode_id, cast(round(1+k*((n-1)/cast(499 as double))) as bigint) as rn from k cross join (select distinct mode_id, n from r))
select r.mode_id, point_id from r semi join t on r.mode_id=t.mode_id and r.rn=t.rn""")
def _(p):
    return P.decimate(p, ["mode_id"], ["o_orderkey"], 500).select("mode_id", "point_id")


@query("win_10_gap_sessions", "fx_matches", sql="""
with d as (select distinct moving_view, moving_row from fx_matches), g as (select *, case when moving_row-lag(moving_row) over (partition by moving_view order by moving_row)<=0.2 then 0 else 1 end as nw from d),
s as (select moving_view, moving_row, sum(nw) over (partition by moving_view order by moving_row) as session from g)
select moving_view, cast(session as bigint) as session, count(*) as n, min(moving_row) as lo, max(moving_row) as hi from fx_matches join s using (moving_view, moving_row) group by all""")
def _(m):
    from raytable.operators.ordered import gap_sessions

    s = gap_sessions(m.select("moving_view", "moving_row", "record_id"), ["moving_view"], "moving_row", ["record_id"], 0.2)
    return s.groupBy("moving_view", "session").agg(F.count(F.lit(1)).alias("n"), F.min("moving_row").alias("lo"), F.max("moving_row").alias("hi"))


@query("top_01_quality_order", "fx_matches", sql="""
select moving_view, record_id, row_number() over (partition by moving_view order by case when l_returnflag='N' then null else metric end asc nulls last, record_id) as place from fx_matches""")
def _(m):
    m = m.withColumn("known", F.when(F.col("l_returnflag") != "N", F.col("metric"))).withColumn("last", F.col("known").isNull())
    return rank_rows(m, ["moving_view"], ["last", "known", "record_id"], "place").select("moving_view", "record_id", "place")


@query("top_04_split_budget", "fx_matches", sql="""
with p as (select concat(moving_view,'|',reference_view) as pair_id, count(*) as available from fx_matches group by 1), r as (select *, row_number() over (order by pair_id) as rn, count(*) over () as n from p)
select pair_id, cast(least(400, floor(50000/n)+case when rn<=50000-floor(50000/n)*n then 1 else 0 end) as bigint) as budget,
 cast(least(available, 400, floor(50000/n)+case when rn<=50000-floor(50000/n)*n then 1 else 0 end) as bigint) as taken from r""")
def _(m):
    p = m.groupBy(F.concat_ws("|", *PAIR).alias("pair_id")).agg(F.count(F.lit(1)).alias("available"))
    return P.split_budget(p, "available", 50000, 400).select("pair_id", "budget", "taken")


@query("top_05_worst", "fx_matches", sql=f"""
select record_id, before from (select *, {RES} from fx_matches) order by before desc, record_id limit 50""")
def _(m):
    return P.worst(with_residuals(m), "before", "record_id", 50).select("record_id", "before")


# row by row in each pair, the features used so far as one bit each
@query("grf_09_unique_match_mask", "fx_matches", sql="""
with recursive o as (select moving_view as mv, reference_view as rv, record_id, cast(moving_feature as int) as mf, cast(reference_feature as int) as rf, row_number() over (partition by moving_view, reference_view order by metric, record_id) as rn from fx_matches),
r as (select distinct mv, rv, 0::bigint as rn, bitstring('0',997) as ua, bitstring('0',997) as ub, '' as record_id, false as kept from o
 union all select mv, rv, rn, case when k then set_bit(ua,mf,1) else ua end, case when k then set_bit(ub,rf,1) else ub end, record_id, k from (
 select o.*, r.ua, r.ub, get_bit(r.ua,o.mf)=0 and get_bit(r.ub,o.rf)=0 as k from r join o on o.mv=r.mv and o.rv=r.rv and o.rn=r.rn+1))
select record_id, kept from r where rn>0""")
def _(m):
    out = L.unique_match_mask(m, PAIR, "moving_feature", "reference_feature", ["metric", "record_id"])
    return out.select("record_id", F.col("_mask").alias("kept"))


# every record a left feature of its own
@query("grf_09_unique_one_sided", "fx_matches", sql="""
select record_id, row_number() over (partition by moving_view, reference_view, reference_feature order by metric, record_id)=1 as kept from fx_matches""")
def _(m):
    out = L.unique_match_mask_one_sided(m, PAIR, "reference_feature", ["metric", "record_id"])
    return out.select("record_id", F.col("_mask").alias("kept"))


# --- scalar functions ----------------------------------------------------------------

@query("fn_01_content_id", "fx_matches", sql="""
select record_id, 'match-'||substr(sha256('{"metric":'||case when metric=floor(metric) then cast(cast(metric as int) as varchar)||'.0' else cast(metric as varchar) end||',"record":"'||record_id||'","view":"'||moving_view||'"}'),1,16) as id from fx_matches""")
def _(m):
    return m.select("record_id", S.content_id("match-", view=F.col("moving_view"), record=F.col("record_id"), metric=F.col("metric")).alias("id"))


@query("fn_02_pair_id", "fx_matches", sql="""
select record_id, 'pair:["'||least(moving_view,reference_view)||'","'||greatest(moving_view,reference_view)||'"]' as pair_id from fx_matches""")
def _(m):
    return m.select("record_id", S.pair_id(F.col("moving_view"), F.col("reference_view")).alias("pair_id"))


@query("fn_03_robust_residual", "fx_matches", sql="""
with r as (select record_id, reference_row-moving_row as r from fx_matches)
select record_id, case when abs(r)>1 then round(sign(r)*sqrt(2*abs(r)-1),6) else r end as huber, case when abs(r)>1 then sign(r)*1.0 else r end as bisquare,
 round(sign(r)*sqrt(ln(1+r*r)),6)+0.0 as cauchy, round(case when abs(r)>1 then 1/sqrt(2*abs(r)-1) else 1 end,6) as dhuber,
 round(case when abs(r)>2.220446049250313e-16 then abs(r)/((1+r*r)*sqrt(ln(1+r*r))) else 1 end,6) as dcauchy from r""")
def _(m):
    r = F.col("reference_row") - F.col("moving_row")
    return m.select("record_id", r6(S.robust_residual(r, "huber", 1)).alias("huber"), S.robust_residual(r, "bisquare", 1).alias("bisquare"),
                    r6(S.robust_residual(r, "cauchy", 1)).alias("cauchy"), r6(S.robust_derivative(r, "huber", 1)).alias("dhuber"), r6(S.robust_derivative(r, "cauchy", 1)).alias("dcauchy"))


@query("fn_04_huber_weight", "fx_matches", sql="""
select record_id, round(least(1, 0.25/greatest(abs(reference_row-moving_row),2.220446049250313e-16)),6) as w from fx_matches""")
def _(m):
    return m.select("record_id", r6(S.huber_weight(F.abs(F.col("reference_row") - F.col("moving_row")), 0.25)).alias("w"))


@query("fn_05_quantized_obs_id", "fx_matches", sql="""
select record_id, 'obs-'||substr(sha256('{"c":'||cast(round(moving_col/0.25) as bigint)||',"r":'||cast(round(moving_row/0.25) as bigint)||',"view":"'||moving_view||'"}'),1,16) as obs_id from fx_matches""")
def _(m):
    return m.select("record_id", S.quantized_obs_id(F.col("moving_view"), F.col("moving_row"), F.col("moving_col"), 0.25).alias("obs_id"))


TEXT_SQL = """case when event_id%5=0 then strftime(ts,'%d%m%y_%H%M%S') when event_id%5=1 then strftime(ts,'%d%m%Y_%H%M%S')||'.25'
 when event_id%5=2 then '31'||strftime(ts,'%m%y_%H%M%S') when event_id%5=3 then strftime(ts,'%d%m')||'85_240000' else '290200_101112.5' end"""


@query("fn_06_parse_acquisition", "events", sql=f"""
with t as (select event_id, ts, {TEXT_SQL} as s from events)
select event_id, s, case when event_id%5=0 then epoch_us(date_trunc('second',ts)) when event_id%5=1 then epoch_us(date_trunc('second',ts))+250000
 when event_id%5=2 then case when day(last_day(ts))=31 then epoch_us(date_trunc('second',ts))+(31-day(ts))*86400000000 end
 when event_id%5=3 then null else epoch_us(timestamp '2000-02-29 10:11:12.5') end as us from t""")
def _(e):
    f = lambda p: F.date_format("ts", p)
    i = F.col("event_id") % 5
    s = (F.when(i == 0, f("ddMMyy_HHmmss")).when(i == 1, F.concat(f("ddMMyyyy_HHmmss"), F.lit(".25"))).when(i == 2, F.concat(F.lit("31"), f("MMyy_HHmmss")))
         .when(i == 3, F.concat(f("ddMM"), F.lit("85_240000"))).otherwise("290200_101112.5"))
    df = e.select("event_id", s.alias("s"))
    return df.select("event_id", "s", F.unix_micros(S.parse_acquisition(F.col("s"))).alias("us"))


@query("fn_07_radiometry", "fx_pixels", sql="""
select layer, r, c, round(least(1,greatest(0,(coalesce(case when valid then v end,10)-10)/200))*255) as stored,
 round(round(least(1,greatest(0,(coalesce(case when valid then v end,10)-10)/200))*255)/255*200+10,6) as back from fx_pixels""")
def _(p):
    df = p.withColumn("s", S.radiometric_encode(F.when(F.col("valid"), F.col("v")), 200, 10, "uint8", "clip", 10))
    return df.select("layer", "r", "c", F.col("s").alias("stored"), r6(S.radiometric_decode(F.col("s"), 200, 10, "uint8")).alias("back"))


@query("fn_08_pack_tri", "fx_points", sql="select point_id, concat_ws('|',x,y,z,sigma,x+y,z) as packed, x+y as m12, x+y as m21 from fx_points")
def _(p):
    c = {k: F.col(k) for k in ("x", "y", "z", "sigma")}
    m = [[c["x"], c["y"], c["z"]], [c["y"], c["sigma"], c["x"] + c["y"]], [c["z"], c["x"] + c["y"], c["z"]]]
    df = p.withColumn("t", S.pack_tri(m))
    u = S.unpack_tri(F.col("t"), 3)
    return df.select("point_id", F.array_join("t", "|").alias("packed"), u[1][2].alias("m12"), u[2][1].alias("m21"))


@query("fn_09_bspline_basis", "fx_matches", sql="""
with u as (select record_id, least(512,greatest(0,moving_col))/128 as u from fx_matches), k as (select *, least(floor(u),3) as k from u), t as (select *, u-k as t from k)
select record_id, cast(k as bigint) as first, round((1-t)*(1-t)*(1-t)/6,6) as w0, round((3*t*t*t-6*t*t+4)/6,6) as w1, round((-3*t*t*t+3*t*t+3*t+1)/6,6) as w2, round(t*t*t/6,6) as w3, cast(1 as double) as total from t""")
def _(m):
    df = m.withColumn("b", S.bspline_basis(F.col("moving_col"), 512, 128))
    w = lambda i: F.col("b.weights")[i]
    return df.select("record_id", F.col("b.first").alias("first"), *(r6(w(i)).alias(f"w{i}") for i in range(4)), r6(w(0) + w(1) + w(2) + w(3)).alias("total"))


@query("fn_10_decision_scalars", "fx_solves", sql="""
select solve_id, round((rms_before-rms_after)/rms_before,6)+0.0 as gain, case when min_match_count<2 or rms_before<0.2 or rms_after>0.9 then 'low'
 when rms_before/2.5<0.15 or rms_after>0.3 then 'moderate' else 'high' end as confidence from fx_solves""")
def _(s):
    return s.select("solve_id", r6(S.improvement_fraction(F.col("rms_before"), F.col("rms_after"))).alias("gain"),
                    S.confidence_class(F.col("min_match_count"), F.when(F.col("rms_before") < 0.2, 0.07).otherwise(F.col("rms_before") / 2.5),
                                       F.when(F.col("rms_after") > 0.9, 0.02).when(F.col("rms_after") > 0.3, 0.005).otherwise(0.001)).alias("confidence"))
