"""Sources, versioned corrections and product catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from raytable import schemas
from raytable.functions.scalars import round6 as r6
from raytable.operators import association as A
from raytable.operators import catalog as C
from raytable.operators import voxels as X
from raytable.sources import tables as T

from .base import query
from .fusion import BOX, NB


@query("src_01_conform", "fx_matches", sql="""
select record_id, moving_view, reference_view, moving_feature, reference_feature, metric, moving_row, moving_col, reference_row, reference_col, 'accepted' as state, 1.0::double as source_uncertainty from fx_matches""")
def _(m):
    return T.conform(m.drop("l_returnflag"), schemas.MATCHES, "record_id")


@query("src_02_split_valid", "fx_matches", sql="""
with t as (select record_id, case when metric>0.12 then 'weakMetric' when moving_row>500 then 'outsideImage' when reference_row<1 then 'outsideReference' else '' end as reason from fx_matches) select record_id, reason, reason='' as valid from t""")
def _(m):
    ok, bad = T.split_valid(m, [("weakMetric", F.col("metric") <= 0.12), ("outsideImage", F.col("moving_row") <= 500), ("outsideReference", F.col("reference_row") >= 1)])
    return ok.select("record_id", F.lit("").alias("reason"), F.lit(True).alias("valid")).unionByName(bad.select("record_id", "reason", F.lit(False).alias("valid")))


@query("src_05_records_from_matches", "fx_matches", sql="""
with r as (select *, moving_view||'|'||reference_view as pair_id, row_number() over (partition by moving_view, reference_view order by record_id) as rn, count(*) over (partition by moving_view, reference_view) as n from fx_matches where l_returnflag<>'A'),
t as (select pair_id, cast(round(1+k*((n-1)/cast(99 as double))) as bigint) as rn from (select distinct pair_id, n from r) cross join (select unnest(range(100)) as k))
select pair_id, moving_row as row_a, moving_col as col_a, 'obs-'||substr(sha256('{"c":'||cast(round(moving_col/0.25) as bigint)||',"r":'||cast(round(moving_row/0.25) as bigint)||',"view":"'||moving_view||'"}'),1,16) as obs_a,
 case when metric=0 then 0.5 else metric end as confidence, greatest(0.1, case when metric=0 then 0.5 else metric end) as texture, 1.0::double as nav_a from r semi join t on r.pair_id=t.pair_id and r.rn=t.rn""")
def _(m):
    t = m.select(F.concat_ws("|", "moving_view", "reference_view").alias("pair_id"), F.col("moving_view").alias("view_a"), F.col("reference_view").alias("view_b"), F.col("moving_row").alias("row_a"), F.col("moving_col").alias("col_a"),
                 F.col("reference_row").alias("row_b"), F.col("reference_col").alias("col_b"), F.when(F.col("l_returnflag") == "A", "masked").otherwise("valid").alias("state"), F.col("metric").alias("score"),
                 F.when(F.col("metric") != 0, F.col("metric")).alias("confidence"), F.lit("zncc").alias("matcher"), "record_id")
    return T.records_from_matches(t, 100, ["record_id"]).select("pair_id", "row_a", "col_a", "obs_a", "confidence", "texture", "nav_a")


@query("cat_01_check_lifecycle", "fx_log", sql="""
with b as (select *, lag(transition) over (partition by store_id, generation_id order by seq) as b, last_value(case when transition='propose' then generation_id end ignore nulls) over (partition by store_id order by seq rows between unbounded preceding and current row) as cur from fx_log)
select store_id, seq, case when transition='propose' and b in ('propose','accept','apply') then 'alreadyActive' when transition='accept' and coalesce(b,'')<>'propose' then 'notProposed' when transition='accept' and cur<>generation_id then 'notCurrentProposal'
 when transition='apply' and coalesce(b,'')<>'accept' then 'notAccepted' when transition='revert' and coalesce(b,'')<>'apply' then 'notApplied' when transition in ('reject','supersede') and coalesce(b,'') not in ('propose','accept') then 'notProposedOrAccepted' else '' end as reason from b""")
def _(log):
    return C.check_lifecycle(log).select("store_id", "seq", "reason")


@query("cat_02_current", "fx_log", sql="""
with s as (select store_id, generation_id, max_by(transition, seq) as t, max(seq) as seq from fx_log where seq<=5000 group by all)
select store_id, max_by(generation_id, seq) filter (where t='propose') as proposed, max_by(generation_id, seq) filter (where t='accept') as accepted, max_by(generation_id, seq) filter (where t='apply') as applied from s group by 1""")
def _(log):
    return C.current(log, 5000)




def _fp(x, y, z):
    body = '\'{"view":"\'||point_id||\'","x":\'||cast(' + x + ' as varchar)||\',"y":\'||cast(' + y + ' as varchar)||\',"z":\'||cast(' + z + ' as varchar)||\'}\''
    return f"'geometry-'||substr(sha256({body}),1,16)"


@query("cat_03_apply_correction", "fx_points", sql=f"""
with a as (select *, case when o_custkey%4=0 then 0.5 else 0 end as d from fx_points), b as (select point_id, x as x0, y as y0, z as z0, x+d as x, y-d as y, z+d/2 as z, o_custkey%4=0 as corrected from a)
select point_id as view_id, x, y, z, corrected, {_fp('x0', 'y0', 'z0')} as fingerprint_before, {_fp('x', 'y', 'z')} as fingerprint_after from b""")
def _(p):
    v = p.select(F.col("point_id").alias("view_id"), "x", "y", "z")
    d = p.filter("o_custkey % 4 = 0").select(F.col("point_id").alias("view_id"), F.lit(0.5).alias("dx"), F.lit(-0.5).alias("dy"), F.lit(0.25).alias("dz"))
    return C.apply_correction(v, d, "g1", "g1")


@query("cat_03_revert_restores", "fx_points", sql="select cast(0 as bigint) as only_left, cast(0 as bigint) as only_right, true as equal from fx_points limit 1")
def _(p):
    v = p.select(F.col("point_id").alias("view_id"), "x", "y", "z")
    d = p.filter("o_custkey % 4 = 0").select(F.col("point_id").alias("view_id"), F.lit(0.5).alias("dx"), F.lit(-0.5).alias("dy"), F.lit(0.25).alias("dz"))
    back = C.revert(C.apply_correction(v, d), d).select("view_id", "x", "y", "z")
    return X.assert_equal_frames(v, back)


@query("cat_04_invalidate", "fx_log", sql="""
with p as (select seq, case seq%4 when 0 then 'rawMatches' when 1 then 'fusionProducts' when 2 then 'demRegistration' else 'referenceGrid' end as kind, transition in ('apply','revert') as eff from fx_log)
select seq, kind, eff and kind<>'referenceGrid' as stale, case when eff and kind='rawMatches' then 'alignmentMatch' when eff and kind='fusionProducts' then 'surfaceFusion' when eff and kind='demRegistration' then 'demRegistration' end as recompute from p""")
def _(log):
    k = F.col("seq") % 4
    p = log.select("seq", F.when(k == 0, "rawMatches").when(k == 1, "fusionProducts").when(k == 2, "demRegistration").otherwise("referenceGrid").alias("kind"), F.col("transition").isin("apply", "revert").alias("eff"))
    return C.invalidate(p, F.col("eff")).select("seq", "kind", "stale", "recompute")


CATALOG = NB + """, ct as (select 'raw-pairwise' as product, point_id, sigma as u, 2 as views, 1 as passes, z from fx_points union all select 'robust-multi-view', point_id, sigma, pass_count+1, pass_count, z from fx_points where pass_count>1
 union all select 'uncertainty-filtered', point_id, sigma, pass_count+1, pass_count, z from fx_points where pass_count>1 and sigma<=0.25
 union all select 'fused', 'mode-'||mode_id, null, count(distinct view_id), count(distinct pass_id), avg(z) from fx_points group by mode_id
 union all select 'voxel', 'voxel-'||vg.mode_id||'-'||ix||'-'||iy||'-'||iz, sqrt(3*(vg.scale*vg.scale/12)), views, passes, 8+(iz+0.5)*vg.scale from vg left join bt on vg.scale=bt.scale and vg.mode_id=bt.mode_id and ix=vix and iy=viy and iz=viz where bt.vix is null and vg.scale=1)"""


def catalog(p):
    return C.build_catalog(p, X.points_from_peaks(X.voxelize(p, BOX, [0.5, 1.0, 2.0]), BOX, 0.9), 0.25)


@query("cat_05_build_catalog", "fx_points", sql=f"with {CATALOG} select product, point_id, round(u,6) as uncertainty, views as view_count, passes as pass_count, round(z,6) as z from ct")
def _(p):
    return catalog(p).select("product", "point_id", r6(F.col("uncertainty")).alias("uncertainty"), "view_count", "pass_count", r6(F.col("z")).alias("z"))


@query("agg_19_product_stats", "fx_points", sql=f"with {CATALOG} select product, count(*) as points, count(u) as finite_uncertainty, coalesce(count_if(u<=0.25),0) as filtered_points, round(quantile_cont(u,0.5),6) as median_uncertainty from ct group by product")
def _(p):
    s = C.product_stats(catalog(p), 0.25)
    return s.withColumn("median_uncertainty", r6(F.col("median_uncertainty")))


@query("agg_19_network_and_work", "fx_points", sql="""
select count(distinct view_id) as views, count(distinct pass_id) as passes, count(*) as points, quantile_cont(pass_count,0.5) as median_passes, count(distinct view_id)*(count(distinct view_id)-1)/2 as potential_pairs,
 ceil(least(8,count(distinct view_id)*(count(distinct view_id)-1)/2)/2) as scheduled_pairs, ceil(least(8,count(distinct view_id)*(count(distinct view_id)-1)/2)/2)*count(*) as work_units from fx_points""")
def _(p):
    return C.work_estimate(C.network_stats(p), 8, "balanced")


@query("cat_06_registered_product", "fx_points", sql="select point_id, x+1.25 as x, y-0.75 as y, z+2 as z, z-9 as dem_difference, round(sqrt(3*(sigma*sigma+0.0625)),6) as uncertainty from fx_points")
def _(p):
    pre = p.select("point_id", (F.col("x") + 1.25).alias("x"), (F.col("y") - 0.75).alias("y"), (F.col("z") + 2).alias("z"), (F.col("z") - 9).alias("dem_difference"))
    out = C.registered_product(p, pre, 0.0625)
    return out.select("point_id", "x", "y", "z", "dem_difference", r6(F.col("uncertainty")).alias("uncertainty"))


@query("cat_07_observation_links", "fx_records", sql="""
with e as (select obs_a as point_id, view_a||'|'||obs_a as node, view_a as view_id, row_a as row, col_a as col from fx_records union all select obs_b, view_b||'|'||obs_b, view_b, row_b, col_b from fx_records)
select point_id, view_id, round(avg(row),6) as row, round(avg(col),6) as col from e group by point_id, view_id""")
def _(r):
    ends = A.endpoints(r)
    obs = A.consolidate_observations(ends, keep=["node", "view_id", "row", "col"])
    links = C.observation_links(ends.select(F.col("obs").alias("point_id"), "node"), obs)
    return links.select("point_id", "view_id", r6(F.col("row")).alias("row"), r6(F.col("col")).alias("col"))


@query("cat_08_attribute", "fx_points", sql="""
with u as (select point_id, case when pass_count>1 then sigma end as s, mode_id||'/'||pass_id as pp from fx_points)
select point_id, 'uncertainty' as mode, coalesce(s,(select min(s) from u)) as value, true as available, '' as reason from u union all select point_id, 'pairPass', cast(dense_rank() over (order by pp) as double), true, '' from u
 union all select point_id, 'HAE', 0.0, false, 'absoluteHeightUnavailableForWorldFrame' from u""")
def _(p):
    b = p.withColumn("uncertainty", F.when(F.col("pass_count") > 1, F.col("sigma"))).withColumn("pair_pass", F.concat_ws("/", "mode_id", "pass_id"))
    out = None
    for m in ("uncertainty", "pairPass", "HAE"):
        one = C.attribute(b, m).select("point_id", F.lit(m).alias("mode"), "value", "available", "reason")
        out = one if out is None else out.unionByName(one)
    return out


@query("aud_05_audit_matches", "fx_records", sql="""
with m as (select least(view_a,view_b)||'|'||greatest(view_a,view_b) as pair_id, abs(row_a-row_b) as s, case when visibility_a='occluded' or visibility_b='unknown' then null else abs(row_a-row_b) end as v from fx_records)
select pair_id, count(*) as n, count(v) as mutually_visible, count(*)-count(v) as excluded, max(v) as maximum, quantile_cont(v,0.5) as median, round(quantile_cont(v,0.95),6) as p95 from m group by 1""")
def _(r):
    vis = lambda c, bad: F.when(F.col(c) == bad, "terrainOcclusion").otherwise("visibleTerrain")
    m = r.select(F.concat_ws("|", F.least("view_a", "view_b"), F.greatest("view_a", "view_b")).alias("pair_id"), F.abs(F.col("row_a") - F.col("row_b")).alias("separation"), vis("visibility_a", "occluded").alias("visible_a"), vis("visibility_b", "unknown").alias("visible_b"))
    out = C.audit_matches(m, ["pair_id"])
    return out.withColumn("p95", r6(F.col("p95")))
