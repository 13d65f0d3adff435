"""View pairs, schedules, pair graphs, sequences and id lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from raytable.functions.geometry import Plane
from raytable.functions.scalars import round6 as r6
from raytable.operators import ledger as L
from raytable.operators import matching as D
from raytable.operators import selection as S
from raytable.operators import views as V

from .base import query

FLAT = Plane((0.0, 0.0, 50.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))

PAIRS = """pr as (select a.view_id as view_a, b.view_id as view_b, a.position as pa, b.position as pb, a.pass_id as qa, b.pass_id as qb, a.pixel_count+b.pixel_count as px,
 (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))/36.0 as overlap from fx_views a join fx_views b on a.position<b.position
 and a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1),
sp as (select *, 'pair:["'||least(view_a,view_b)||'","'||greatest(view_a,view_b)||'"]' as pair_id, pb-pa as sep,
 0.3*overlap+0.1+0.15*(case when qa=qb then 1.0/(pb-pa) else greatest(1.0/(pb-pa),0.75) end)+0.075+0.1/(pb-pa)+0.05 as quality from pr)"""


def pairs(v):
    return V.score_pairs(V.view_pairs(v, 6.0))


@query("jon_02_view_pairs", "fx_views", sql=f"with {PAIRS} select view_a, view_b, round(overlap,6) as overlap from pr")
def _(v):
    return V.view_pairs(v, 6.0).select("view_a", "view_b", r6(F.col("overlap")).alias("overlap"))


@query("grf_06_pair_scores", "fx_views", sql=f"with {PAIRS} select pair_id, sep as separation, qa=qb as same_pass, round(quality,6) as quality, px/1e6 as cost from sp")
def _(v):
    return pairs(v).select("pair_id", "separation", "same_pass", r6(F.col("quality")).alias("quality"), "cost")


def overrides(v):
    p = pairs(v)
    inc = p.filter("position_a % 29 = 3").select("pair_id")
    exc = p.filter("position_a % 31 = 5").select("pair_id")
    return V.apply_overrides(p, inc, exc)


OVER = PAIRS + """, ov as (select *, pa%31=5 as ex, pa%29=3 and pa%31<>5 as inc from sp)"""


@query("jon_11_overrides", "fx_views", sql=f"with {OVER} select pair_id, not ex as plausible, ex or pa%29=3 as forced, case when ex then 'excludedByOperator' else '' end as reason from ov")
def _(v):
    return overrides(v).select("pair_id", "plausible", "forced", F.col("rejection_reason").alias("reason"))


@query("grf_06_pair_graph", "fx_views")
def _(v):
    out = V.pair_graph(overrides(v), v.count(), "balanced")
    return out.select("pair_id", "state", "role", "selection_reason", "rejection_reason")


@query("grf_07_select_chords", "fx_views")
def _(v):
    out = V.pair_graph(pairs(v).withColumn("plausible", F.lit(True)).withColumn("forced", F.lit(False)).withColumn("rejection_reason", F.lit("")), v.count(), "quality")
    return out.filter("role = 'chord'").select("pair_id", "selection_reason")


# from the chain of neighbours on, one chord a step: the recursion carries all candidates with the step that took them
@query("grf_07_chords_beside_chain", "fx_views", sql=f"""
with recursive {PAIRS}, n as (select count(*) as views from fx_views), cd as (select pair_id, view_a as va, view_b as vb, sep, qa=qb as same, least(qa,qb)||'|'||greatest(qa,qb) as pp, quality from sp),
st as (select 0 as step, *, sep=1 as taken from cd union all select step+1, pair_id, va, vb, sep, same, pp, quality, taken or rn=1 from (
 select *, row_number() over (order by taken, round(quality+0.10*least(1,sep/(views-1))+0.08*((dva+dvb<2)::int+(dwa+dwb<2)::int)+case when not same and pc<2 then 0.08 else 0 end-case when rep then 0.05 else 0 end,9) desc, pair_id) as rn from (
 select st.*, n.views, sum(taken::int) over (partition by va) as dva, coalesce(list_sum(list_transform(tv, lambda x: (x=va)::int)),0) as dvb,
  sum(taken::int) over (partition by vb) as dwb, coalesce(list_sum(list_transform(tw, lambda x: (x=vb)::int)),0) as dwa, sum(taken::int) over (partition by pp) as pc, bool_or(taken) over (partition by sep) as rep
 from (select *, list(vb) filter (taken) over () as tv, list(va) filter (taken) over () as tw from st) st cross join n where step<views)))
select pair_id from st cross join n where step=views and taken and sep<>1""")
def _(v):
    p = pairs(v)
    return V.select_chords(p, p.filter("separation = 1"), v.count(), v.count()).select("pair_id")


@query("set_02_schedule_pairs", "fx_views", sql="""
with p as (select view_id, row_number() over (order by position) as p from fx_views), r as (select p as rp from p where view_id='v7'), o as (select view_id, p, rp, 2*abs(p-rp)+case when p<rp then 0 else 1 end as ord from p cross join r where p<>rp),
co as (select 0 as part, ord, o.view_id as view_a, q.view_id as view_b from o join p q on q.p=case when o.p<rp then o.p+1 else o.p-1 end), cs as (select 1 as part, ord, view_id as view_a, 'v7' as view_b from o),
h as (select *, row_number() over (partition by least(view_a,view_b), greatest(view_a,view_b) order by part, ord) as k from (select * from co union all select * from cs))
select 'hybrid' as strategy, part*1000000000+ord as ord, view_a, view_b from h where k=1 union all select 'adjacentChain', a.p, a.view_id, b.view_id from p a join p b on b.p=a.p+1""")
def _(v):
    h = V.schedule_pairs(v, "hybrid", "v7").withColumn("strategy", F.lit("hybrid"))
    a = V.schedule_pairs(v, "adjacentChain", "v7").withColumn("strategy", F.lit("adjacentChain"))
    return h.unionByName(a).select("strategy", F.col("ord").cast("bigint").alias("ord"), "view_a", "view_b")


@query("set_03_uncovered", "fx_views", "fx_points", sql=f"""
with {PAIRS}, s as (select view_a as v from sp where quality>0.5 union select view_b from sp where quality>0.5)
select 'view' as kind, view_id as id from fx_views where view_id not in (select v from s) union all
select 'mode', mode_id from (select mode_id from fx_points where sigma<0.2 intersect select mode_id from fx_points where pass_count=3)""")
def _(v, p):
    u = V.uncovered(v, pairs(v).filter("quality > 0.5")).select(F.lit("view").alias("kind"), F.col("view_id").alias("id"))
    m = V.preserved_modes(p.filter("sigma < 0.2"), p.filter("pass_count = 3")).select(F.lit("mode").alias("kind"), F.col("mode_id").alias("id"))
    return u.unionByName(m)


CAND = PAIRS + """, cd as (select *, (pa%10)/10.0 as conditioning, (pb%7)/7.0 as texture, (pa%5)/5.0 as radiometric, (pb%3)/2.0 as visibility, pa%29=3 as f_in, pa%31=5 as f_out from sp)"""


def candidates(v):
    return (pairs(v).withColumn("conditioning", (F.col("position_a") % 10) / 10).withColumn("texture", (F.col("position_b") % 7) / 7)
            .withColumn("radiometric", (F.col("position_a") % 5) / 5).withColumn("visibility", (F.col("position_b") % 3) / 2))


MINS = {"overlap": 0.15, "conditioning": 0.1, "texture": 0.1, "radiometric": 0.1, "visibility": 0.1}
DECIDE = CAND + """, dc as (select *, case when f_out then 'rejected' when f_in then 'selected' when view_a='v9' or view_b='v9' then 'validation' when overlap<0.15 or conditioning<0.1 or texture<0.1 or radiometric<0.1 or visibility<0.1 then 'rejected' else 'selected' end as decision,
 case when f_out then 'operatorExcluded' when f_in then 'operatorIncluded' when view_a='v9' or view_b='v9' then 'reservedValidationView' when overlap<0.15 then 'insufficientOverlap' when conditioning<0.1 then 'weakConditioning' when texture<0.1 then 'insufficientTexture'
 when radiometric<0.1 then 'radiometricMismatch' when visibility<0.1 then 'insufficientVisibility' else 'qualityRank' end as reason from cd)"""


def decided(v):
    c = candidates(v)
    return L.classify_candidates(c, MINS, c.filter("position_a % 29 = 3"), c.filter("position_a % 31 = 5"), F.lit("v9"))


@query("flt_09_classify_candidates", "fx_views", sql=f"with {DECIDE} select pair_id, decision, reason from dc")
def _(v):
    return decided(v).select("pair_id", "decision", F.col("selection_reason").alias("reason"))


@query("top_02_rank_candidates", "fx_views", sql=f"""
with {DECIDE}, s as (select *, 0.4*overlap+0.2*conditioning+0.2*texture+0.1*radiometric+0.1*visibility as score from dc),
k as (select pair_id, row_number() over (order by score desc, pair_id) as rn from s where decision='selected')
select s.pair_id, round(score,6) as score, case when decision='selected' and rn>40 then 'rejected' else decision end as decision, case when decision='selected' and rn>40 then 'pairBudget' else reason end as reason from s left join k using (pair_id)""")
def _(v):
    w = {"overlap": 0.4, "conditioning": 0.2, "texture": 0.2, "radiometric": 0.1, "visibility": 0.1}
    return V.rank_candidates(decided(v), w, 40).select("pair_id", r6(F.col("score")).alias("score"), "decision", F.col("selection_reason").alias("reason"))


@query("top_06_validation_view", "fx_views", sql=f"""
with {PAIRS}, u as (select view_a as v from pr where pa%3=0 union select view_b from pr where pa%3=0), f as (select max_by(view_id, position) as view_id from fx_views where view_id not in (select v from u))
select view_id, case when view_id is null then 'forcedIncludesUseEveryView' else 'stableHeldOutView' end as reason from f""")
def _(v):
    return V.validation_view(v, pairs(v).filter("position_a % 3 = 0"))


@query("grf_10_covering_pairs", "fx_views", sql=f"""
with {PAIRS}, e as (select view_a as v, pair_id, quality from sp union all select view_b, pair_id, quality from sp), f as (select min_by(pair_id, (-round(quality,9), pair_id)) as pair_id from e group by v)
select distinct pair_id from f""")
def _(v):
    p = pairs(v).withColumn("rank_key", -F.round("quality", 9))
    return V.covering_pairs(p, ["rank_key", "pair_id"]).select("pair_id")


@query("jon_15_resolve_ids", "fx_matches", "fx_views", sql="""
select record_id, a.position as moving_position, b.position as reference_position from fx_matches m join (select view_id, min(position) as position from fx_views group by 1) a on m.moving_view='x'||a.view_id or m.moving_view=a.view_id join fx_views b on m.reference_view=b.view_id""")
def _(m, v):
    a = V.resolve_ids(m.withColumn("view_id", F.col("moving_view")), v, "view_id", ["position"]).withColumnRenamed("position", "moving_position").drop("view_id")
    b = V.resolve_ids(a.withColumn("view_id", F.col("reference_view")), v, "view_id", ["position"]).withColumnRenamed("position", "reference_position")
    return b.select("record_id", "moving_position", "reference_position")


@query("agg_22_plan_output_grid", "fx_views", sql="""
with g as (select pass_id, min(pixel_count/16000.0) as res, min(x0) as x0, max(x1) as x1, min(y0) as y0, max(y1) as y1 from fx_views group by 1),
n as (select *, greatest((y1-y0)/(63*res),(x1-x0)/(63*res)) as need from g), r as (select pass_id, case when need>1 then res*pow(2,ceil(log2(need))) else res end as res, x0,x1,y0,y1 from n),
s as (select pass_id, res, res*case when abs(x0/res-round(x0/res))<=0.05 then round(x0/res) else floor(x0/res) end as x0, res*case when abs(x1/res-round(x1/res))<=0.05 then round(x1/res) else ceil(x1/res) end as x1,
 res*case when abs(y0/res-round(y0/res))<=0.05 then round(y0/res) else floor(y0/res) end as y0, res*case when abs(y1/res-round(y1/res))<=0.05 then round(y1/res) else ceil(y1/res) end as y1 from r)
select pass_id, round(res,6) as resolution, round(x0,6)+0.0 as x0, round(y1,6) as y1, cast(round((y1-y0)/res) as bigint)+1 as rows, cast(round((x1-x0)/res) as bigint)+1 as cols from s""")
def _(v):
    out = V.plan_output_grid(v.withColumn("resolution", F.col("pixel_count") / 16000), ["pass_id"], target=(64, 64))
    return out.select("pass_id", r6(F.col("resolution")).alias("resolution"), r6(F.col("x0")).alias("x0"), r6(F.col("y1")).alias("y1"), "rows", "cols")


@query("agg_23_footprints", "fx_rays", sql="""
with h as (select view_id, 50/dz as t, ox, oy, dx, dy, dz from fx_rays), g as (select view_id, count_if(t>1e-12) as hits, min(ox+dx*t) as x0, max(ox+dx*t) as x1, min(oy+dy*t) as y0, max(oy+dy*t) as y1 from h group by 1)
select view_id, hits, hits>=3 and x1>x0 and y1>y0 as available, round(x0,6)+0.0 as x0, round(x1,6)+0.0 as x1, round(y0,6)+0.0 as y0, round(y1,6)+0.0 as y1 from g""")
def _(r):
    f = V.footprints(r, FLAT)
    return f.select("view_id", "hits", "available", *(r6(F.col(c)).alias(c) for c in ("x0", "x1", "y0", "y1")))


@query("win_03_time_thirds", "fx_view_times", sql="""
with t as (select *, bool_and(start_ts is not null) over (partition by pass_id, user_id%10) as timed from fx_view_times),
r as (select *, row_number() over (partition by pass_id, user_id%10 order by case when timed then start_ts end, event_id) as rn, count(*) over (partition by pass_id, user_id%10) as n from t)
select view_id, pass_id||'-'||user_id%10||':'||case when (rn-0.5)/n<=1/3.0::double then 'early' when (rn-0.5)/n>2/3.0::double then 'late' else 'middle' end as interval_id, case when timed then 'acquisitionTime' else 'layerOrderFallback' end as basis from r""")
def _(v):
    v = v.withColumn("pass_id", F.concat_ws("-", "pass_id", (F.col("user_id") % 10).cast("string")))
    return V.time_thirds(v).select("view_id", "interval_id", "basis")


@query("win_04_motion_sequence", "fx_view_times", sql="""
with v as (select *, pass_id||'-'||user_id%10 as p from fx_view_times), t as (select *, min(event_id) over (partition by p) as f, bool_and(start_ts is not null) over (partition by p) as timed from v),
r as (select view_id, timed, row_number() over (order by f, case when timed then start_ts end, case when timed then event_id end, view_id) as pos from t)
select view_id, pos as position, coalesce(lag(view_id) over (order by pos), last_value(view_id) over (order by pos rows between unbounded preceding and unbounded following)) as previous_view,
 coalesce(lead(view_id) over (order by pos), first_value(view_id) over (order by pos)) as next_view, not timed as stable_fallback from r""")
def _(v):
    v = v.withColumn("pass_id", F.concat_ws("-", "pass_id", (F.col("user_id") % 10).cast("string")))
    return V.motion_sequence(v, wrap=True).select("view_id", "position", "previous_view", "next_view", "stable_fallback")


@query("jon_03_match_descriptors", "fx_descriptors", sql="""
with a as (select vec_id, embedding::double[] as e from fx_descriptors where side=0), b as (select vec_id, embedding::double[] as e from fx_descriptors where side=1),
d as (select a.vec_id as ia, b.vec_id as ib, list_sum(list_transform(list_zip(a.e,b.e), lambda x: (x[1]-x[2])*(x[1]-x[2]))) as d2 from a cross join b),
f as (select ia, ib, d2, row_number() over (partition by ia order by d2, ib) as rn, lead(d2) over (partition by ia order by d2, ib) as second from d),
g as (select ib, min_by(ia, d2) as back from d group by ib)
select ia, f.ib, round(d2,6) as d2 from f join g on f.ib=g.ib where rn=1 and sqrt(d2)<=0.95*sqrt(second) and back=ia""")
def _(d):
    a, b = d.filter("side = 0"), d.filter("side = 1")
    out = D.match_descriptors(a, b, [], "vec_id", "embedding", 0.95, True)
    return out.select(F.col("vec_id_a").alias("ia"), F.col("vec_id_b").alias("ib"), r6(F.col("distance") * F.col("distance")).alias("d2"))


# descriptors of one label form a pair of their own
@query("jon_03_match_by_pair", "fx_descriptors", sql="""
with a as (select vec_id, label, embedding::double[] as e from fx_descriptors where side=0), b as (select vec_id, label, embedding::double[] as e from fx_descriptors where side=1),
d as (select a.label, a.vec_id as ia, b.vec_id as ib, list_sum(list_transform(list_zip(a.e,b.e), lambda x: (x[1]-x[2])*(x[1]-x[2]))) as d2 from a join b on a.label=b.label),
f as (select label, ia, ib, d2, row_number() over (partition by ia order by d2, ib) as rn, lead(d2) over (partition by ia order by d2, ib) as second from d),
g as (select ib, min_by(ia, d2) as back from d group by ib)
select label, ia, f.ib, round(d2,6) as d2 from f join g on f.ib=g.ib where rn=1 and (second is null or sqrt(d2)<=0.95*sqrt(second)) and back=ia""")
def _(d):
    out = D.match_descriptors(d.filter("side = 0"), d.filter("side = 1"), ["label"], "vec_id", "embedding", 0.95, True)
    return out.select("label", F.col("vec_id_a").alias("ia"), F.col("vec_id_b").alias("ib"), r6(F.col("distance") * F.col("distance")).alias("d2"))
