"""Raster, tile, image-statistic and dense-matching queries over two registered layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from raytable.functions.scalars import round6 as r6
from raytable.operators import raster as R
from raytable.operators import selection as P
from raytable.runtime import materialize

from .base import query

SIZE = "sz as (select layer, cast(max(r)+1 as bigint) as height, cast(max(c)+1 as bigint) as width from fx_pixels group by layer)"


def sizes(p):
    return p.groupBy("layer").agg((F.max("r") + 1).cast("bigint").alias("height"), (F.max("c") + 1).cast("bigint").alias("width"))


@query("ras_01_tile_ranges", "fx_pixels", sql=f"""
with {SIZE} select layer, i as tile_row, j as tile_col, i*50+1 as row_first, least(height,(i+1)*50) as row_last, j*24+1 as col_first, least(width,(j+1)*24) as col_last
from (select *, unnest(range(0, cast(floor((height-1)/50) as bigint)+1)) as i from sz) cross join lateral (select unnest(range(0, cast(floor((width-1)/24) as bigint)+1)) as j)""")
def _(p):
    return R.tile_ranges(sizes(p), ["layer"], 50, 24)


@query("src_03_tile_region", "fx_pixels", sql="""
select layer, r, c, v, valid from fx_pixels where floor(r/16) in (0,1,3) and layer=1""")
def _(p):
    tiles = R.tiles_from_pixels(p, 16)
    need = p.filter("layer = 1 and r in (3, 30, 50)").select("layer", (F.col("r") + 0.5).alias("src_r"), F.col("c").cast("double").alias("src_c"))
    return R.read_region(tiles, R.tiles_for_mapping(need, 16), 16).select("layer", "r", "c", "v", "valid")


@query("snk_03_tiles", "fx_pixels")
def _(p):
    t = R.tiles_from_pixels(p, 32)
    return t.select("layer", "tile_row", "tile_col", F.size("cells").alias("cells"))


def mesh(d):
    return d.select("r", "c", (2.0 * F.col("c") + 0.5).alias("px"), (2.0 * F.col("r") + 0.25).alias("py"))


MAPPING = "mp as (select y as out_r, x as out_c, (y-0.25)/2 as src_r, (x-0.5)/2 as src_c from (select unnest(range(1,127)) as x) cross join (select unnest(range(1,(select 2*max(r)+1 from fx_dem))) as y))"


@query("ras_02_inverse_map", "fx_dem")
def _(d):
    m = R.inverse_map(mesh(d), [])
    return m.select("out_r", "out_c", r6(F.col("src_r")).alias("src_r"), r6(F.col("src_c")).alias("src_c"))


@query("ras_02_inverse_map_regular", "fx_dem", sql=f"""
with {MAPPING}, n as (select r, c from fx_dem), q as (select a.r, a.c from n a join n b on b.r=a.r and b.c=a.c+1 join n d on d.r=a.r+1 and d.c=a.c join n e on e.r=a.r+1 and e.c=a.c+1)
select out_r, out_c, src_r, src_c from mp join q on q.r=floor(src_r) and q.c=floor(src_c)""")
def _(d):
    return R.inverse_map(mesh(d), []).select("out_r", "out_c", r6(F.col("src_r")).alias("src_r"), r6(F.col("src_c")).alias("src_c"))


def mapping(p):
    """Half-pixel shifted mapping of every layer onto itself."""
    return p.select("layer", F.col("r").alias("out_r"), F.col("c").alias("out_c"), (F.col("r") + 0.25).alias("src_r"), (F.col("c") + 0.5).alias("src_c"))


BIL = """bi as (select a.layer, a.r as out_r, a.c as out_c, 0.375*case when a.valid then a.v end+0.375*case when b.valid then b.v end+0.125*case when d.valid then d.v end+0.125*case when e.valid then e.v end as v
 from fx_pixels a left join fx_pixels b on b.layer=a.layer and b.r=a.r and b.c=a.c+1 left join fx_pixels d on d.layer=a.layer and d.r=a.r+1 and d.c=a.c left join fx_pixels e on e.layer=a.layer and e.r=a.r+1 and e.c=a.c+1)"""


@query("ras_03_resample_bilinear", "fx_pixels", sql=f"with {BIL} select layer, out_r, out_c, coalesce(v,-1) as v, v is not null as valid from bi")
def _(p):
    return R.resample(mapping(p), p, ["layer"], "bilinear", -1.0).select("layer", "out_r", "out_c", "v", "valid")


@query("ras_03_resample_nearest", "fx_pixels", sql="""
with m as (select out_r, out_c, bool_and(ok) as all_ok from (select a.r as out_r, a.c as out_c, coalesce(b.valid,false) as ok from fx_pixels a left join fx_pixels b on b.layer=a.layer and b.r=a.r and b.c=a.c+1) group by all)
select a.layer, out_r, out_c, case when all_ok then b.v else 0 end as v, all_ok as valid from fx_pixels a join m on out_r=a.r and out_c=a.c left join fx_pixels b on b.layer=a.layer and b.r=a.r and b.c=a.c+1""")
def _(p):
    out = R.resample(mapping(p), p, ["layer"], "nearest")
    return R.all_bands_valid(out, ["out_r", "out_c"]).select("layer", "out_r", "out_c", "v", "valid")


@query("ras_04_composite", "fx_pixels", sql="""
with w as (select r, c, max(case when layer=0 and valid then v end) as v0, max(case when layer=1 and valid then v end) as v1 from fx_pixels group by all)
select r, c, case when v1 is not null then coalesce(v0,0)*0.25+v1*0.75 else coalesce(v0,0) end as v, v0 is not null or v1 is not null as valid from w""")
def _(p):
    return R.composite(p.withColumn("alpha", F.when(F.col("layer") == 0, 1.0).otherwise(0.75)), ["r", "c"])


@query("ras_05_composite_anaglyph", "fx_pixels", sql="""
select r, c, coalesce(max(case when valid and layer=0 then v end),0) as channel_1, 0.0::double as channel_2, coalesce(max(case when valid and layer=1 then v end),0) as channel_3, bool_or(valid) as valid from fx_pixels group by r, c""")
def _(p):
    return R.composite_anaglyph(p, ["r", "c"])


@query("ras_06_pyramid", "fx_pixels", sql=f"""
with {SIZE}, lv as (select *, unnest(range(0, greatest(0, cast(ceil(log2(greatest(height,width)/32.0)) as bigint))+1)) as level from sz),
b as (select p.layer, level, least(floor(r/pow(2,level)), greatest(2,ceil(height/pow(2,level)))-1)::bigint as pr, least(floor(c/pow(2,level)), greatest(2,ceil(width/pow(2,level)))-1)::bigint as pc, case when valid then v end as v, valid from fx_pixels p join lv using (layer))
select layer, level, pr, pc, round(coalesce(avg(v),0),6) as v, bool_or(valid) as valid from b group by all""")
def _(p):
    return R.pyramid(p, sizes(p), 32).select("layer", "level", "pr", "pc", r6(F.col("v")).alias("v"), "valid")


@query("ras_07_tile_index", "fx_pixels", sql=f"""
with {SIZE}, lv as (select *, unnest(range(0, greatest(0, cast(ceil(log2(greatest(height,width)/32.0)) as bigint))+1)) as level from sz),
t as (select *, unnest(range(0, cast(floor((greatest(2,ceil(height/pow(2,level)))-1)/32) as bigint)+1)) as tile_row from lv)
select layer, level, tile_row, tile_col, least(height, tile_row*32*pow(2,level))::bigint as row_low, least(height, (tile_row+1)*32*pow(2,level))::bigint as row_high, least(width, tile_col*32*pow(2,level))::bigint as col_low, least(width, (tile_col+1)*32*pow(2,level))::bigint as col_high
from t cross join lateral (select unnest(range(0, cast(floor((greatest(2,ceil(width/pow(2,level)))-1)/32) as bigint)+1)) as tile_col)""")
def _(p):
    return R.tile_index(sizes(p), 32)


@query("ras_07_select_level", "fx_pixels", sql="select layer, case when layer=0 then 1 else 0 end as level from (select distinct layer from fx_pixels)")
def _(p):
    demand = p.groupBy("layer").agg(F.when(F.col("layer") == 0, 3.5).otherwise(1.9).alias("demand"))
    return R.select_level(R.tile_index(sizes(p), 32), demand)


@query("ras_08_overlap_masks", "fx_pixels", sql="select 0 as layer_a, 1 as layer_b, count(*) as cells from fx_pixels a join fx_pixels b using (r, c) where a.layer=0 and b.layer=1 and a.valid and b.valid")
def _(p):
    return R.overlap_masks(p)


@query("ras_13_stretch_minmax", "fx_pixels", sql="""
with s as (select layer, min(v) as lo, max(v) as hi from fx_pixels where valid group by 1) select layer, r, c, round(case when valid then (v-lo)/(hi-lo) else 0 end,6) as v from fx_pixels join s using (layer)""")
def _(p):
    return R.stretch(p, ["layer"]).select("layer", "r", "c", r6(F.col("v")).alias("v"))


PRC = "{n} as (select layer, max(case when k=floor(pos) then v end)+(max(pos)-floor(max(pos)))*(coalesce(max(case when k=floor(pos)+1 then v end),max(v))-max(case when k=floor(pos) then v end)) as q from (select layer, v, k, least(n,greatest(1,{p}*n+0.5)) as pos from rk) group by layer)"


@query("ras_13_stretch_percentile", "fx_pixels", sql=f"""
with rk as (select layer, v, row_number() over (partition by layer order by v) as k, count(*) over (partition by layer) as n from fx_pixels where valid), {PRC.format(n='lo', p='0.01')}, {PRC.format(n='hi', p='0.99')}
select layer, r, c, round(case when valid then 255*least(1,greatest(0,(v-lo.q)/(hi.q-lo.q))) else 0 end,5) as v from fx_pixels join lo using (layer) join hi using (layer)""")
def _(p):
    return R.stretch(p, ["layer"], "percentile").select("layer", "r", "c", F.round("v", 5).alias("v"))


@query("win_06_highpass", "fx_pixels", sql="""
select layer, r, c, round(v-avg(v) over (partition by layer, c order by r rows between 7 preceding and 7 following),5)+0.0 as h from fx_pixels""")
def _(p):
    return R.highpass(p, ["layer", "c"], "r", "v", 15, "h").select("layer", "r", "c", (F.round("h", 5) + F.lit(0.0)).alias("h"))


def _grad_sql(values):
    out = []
    for v in values:
        out.append(f"case when l.r is not null and q.r is not null then (q.{v}-l.{v})/2 when q.r is not null then q.{v}-a.{v} when l.r is not null then a.{v}-l.{v} else 0 end as {v}_dx")
        out.append(f"case when lo.r is not null and hi.r is not null then (hi.{v}-lo.{v})/2 when hi.r is not null then hi.{v}-a.{v} when lo.r is not null then a.{v}-lo.{v} else 0 end as {v}_dy")
    return "select a.layer, " + ", ".join(out) + " from src a left join src l on l.layer=a.layer and l.r=a.r and l.c=a.c-1 left join src q on q.layer=a.layer and q.r=a.r and q.c=a.c+1 left join src lo on lo.layer=a.layer and lo.c=a.c and lo.r=a.r-1 left join src hi on hi.layer=a.layer and hi.c=a.c and hi.r=a.r+1"


@query("win_07_texture", "fx_pixels", sql=f"""
with src as (select * from fx_pixels), g as ({_grad_sql(['v'])}), m as (select layer, sqrt(v_dx*v_dx+v_dy*v_dy) as v from g), rk as (select layer, v, row_number() over (partition by layer order by v) as k, count(*) over (partition by layer) as n from m),
{PRC.format(n='hi', p='0.95')} select layer, round(sqrt(avg(v*v)),5) as gradient_rms, round(any_value(hi.q),5) as gradient_p95 from m join hi using (layer) group by layer""")
def _(p):
    t = R.texture(p, ["layer"])
    return t.select("layer", F.round("gradient_rms", 5).alias("gradient_rms"), F.round("gradient_p95", 5).alias("gradient_p95"))


@query("win_08_footprint", "fx_pixels", sql=f"""
with src as (select layer, r, c, 3.0*r+c*c/64.0 as sr, 2.5*c+r*0.25 as sc from fx_pixels), g as ({_grad_sql(['sr', 'sc'])}), f as (select layer, greatest(sqrt(sr_dx*sr_dx+sc_dx*sc_dx), sqrt(sr_dy*sr_dy+sc_dy*sc_dy)) as f from g)
select layer, round(quantile_cont(f,0.5),5) as median, round(quantile_disc(f,0.9),5) as p90, pow(2,greatest(0,floor(log2(greatest(quantile_cont(f,0.5),1))))) as reduction from f where f>0 group by layer""")
def _(p):
    m = p.select("layer", F.col("r").alias("out_r"), F.col("c").alias("out_c"), (3.0 * F.col("r") + F.col("c") * F.col("c") / 64).alias("src_r"), (2.5 * F.col("c") + F.col("r") * 0.25).alias("src_c"))
    f = R.footprint(m, ["layer"])
    return f.select("layer", F.round("median", 5).alias("median"), F.round("p90", 5).alias("p90"), "reduction")


def two(p):
    return p.filter("layer = 0").drop("layer"), p.filter("layer = 1").drop("layer")


@query("jon_12_compare_rasters", "fx_pixels", sql="""
with j as (select a.valid as ma, b.valid as mb, case when a.valid and b.valid then abs(a.v-b.v) end as d from (select * from fx_pixels where layer=0) a full join (select * from fx_pixels where layer=1) b using (r,c))
select count(d) as common, count_if(ma<>mb) as mask_mismatch, round(sqrt(avg(d*d)),5) as rms, max(d) as maximum, quantile_disc(d,0.95) as p95 from j""")
def _(p):
    out = R.compare_rasters(*two(p), ["r", "c"])
    return out.withColumn("rms", F.round("rms", 5))


@query("aud_07_audit_repeat", "fx_pixels", sql="""
select count(a.valid) as n_a, count(b.valid) as n_b, true as same_keys, bool_and(a.valid=b.valid) as equal_masks, max(abs(a.v-b.v)) as max_difference, round(count_if(b.valid)/count_if(a.valid),6) as retention
from (select * from fx_pixels where layer=0) a full join (select * from fx_pixels where layer=1) b using (r,c)""")
def _(p):
    out = R.audit_repeat(*two(p), ["r", "c"])
    return out.withColumn("retention", r6(F.col("retention")))


@query("aud_04_audit_disparity", "fx_pixels", sql=f"""
with d as (select layer, v/8 as disparity, valid, (v+(r*c)%9-4)/8 as truth, (r+c)%7<>0 as tv, (r*3+c)%11=0 as occ, -(v+(r+c)%3)/8 as rev from fx_pixels), e as (select *, case when valid and tv and not occ then abs(disparity-truth) end as e from d),
rk as (select layer, e as v, row_number() over (partition by layer order by e) as k, count(*) over (partition by layer) as n from e where e is not null), {PRC.format(n='hi', p='0.95')}
select layer, round(count_if(valid and tv and not occ)/count_if(tv and not occ),6) as completeness, round(count_if(e>0.25)/count(e),6) as outlier_rate, round(avg(case when valid and tv and not occ then abs(disparity+rev) end),6) as left_right_error,
 round(count_if(valid and occ)/count_if(occ),6) as occlusion_false_valid, round(any_value(hi.q),6) as p95 from e join hi using (layer) group by layer""")
def _(p):
    d = p.select("layer", (F.col("v") / 8).alias("disparity"), "valid", ((F.col("v") + (F.col("r") * F.col("c")) % 9 - 4) / 8).alias("truth"), ((F.col("r") + F.col("c")) % 7 != 0).alias("truth_valid"),
                 ((F.col("r") * 3 + F.col("c")) % 11 == 0).alias("occluded"), (-(F.col("v") + (F.col("r") + F.col("c")) % 3) / 8).alias("reverse"))
    a = R.audit_disparity(d, ["layer"], 0.25)
    return a.select("layer", *(r6(F.col(c)).alias(c) for c in ("completeness", "outlier_rate", "left_right_error", "occlusion_false_valid", "p95")))


def seeds(p):
    return R.seed_grid(p.filter("layer = 0"), 6, 5, 3, 2).select(F.concat_ws(":", "r", "c").alias("seed"), "r", "c", "valid")


ZN = """sd as (select r||':'||c as seed, r, c from fx_pixels where layer=0 and r%6=3 and c%5=2), df as (select unnest(range(-2,3)) as i), cd as (select sd.*, dx, dy from sd cross join (select unnest(range(-2,3)) as dx) cross join (select unnest(range(-1,2)) as dy)),
pt as (select seed, dx, dy, m.v as a, f.v as b from cd cross join (select a.i as i, b.i as j from df a cross join df b) join fx_pixels m on m.layer=0 and m.valid and m.r=cd.r+i and m.c=cd.c+j join fx_pixels f on f.layer=1 and f.valid and f.r=cd.r-dy+i and f.c=cd.c-dx+j),
zn as (select seed, dx, dy, corr(a,b) as score, stddev_samp(a) as texture from pt group by all having count(*)=25)"""


@query("ras_09_candidate_scores", "fx_pixels", sql=f"with {ZN} select seed, dx, dy, round(score,6)+0.0 as score, round(texture,5) as texture from zn")
def _(p):
    s = R.candidate_scores(seeds(p), *two(p), (-2, 2), (-1, 1), 2)
    return s.select("seed", "dx", "dy", r6(F.col("score")).alias("score"), F.round("texture", 5).alias("texture"))


@query("top_03_best_two", "fx_pixels", sql=f"""
with {ZN}, q as (select seed, dx, dy, round(score,6)+0.0 as score from zn), k as (select *, row_number() over (partition by seed order by score desc, dx, dy) as rn, max(score) over (partition by seed) as m from q)
select seed, max(case when rn=1 then score end) as best, max(case when rn=1 then dx end) as dx, max(case when rn=1 then dy end) as dy, max(case when rn=2 then score end) as second, count_if(abs(score-m)<=1e-12) as ties, round(max(case when rn=1 then score end)-max(case when rn=2 then score end),6)+0.0 as margin from k group by seed""")
def _(p):
    s = materialize(R.candidate_scores(seeds(p), *two(p), (-2, 2), (-1, 1), 2).withColumn("score", r6(F.col("score"))))
    b = P.best_two(s, ["seed"], "score", ["dx", "dy"])
    return b.select("seed", "best", "dx", "dy", "second", "ties", r6(F.col("margin")).alias("margin"))


@query("ras_09_template_match", "fx_pixels")
def _(p):
    m = R.template_match(seeds(p), *two(p), (-2, 2), (-1, 1), 2)
    return m.select("seed", "state", F.round("disparity", 4).alias("disparity"), F.round("best", 5).alias("best"))


@query("ras_12_refine_matches", "fx_pixels")
def _(p):
    m = seeds(p).filter("valid").select("seed", "r", "c", F.col("r").alias("rr"), F.col("c").alias("rc"))
    out = R.refine_matches(m, *two(p))
    return out.select("seed", "status", F.round("shift_x", 4).alias("shift_x"), F.round("shift_y", 4).alias("shift_y"))


@query("ras_10_triangulate_disparity", "fx_pixels")
def _(p):
    d = p.filter("layer = 0").withColumn("disparity", F.col("v") / 16)
    d = (d.withColumn("aox", F.lit(-4.0)).withColumn("box", F.lit(4.0)).withColumn("aoy", F.lit(0.0)).withColumn("boy", F.lit(0.0)).withColumn("aoz", F.lit(0.0)).withColumn("boz", F.lit(0.0))
         .withColumn("adx", F.col("c") / 64).withColumn("ady", F.col("r") / 64).withColumn("adz", F.lit(1.0)).withColumn("bdx", (F.col("c") - F.col("disparity") - 4) / 64).withColumn("bdy", F.col("r") / 64).withColumn("bdz", F.lit(1.0)))
    out = R.triangulate_disparity(d, 2, 0.5)
    return out.select("r", "c", "point_valid", *(F.round("pair_" + k, 4).alias(k) for k in "xyz"))


@query("slv_15_scale_scores", "fx_pixels", sql="""
with pr as (select layer, cast(least(floor(c*4/64),3) as int) as strip, r, avg(v) as p from fx_pixels where valid group by all), h as (select layer, strip, r, p-avg(p) over (partition by layer, strip order by r rows between 7 preceding and 7 following) as h from pr),
q as (select a.strip, a.r, a.h as ha, s as shift, a.r*1.0+s as u from h a cross join (select unnest(range(-2,3)) as s) where layer=0)
select q.strip, shift, count(*) as n, round(corr(ha, b.h),6)+0.0 as score from q join h b on b.layer=1 and b.strip=q.strip and b.r=floor(u) join h e on e.layer=1 and e.strip=q.strip and e.r=floor(u)+1 group by all""")
def _(p):
    s = R.scale_scores(R.row_profiles(p, 4, 64), [1.0], [-2, -1, 0, 1, 2])
    return s.select("strip", "shift", "n", r6(F.col("score")).alias("score"))


@query("slv_15_vertical_scale", "fx_pixels")
def _(p):
    out = R.vertical_scale(p, 4, 64, [0.98, 0.99, 1.0, 1.01, 1.02], [-2, -1, 0, 1, 2])
    return out.select("strips", F.round("scale", 6).alias("scale"), F.round("correlation", 4).alias("correlation"), "confidence")
