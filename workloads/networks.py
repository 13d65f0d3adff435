"""Consensus models and network adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from raytable.functions.scalars import round6 as r6
from raytable.operators import network as N

from .base import query

PAIR = ["moving_view", "reference_view"]


def planar(m):
    return m.select("record_id", *PAIR, "l_returnflag", F.col("moving_col").alias("mx"), F.col("moving_row").alias("my"),
                    # a similarity of the moving position, with one third of the rows disturbed
                    (1.5 * F.col("moving_col") - 0.25 * F.col("moving_row") + 8 + F.when(F.col("l_returnflag") == "R", F.col("reference_col") % 64 + 9).otherwise(0)).alias("rx"),
                    (0.25 * F.col("moving_col") + 1.5 * F.col("moving_row") - 4 + F.when(F.col("l_returnflag") == "R", F.col("reference_row") % 32 + 7).otherwise(0)).alias("ry"))


@query("slv_04_consensus_similarity", "fx_matches", sql="""
select record_id, case when l_returnflag='R' then false else true end as accepted from fx_matches""")
def _(m):
    _, out = N.consensus_model(planar(m), PAIR, ["record_id"], "similarity", 3.0)
    return out.select("record_id", "accepted")


@query("slv_04_consensus_affine", "fx_matches", sql="""
select distinct moving_view, reference_view, 1.5::double as a, -0.25::double as b, 8.0::double as tx, 0.25::double as c, 1.5::double as d, -4.0::double as ty from fx_matches""")
def _(m):
    w, _ = N.consensus_model(planar(m), PAIR, ["record_id"], "affine", 3.0)
    return w.select(*PAIR, *(r6(F.col(c)).alias(c) for c in N.MATRIX))


@query("slv_06_block_counts", "fx_records", sql="select view_a, view_b, cast(count(*) as double) as n from fx_records group by all")
def _(r):
    b = N.normal_blocks(r, None, N.AdjustOptions())
    return b.select("view_a", "view_b", F.get("v", F.lit(28)).alias("n"))


def mispointed(r):
    """Rays from both views of a record to one ground point, turned back by planted angles; views stand on a ring at four heights."""
    key = F.col("ka").cast("long")
    ground = [key % 64 * 2.0 - 63, F.floor(key / 64) % 64 * 2.0 - 63, 20.0 + key % 7 * 12]
    out = r.select("view_a", "view_b", F.substring("obs_a", 2, 18).alias("ka")).select("view_a", "view_b", *(g.alias(f"g{c}") for g, c in zip(ground, "xyz")))
    for s in "ab":
        n = F.substring(f"view_{s}", 2, 9).cast("int")
        o, p, k = ((n * 3 % 7 - 3) / 500.0, (n * 5 % 7 - 3) / 400.0, (n * 2 % 5 - 2) / 250.0)
        origin = [80 * F.cos(n * 0.785), 80 * F.sin(n * 0.785), n % 4 * 20.0 - 30]
        out = out.withColumns({f"{s}o{c}": v for c, v in zip("xyz", origin)})
        x, y, z = (F.col(f"g{c}") - F.col(f"{s}o{c}") for c in "xyz")
        x, y = F.cos(k) * x + F.sin(k) * y, F.cos(k) * y - F.sin(k) * x
        x, z = F.cos(p) * x - F.sin(p) * z, F.sin(p) * x + F.cos(p) * z
        y, z = F.cos(o) * y + F.sin(o) * z, F.cos(o) * z - F.sin(o) * y
        out = out.withColumns({f"{s}dx": x, f"{s}dy": y, f"{s}dz": z})
    return out


@query("slv_06_adjust_views", "fx_records", sql="""
with v as (select view_a as view_id from fx_records union select view_b from fx_records), n as (select view_id, cast(substr(view_id, 2) as int) as n from v)
select view_id, (n*3%7-3)/500.0::double as omega, (n*5%7-3)/400.0::double as phi, (n*2%5-2)/250.0::double as kappa, (select count(*) from fx_records) as records, true as improved from n""")
def _(r):
    v, _ = N.adjust_views(mispointed(r), N.AdjustOptions(prior_sigma=100.0), sigmas=False)
    return v.select("view_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in N.ANGLES), "records", (F.col("cost_after") < 1e-6 * F.col("cost_before")).alias("improved"))


@query("slv_07_leave_one_out", "fx_records")
def _(r):
    out = N.leave_one_out(N.normal_blocks(r, None, N.AdjustOptions(prior_sigma=0.001)), N.AdjustOptions(prior_sigma=0.001))
    return out.select("view_a", "view_b", F.round("max_change", 6).alias("max_change"), F.round("rms_change", 6).alias("rms_change"), "missing_views")


def attitude(m):
    return m.select("moving_view", "moving_col", ((F.col("reference_row") - F.col("moving_row")) / 8).alias("r"), (1 + F.col("moving_row") / 512).alias("j"))


@query("slv_08_spline_blocks", "fx_matches", sql="""
with u as (select moving_view, (reference_row-moving_row)/8 as r, 1+moving_row/512 as j, least(512,greatest(0,moving_col))/128 as u from fx_matches), k as (select *, least(floor(u),3) as k from u), t as (select *, u-k as t from k),
w as (select moving_view, r, j, cast(k as bigint)+i as ctl, case i when 0 then (1-t)*(1-t)*(1-t)/6 when 1 then (3*t*t*t-6*t*t+4)/6 when 2 then (-3*t*t*t+3*t*t+3*t+1)/6 else t*t*t/6 end as w from t cross join (select unnest(range(4)) as i))
select moving_view, ctl as i, round(sum(w*j*w*j),4) as h, round(sum(w*j*r),4)+0.0 as g, count(*) as n from w group by all""")
def _(m):
    b = N.spline_blocks(attitude(m), "moving_view", "moving_col", 512, 128)
    return b.filter("i = k").select("moving_view", "i", F.round("h", 4).alias("h"), (F.round("g", 4) + F.lit(0.0)).alias("g"), "n")


@query("slv_08_adjust_spline", "fx_matches")
def _(m):
    out = N.adjust_spline(attitude(m), "moving_view", "moving_col", 512, 128)
    return out.select("moving_view", "control", F.round("value", 6).alias("value"), "supported")
