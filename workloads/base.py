"""Registry of checked queries: a Spark callable and, where SQL can say it, an equivalent ANSI query.

Input views are written once as SELECT text over the given tables and used by both engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from raytable.runtime import tune

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()

VIEWS = {
    # keyed line items
    "fx_li": """select concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',cast(l_quantity as int),'-',
        cast(cast(l_shipdate as date) as string)) as record_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        cast(l_quantity as bigint) as q, cast(round(l_discount*100) as bigint) as disc,
        cast(round(l_tax*100) as bigint) as tax, l_returnflag from {lineitem}""",
    # views on a growing grid of footprints (constant overlap per view)
    "fx_views": """select concat('v',s_suppkey) as view_id, concat('p',n_regionkey) as pass_id, s_suppkey as position,
        cast((s_suppkey%10)*4 as double) as x0, cast((s_suppkey%10)*4+6 as double) as x1,
        cast(cast(floor(s_suppkey/10) as bigint)*4 as double) as y0,
        cast(cast(floor(s_suppkey/10) as bigint)*4+6 as double) as y1, 1000*(1+s_nationkey) as pixel_count
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    # feature matches between two of twelve views
    "fx_matches": """select record_id, concat('v',l_suppkey%12) as moving_view,
        concat('v',(l_suppkey+1+l_partkey%11)%12) as reference_view,
        l_orderkey%997 as moving_feature, (l_orderkey*7+l_linenumber)%997 as reference_feature,
        disc/cast(64 as double) as metric,
        (l_partkey%512)+l_linenumber/cast(8 as double) as moving_row, cast(l_orderkey%512 as double) as moving_col,
        (l_partkey%512)+l_linenumber/cast(8 as double)+(q-25)/cast(8 as double) as reference_row,
        (l_orderkey%512)+l_linenumber/cast(4 as double) as reference_col, l_returnflag from {fx_li}""",
    # rays: one per line item, a track per order
    "fx_rays": """select record_id as obs_id, l_orderkey as track, concat('v',l_suppkey%25) as view_id,
        concat('p',l_suppkey%5) as pass_id, cast(12*(l_suppkey%5)-24 as double) as ox,
        cast(12*cast(floor((l_suppkey%25)/5) as bigint)-24 as double) as oy, cast(0 as double) as oz,
        cast(l_orderkey%64-(12*(l_suppkey%5)-24) as double)+case when tax>=8 then 0.125 else 0 end as dx,
        cast(cast(floor(l_orderkey/64) as bigint)%64-(12*cast(floor((l_suppkey%25)/5) as bigint)-24) as double) as dy,
        cast(100+l_orderkey%8 as double) as dz, (50+disc)/cast(64 as double) as confidence,
        (q%8+1)/cast(8 as double) as nav, l_returnflag as mode_id from {fx_li}""",
    # dense pair records: one per line item, both ends named by view and observed feature
    "fx_ends": """select record_id, l_suppkey%8 as va, (l_suppkey+1+l_partkey%7)%8 as vb, l_orderkey as ka,
        l_orderkey+case when tax>=8 then 1 else 0 end as kb, q, disc, l_partkey, l_linenumber, l_returnflag from {fx_li}""",
    "fx_records": """select record_id, concat('v',va) as view_a, concat('v',vb) as view_b,
        concat('p',va%3) as pass_a, concat('p',vb%3) as pass_b, concat('o',ka) as obs_a, concat('o',kb) as obs_b,
        ka%512+case when q>48 then 0.5 else 0 end as row_a, cast(cast(floor(ka/512) as bigint) as double) as col_a,
        kb%512+cast(0 as double) as row_b, cast(cast(floor(kb/512) as bigint) as double) as col_b,
        cast(12*(va%4)-18 as double) as aox, cast(24*cast(floor(va/4) as bigint)-12 as double) as aoy, cast(0 as double) as aoz,
        cast(ka%64-(12*(va%4)-18) as double) as adx,
        cast(cast(floor(ka/64) as bigint)%64-(24*cast(floor(va/4) as bigint)-12) as double) as ady, cast(100+ka%8 as double) as adz,
        cast(12*(vb%4)-18 as double) as box, cast(24*cast(floor(vb/4) as bigint)-12 as double) as boy, cast(0 as double) as boz,
        cast(kb%64-(12*(vb%4)-18) as double) as bdx,
        cast(cast(floor(kb/64) as bigint)%64-(24*cast(floor(vb/4) as bigint)-12) as double) as bdy, cast(100+kb%8 as double) as bdz,
        case when disc=10 then 'ambiguous' else 'valid' end as match_state,
        (50+disc)/cast(64 as double) as confidence, (1+l_partkey%16)/cast(16 as double) as texture,
        (q%8+1)/cast(8 as double) as nav_a, (l_linenumber%8+1)/cast(8 as double) as nav_b,
        cast(ka%16 as double) as value_a, cast(kb%16+1 as double) as value_b,
        (1+l_partkey%8)/cast(8 as double) as radiometric,
        case when l_linenumber=7 and q>45 then 'occluded' when q%10=3 then 'unknown' else 'visible' end as visibility_a,
        case when q%10=4 then 'unknown' else 'visible' end as visibility_b,
        case when l_returnflag='R' then 'R' else '' end as mode_id from {fx_ends}""",
    # fusion points
    "fx_points": """select concat('pt',o_orderkey) as point_id, (o_orderkey%64)/cast(4 as double) as x,
        cast(floor(o_orderkey/64) as bigint)/cast(4 as double) as y, 8+(o_custkey%16)/cast(4 as double) as z,
        o_orderstatus as mode_id, concat('p',o_custkey%3) as pass_id, concat('v',o_custkey%5) as view_id,
        1+o_custkey%3 as pass_count, 1+o_custkey%7 as pair_count, (1+o_custkey%4)/cast(8 as double) as sigma,
        o_orderkey, o_custkey from {orders}""",
    # elevation grid, 64 columns wide, as many rows as the orders fill; 1 in 50 cells void
    "fx_dem": """select cast(floor(o_orderkey/64) as bigint) as r, o_orderkey%64 as c,
        case when o_orderkey%50=7 then null else 8+(o_orderkey%64)/cast(16 as double)
        +(cast(floor(o_orderkey/64) as bigint)%16)*(o_orderkey%64)/cast(64 as double) end as up from {orders}""",
    # two registered layers
    "fx_pixels": """select layer, cast(floor(o_orderkey/64) as bigint) as r, o_orderkey%64 as c,
        cast((31*cast(floor(o_orderkey/64) as bigint)+17*(o_orderkey%64)+5*layer+(o_orderkey*o_orderkey)%7)%256 as double) as v,
        (o_orderkey+layer)%41 <> 0 as valid
        from {orders} cross join (select 0 as layer union all select 1 as layer) l""",
    "fx_descriptors": "select vec_id, vec_id%2 as side, embedding, label from {embeddings}",
    "fx_view_times": """select concat('e',event_id) as view_id, event_type as pass_id, event_id,
        case when event_id%97=0 then null else cast(ts as timestamp) end as start_ts, 1+user_id%4 as line_rate, user_id from {events}""",
    "fx_solves": """select concat('s',event_id) as solve_id, event_type <> 'error' as converged,
        user_id%12 as min_match_count, event_id%11=0 as bound_hit, (1+user_id%8)/cast(8 as double) as rms_before,
        (1+event_id%8)/cast(8 as double) as rms_after, event_id%13=0 as unobservable, user_id, event_id from {events}""",
    "fx_log": """select user_id as store_id, event_id as seq,
        concat('g',user_id,'-',cast(floor(event_id/500) as bigint)) as generation_id,
        case event_id%6 when 0 then 'propose' when 1 then 'accept' when 2 then 'apply' when 3 then 'revert'
            when 4 then 'reject' else 'supersede' end as transition from {events}""",
    "fx_samples": """select record_id, l_partkey%16 as model_id, (l_orderkey%65-32)/cast(32 as double) as x,
        (l_partkey%65-32)/cast(32 as double) as y, (q-25)/cast(32 as double) as z from {fx_li}""",
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or an input view over it."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    parts = {n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **parts)


def oracle_text(sql: str) -> str:
    """Prefix the views a query names as common table expressions."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for dep in re.findall(r"\{(\w+)\}", VIEWS[name]):
            if dep in VIEWS:
                visit(dep)
        order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    ctes = [f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order]
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[len("with recursive"):]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[len("with"):]
    return "with " + ",\n".join(ctes) + "\n" + body


def query(name: str, *inputs: str, sql: str | None = None):
    """Register fn(*frames) under ``name``; ``inputs`` are tables or views."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(*(table(spark, sf_dir, i) for i in inputs))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return fn

    return wrap
