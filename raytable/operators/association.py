"""From pair records to observations and multi-view tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raytable.functions import geometry as G
from raytable.functions.scalars import content_id
from raytable.functions.vec import Vec, acos_degrees, with_vec
from raytable.runtime import is_empty, stored

from .graph import components, reconcile, split_modes
from .ledger import df_state, precheck

SIDE = ("view", "pass", "obs", "row", "col", "nav", "value", "visibility")
RAY = ("ox", "oy", "oz", "dx", "dy", "dz")


def node_key(view: Column, obs: Column) -> Column:
    return F.concat_ws("|", view, obs)


def endpoints(records: DataFrame) -> DataFrame:
    """Both ends of every record as observation candidates (two rows per record)."""
    def end(s):
        return F.struct(F.lit(s).alias("side"), *(F.col(f"{c}_{s}").alias(c) for c in SIDE), *(F.col(f"{s}{c}").alias(c) for c in RAY))

    df = records.select("record_id", F.concat_ws("|", F.least("view_a", "view_b"), F.greatest("view_a", "view_b")).alias("pair_id"),
                        "confidence", F.explode(F.array(end("a"), end("b"))).alias("e"))
    return df.select("record_id", "pair_id", "confidence", "e.*").withColumn("node", node_key(F.col("view"), F.col("obs")))


def _extremes() -> dict[str, Column]:
    """Per observation, in buffers of fixed width: the box around its members and what else tells whether they agree.

    A text value is compared by two 64-bit hashes, as minima of texts would sort all rows.
    """
    out = {"_nr": F.avg("row"), "_nc": F.avg("col")}
    for c in ("row", "col", "ox", "oy", "oz", "_d.x", "_d.y", "_d.z"):
        out |= {f"_lo_{c.replace('.', '')}": F.min(c), f"_hi_{c.replace('.', '')}": F.max(c)}
    known = F.col("pass").isNotNull()
    for k, text in enumerate((F.col("pass"), F.concat(F.lit("#"), F.reverse("pass")))):
        out |= {f"_lo_p{k}": F.min(F.when(known, F.xxhash64(text))), f"_hi_p{k}": F.max(F.when(known, F.xxhash64(text)))}
    numbers = ("row", "col", "ox", "oy", "oz", "_d.x", "_d.y", "_d.z")
    missing = sum((F.col(c).isNull().cast("int") for c in numbers), F.lit(0)) > 0
    return out | {"_vis": F.max(F.col("visibility") == "visible"), "_occ": F.max(F.col("visibility") == "occluded"), "_missing": F.max(missing)}


def _agreement(pixel: float, origin: float, direction: float) -> Column:
    """Whether the members of an observation agree, as far as ``_extremes`` tell; NULL where the members have to be looked at.

    The largest distance from the mean lies between the largest distance along one axis and the diagonal of these distances. Origins and
    directions are decided with a margin of half the limit or more, so that rounding of the means does not matter.
    """
    far = lambda c, m: F.greatest(F.col(f"_hi_{c}") - F.col(m), F.col(m) - F.col(f"_lo_{c}"))
    size = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    row, col = far("row", "_nr"), far("col", "_nc")
    wide = lambda names: (F.greatest(*(size(c) for c in names)), F.sqrt(sum((size(c) * size(c) for c in names), F.lit(0.0))))
    (o_side, o_diagonal), (d_side, d_diagonal) = wide(("ox", "oy", "oz")), wide(("_dx", "_dy", "_dz"))
    agree = (F.hypot(row, col) <= pixel) & (o_diagonal <= 0.5 * origin) & (F.degrees(d_diagonal) <= 0.5 * direction)
    differ = (F.greatest(row, col) > pixel) | (o_side > 2.01 * origin) | (F.degrees(d_side) > 2.01 * direction)
    one = F.coalesce((F.col("_lo_p0") == F.col("_hi_p0")) & (F.col("_lo_p1") == F.col("_hi_p1")), F.lit(False))
    mixed = F.coalesce(F.col("_vis") & F.col("_occ"), F.lit(False))
    return F.when(~one | mixed, F.lit(False)).when(F.col("_missing"), F.lit(None).cast("boolean")).when(differ, F.lit(False)).when(agree, F.lit(True))


def _observed(ends: DataFrame, values: dict[str, Column], pixel: float, origin: float, direction: float) -> DataFrame:
    """view_id, obs_id, the aggregates ``values`` and ``consistent``: one shuffle; only members of undecided observations are looked at again."""
    unit = with_vec(ends, "_d", Vec.prefixed("d").unit())
    keys = {"view_id": F.col("view"), "obs_id": F.col("obs")}
    first = unit.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*(c.alias(k) for k, c in {**values, **_extremes()}.items()))
    first = stored(first.select(*keys, *values, _agreement(pixel, origin, direction).alias("consistent")))
    undecided = first.filter("consistent is null")
    if is_empty(undecided):
        return first
    same = lambda a, b: a["view"].eqNullSafe(b["view_id"]) & a["obs"].eqNullSafe(b["obs_id"])
    names = undecided.select(*keys)
    members = stored(unit.join(names, same(unit, names), "left_semi").select("view", "obs", "row", "col", "ox", "oy", "oz", "_d"))
    means = members.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.avg("row").alias("m_row"), F.avg("col").alias("m_col"), *(F.avg(f"o{c}").alias(f"m_o{c}") for c in "xyz"), *(F.avg(f"_d.{c}").alias(f"_s{c}") for c in "xyz"))
    means = with_vec(means, "m_d", Vec.prefixed("_s").unit()).drop("_sx", "_sy", "_sz")
    far = members.join(means, same(members, means)).groupBy(*keys).agg(
        F.max(F.hypot(F.col("row") - F.col("m_row"), F.col("col") - F.col("m_col"))).alias("_px"),
        F.max((Vec.prefixed("o") - Vec.prefixed("m_o")).norm()).alias("_om"), F.max(acos_degrees(Vec.field("_d").dot(Vec.field("m_d")))).alias("_ang"))
    # one pass and no conflict of visibility are known by now
    ok = (F.col("_px") <= pixel) & (F.col("_om") <= origin) & (F.col("_ang") <= direction)
    late = far.select(F.col("view_id").alias("view"), F.col("obs_id").alias("obs"), ok.alias("_ok"))
    exact = undecided.drop("consistent").join(late, same(late, undecided)).select(*keys, *values, F.col("_ok").alias("consistent"))
    return first.filter("consistent is not null").unionByName(exact)


OBSERVED = ("node", "view_id", "obs_id", "row", "col", "ox", "oy", "oz", "confidence", "nav", "occurrences", "pair_count", "dx", "dy", "dz", "pass_id", "consistent", "visibility")


def consolidate_observations(ends: DataFrame, pixel: float = 0.25, origin: float = 1e-6, direction: float = 1e-5, keep: list[str] | None = None) -> DataFrame:
    """One row per observation: means, extremes, visibility merge, and whether all members agree.

    All aggregates combine before the shuffle, and the rows are shuffled once. ``keep`` names the columns that are wanted (None: all):
    only what they need is shuffled, and without ``consistent`` the members are not compared.
    """
    keep = list(OBSERVED if keep is None else keep)
    # the node names its view and feature, so these are the key; text values are gathered as (tiny) sets, which stay hash aggregates
    values = {
        "row": F.avg("row"), "col": F.avg("col"), **{f"o{c}": F.avg(f"o{c}") for c in "xyz"}, **{f"_s{c}": F.avg(f"_d.{c}") for c in "xyz"}, "confidence": F.max("confidence"), "nav": F.min("nav"),
        "_passes": F.array_sort(F.collect_set("pass")), "_states": F.array_sort(F.collect_set("visibility")), "occurrences": F.count(F.lit(1)), "pair_count": F.size(F.collect_set("pair_id")).cast("bigint")}
    rays = any(c in keep for c in ("dx", "dy", "dz"))
    used = {*keep, *(("_sx", "_sy", "_sz") if rays else ()), *(k for k, c in (("_passes", "pass_id"), ("_states", "visibility")) if c in keep)}
    values = {k: c for k, c in values.items() if k in used}
    if "consistent" in keep:
        out = _observed(ends, values, pixel, origin, direction)
    else:
        if rays:
            ends = with_vec(ends, "_d", Vec.prefixed("d").unit())
        out = ends.groupBy(F.col("view").alias("view_id"), F.col("obs").alias("obs_id")).agg(F.count(F.lit(1)).alias("_members"), *(c.alias(k) for k, c in values.items()))
    if rays:
        out = with_vec(out, "_u", Vec.prefixed("_s").unit())
    has = lambda s: F.array_contains("_states", s)
    same = F.when(F.size("_states") == 1, F.get("_states", F.lit(0)))
    visibility = F.when(same.isNotNull(), same).when(has("occluded"), "conflicting").when(has("visible"), "visible").otherwise("unknown")
    made = {"node": node_key(F.col("view_id"), F.col("obs_id")), **{f"d{c}": F.col(f"_u.{c}") for c in "xyz"}, "pass_id": F.get("_passes", F.lit(0)), "visibility": visibility}
    return out.select(*(made.get(c, F.col(c)).alias(c) for c in keep))


def consistent_observations(ends: DataFrame, pixel: float = 0.25, origin: float = 1e-6, direction: float = 1e-5) -> DataFrame:
    """node, consistent: as ``consolidate_observations``, without what only the observations themselves need."""
    return _observed(ends, {}, pixel, origin, direction).select(node_key(F.col("view_id"), F.col("obs_id")).alias("node"), "consistent")


def attach_consistency(records: DataFrame, observations: DataFrame) -> DataFrame:
    obs = observations.select("node", "consistent")
    df = records.withColumn("u", node_key(F.col("view_a"), F.col("obs_a"))).withColumn("v", node_key(F.col("view_b"), F.col("obs_b")))
    for side, key in (("a", "u"), ("b", "v")):
        df = df.join(obs.select(F.col("node").alias(key), F.col("consistent").alias(f"consistent_{side}")), key)
    return df


def with_pair_geometry(records: DataFrame) -> DataFrame:
    return G.triangulate_pair(records, Vec.prefixed("ao"), Vec.prefixed("ad"), Vec.prefixed("bo"), Vec.prefixed("bd"))


def check_records(records: DataFrame, observations: DataFrame, keep: list[str] | None = None, **thresholds: float) -> DataFrame:
    """``precheck`` of records with pair geometry against the consistency of their observations; adds the nodes u and v.

    All rules of a record alone are decided before the joins, so only record_id and the columns in ``keep`` are shuffled (None: all).
    """
    alone = precheck(with_pair_geometry(records).withColumns({"consistent_a": F.lit(True), "consistent_b": F.lit(True)}), **thresholds).drop("consistent_a", "consistent_b", "association_state")
    alone = alone.withColumn("_valid", ~F.coalesce(F.col("match_state") != "valid", F.lit(False)))
    if keep is not None:
        alone = alone.select("record_id", *(c for c in dict.fromkeys([*keep, "view_a", "obs_a", "view_b", "obs_b"]) if c != "record_id"), "association_reason", "_valid")
    df = attach_consistency(alone, observations)
    conflict = F.col("_valid") & ~(F.col("consistent_a") & F.col("consistent_b"))
    df = df_state(df.withColumn("association_reason", F.when(conflict, "observationIdentityConflict").otherwise(F.col("association_reason"))).drop("_valid"))
    return df if keep is None else df.select("record_id", *(c for c in dict.fromkeys(keep) if c not in ("record_id", "u", "v")), "u", "v", "association_reason", "association_state")


def record_quality() -> Column:
    return F.col("confidence") * F.col("texture") * F.col("radiometric") * F.least("nav_a", "nav_b")


def associate(records: DataFrame, separation: float | None = None, keep: list[str] | None = None, observations: DataFrame | None = None, **thresholds: float) -> tuple[DataFrame, DataFrame]:
    """Association of pair records: (records with state, reason, mode and track; observations).

    ``keep`` names the columns of the records that are carried along, all if None. ``observations`` (node, consistent) are taken if given.
    """
    obs = consolidate_observations(endpoints(records)) if observations is None else observations
    place = ["pair_x", "pair_y", "pair_z"]
    needed = None if keep is None else ["view_a", "view_b", "mode_id", *(() if separation is None else place), "_quality", *keep]
    checked = stored(check_records(records.withColumn("_quality", -record_quality()), obs, needed, **thresholds))
    eligible = checked.filter("association_state = 'candidate'").select("record_id", "u", "v", "view_a", "view_b", "mode_id", *(() if separation is None else place), "_quality")
    comp = components(eligible)
    edges = eligible.join(comp.withColumnRenamed("node", "u"), "u")
    edges = split_modes(edges, separation)
    edges = edges.withColumn("pair_id", F.concat_ws("|", F.least("view_a", "view_b"), F.greatest("view_a", "view_b")))
    edges = stored(edges.select("record_id", "u", "v", F.col("view_a").alias("view_u"), F.col("view_b").alias("view_v"), "pair_id", "component", "mode_key", "_quality"))
    done = reconcile(edges, ["component", "mode_key"], [F.col("_quality"), F.col("pair_id")], roots=True)
    done = stored(done.select("record_id", "mode_key", "component", F.when(F.col("accepted"), F.concat_ws("#", "root", "mode_key")).alias("track_root"), F.col("accepted").alias("_ok")))
    out = checked.join(done, "record_id", "left")
    out = (out.withColumn("association_state", F.when(F.col("_ok"), "accepted").when(~F.col("_ok"), "rejected").otherwise(F.col("association_state")))
           .withColumn("association_reason", F.when(~F.col("_ok"), "duplicateViewConflict").otherwise(F.col("association_reason"))).drop("_ok", "_quality"))
    return out, obs


def tracks(records: DataFrame, observations: DataFrame) -> DataFrame:
    """Track table with content id, members and independent counts (a track has at most one observation per view)."""
    acc = records.filter("association_state = 'accepted'")
    member = acc.select("track_root", "mode_key", F.explode(F.array("u", "v")).alias("node")).distinct().join(observations.select("node", "view_id", "pass_id"), "node")
    nodes = member.groupBy("track_root", "mode_key").agg(
        F.array_sort(F.collect_list("node")).alias("observation_keys"), F.count(F.lit(1)).alias("view_count"), F.count_distinct("pass_id").alias("pass_count"))
    counts = acc.groupBy("track_root").agg(F.count(F.lit(1)).alias("record_count"))
    modes = acc.select("component", "mode_key").distinct().groupBy("component").agg((F.count(F.lit(1)) > 1).alias("competing_mode"))
    comp = acc.groupBy("track_root").agg(F.first("component").alias("component")).join(modes, "component").drop("component")
    out = nodes.join(counts, "track_root").join(comp, "track_root")
    return out.withColumn("track_id", content_id("dense-track-", mode=F.col("mode_key"), keys=F.col("observation_keys")))
