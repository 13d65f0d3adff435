"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, from DataFrame functions alone.

1. Sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a target stops at ``REPEATS``
   times its source's size and the excess is shared again by weight (one aggregated row a round, rounds end when no target is above).
2. Documents are dealt to ``SHARDS`` shards by a keyed digest and lie there, per source, in the order of that digest. The words of
   a (source, shard) cell are cut into blocks of equal length, the last one may be shorter. A block is the 256th part of the
   smallest target (one word at least), so a rounded quota is near every target.
3. Highest quotients target / (2k - 1) give every source its number of blocks; the same rule with blocks as votes shares a
   source's number among its shards. Only quotients near the common divisor are ranked (at most 3 a member): the divisor
   total / seats gives a safe lower and upper number of seats for each member. As the method never takes a seat back when more
   are given, no shard gets more than ``REPEATS`` times its blocks.
4. Seeded selection: block j of a cell with n blocks and quota q is taken floor((j+u+1) q / n) - floor((j+u) q / n) times, u a keyed
   offset; the quota is met exactly and no block is taken more than ``REPEATS`` times. What a document gives follows from its place
   in the cell by arithmetic, so blocks are never listed.

Places are running sums over range slices (a source may hold any share of the rows). Targets and quotas are per source and per
cell; only one-row sums reach the driver.

Defined cases: a null text has size 0 and gives nothing; a null source is a source of its own; a null doc_id takes part; repeated
rows are documents of their own; an empty table, or one without words, takes nothing; other columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raytable.operators.ordered import running_sum

from .common import prepare
from .sharding import numbered

WEIGHTS, SHARE, REPEATS, SHARDS = (5, 2, 1), 1.5, 2, 24
FINENESS = 256  # blocks in the smallest target
SEED = "mix-1"


def _keyed(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def fill(sources: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> tuple[float, float]:
    """(words a unit of weight gets, sum of all targets) such that no target is above ``repeats`` times its source's size."""
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        above = F.col("weight") * level > F.col("source_size") * repeats
        row = sources.agg(F.sum(F.when(above, F.col("source_size") * repeats).otherwise(0)).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["weight"] or (new := (total - row["full"]) / row["weight"]) <= level:
            return max(level, 0.0), total
        level = new


def _bounds(vote: Column, votes: Column, members: Column, seats: Column) -> tuple[Column, Column]:
    """Seats that a member has in any case, and seats it has at most."""
    more = F.floor(members / 2) + 1
    low = F.when(seats > more, F.floor(vote * (seats - more) / votes + 0.5)).otherwise(0).cast("long")
    return low, F.least(seats, F.floor(vote * (seats + more) / votes + 0.5).cast("long"))


def _quotients(members: DataFrame, vote: str) -> DataFrame:
    """A row per seat in question (columns low, high): its quotient, negative, so that it sorts first."""
    open_ = members.filter("high > low").withColumn("seat", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    return open_.withColumn("rank_by", -F.col(vote) / (2 * F.col("seat") - 1))


def apportion_sources(sources: DataFrame, seats: int, total: float) -> DataFrame:
    """``sources`` (place, target) with ``quota``: the Sainte-Lague apportionment of ``seats``; ties go to the smaller place."""
    low, high = _bounds(F.col("target"), F.lit(total), F.lit(sources.count()), F.lit(seats))
    both = sources.withColumn("low", low).withColumn("high", high).checkpoint(eager=True)
    rest = seats - (both.agg(F.sum("low")).first()[0] or 0)
    won = numbered(_quotients(both, "target").select("place", "rank_by"), ["rank_by", "place"], "rank").filter(F.col("rank") < rest).groupBy("place").agg(F.count(F.lit(1)).alias("won"))
    return both.join(won, "place", "left").withColumn("quota", F.col("low") + F.coalesce("won", F.lit(0))).drop("low", "high", "won")


def apportion_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (place, shard, blocks, quota of the source) with ``cell_quota``. A source has at most SHARDS cells."""
    own = Window.partitionBy("place")
    low, high = _bounds(F.col("blocks"), F.sum("blocks").over(own), F.count(F.lit(1)).over(own), F.col("quota"))
    both = cells.withColumn("low", low).withColumn("high", high).withColumn("rest", F.col("quota") - F.sum("low").over(own)).checkpoint(eager=True)
    rank = F.row_number().over(Window.partitionBy("place").orderBy("rank_by", "shard"))
    won = _quotients(both, "blocks").withColumn("rank", rank).filter("rank <= rest").groupBy("place", "shard").agg(F.count(F.lit(1)).alias("won"))
    return both.join(won, ["place", "shard"], "left").withColumn("cell_quota", F.col("low") + F.coalesce("won", F.lit(0))).drop("low", "high", "rest", "won")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _taken_before(t: Column, block: int) -> Column:
    """Words taken of the first t words of a cell (columns blocks, cell_quota, offset)."""
    n = F.greatest(F.col("blocks"), F.lit(1))
    whole, part = _div(F.col("cell_quota"), n), F.col("cell_quota") % n

    def copies_before(j: Column) -> Column:
        wide = [_div((x.cast("decimal(18,0)") * part.cast("decimal(18,0)")), n.cast("decimal(18,0)")) for x in (j + F.col("offset"), F.col("offset"))]
        return whole * j + wide[0] - wide[1]

    j = _div(t, F.lit(block))
    return block * copies_before(j) + (t - j * block) * (copies_before(j + 1) - copies_before(j))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and shard and source, for every row of ``docs``."""
    prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    slim = slim.withColumn("digest", _keyed(seed, F.col("doc_id"))).withColumn("shard", (_number(F.col("digest")) % shards).cast("int")).checkpoint(eager=True)
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("missing", F.col("source").isNull())
    sources = numbered(sources, ["missing", "source"], "place").drop("missing")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).checkpoint(eager=True)
    level, total = fill(sources, share)
    sources = sources.withColumn("target", F.least(F.col("weight") * F.lit(level), (F.col("source_size") * REPEATS).cast("double")))
    least = sources.filter("target > 0").agg(F.min("target")).first()[0]
    block = max(1, math.floor((least or 0) / FINENESS))
    placed = slim.join(sources.select(F.col("source").alias("same"), "place"), F.col("source").eqNullSafe(F.col("same"))).drop("same")
    cells = placed.groupBy("place", "shard").agg(F.ceil(F.sum("size") / block).cast("long").alias("blocks")).checkpoint(eager=True)
    if total:
        quotas = apportion_sources(sources, math.floor(total / block + 0.5), total)
    else:
        quotas = sources.withColumn("quota", F.lit(0).cast("long"))
    room = cells.groupBy("place").agg((F.sum("blocks") * REPEATS).alias("room")).filter("room > 0")
    cells = apportion_cells(cells.join(quotas.join(room, "place").select("place", F.least("quota", "room").alias("quota")), "place"))
    cells = cells.withColumn("offset", _number(_keyed(seed, F.lit("offset"), F.col("place"), F.col("shard"))) % F.greatest("blocks", F.lit(1)))
    rows = running_sum(placed, ["place", "shard"], ["digest", "doc_id", "size"], F.col("size"), "end")
    rows = rows.join(cells.select("place", "shard", "blocks", "cell_quota", "offset"), ["place", "shard"], "left").join(sources.select("place", "source_size", "target"), "place")
    taken = F.coalesce(_taken_before(F.col("end"), block) - _taken_before(F.col("end") - F.col("size"), block), F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard")


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("source", "shard")
