"""Conversation prefix trie as a minimal-perfect-hash node table.

1. Prefix digests. A turn becomes two 64-bit hashes of (role, text); the digest of a prefix is the exclusive or of the hashes of
   (depth, turn) along it, in two lanes. Exclusive or is associative, so a conversation may lie in many slices: rows are
   range-partitioned on (conversation, order), scanned slice by slice, and one small row per slice carries its state over the border.
   No conversation has to fit into a task.
2. Nodes are the distinct digests. Members are counted with map-side combining, so a turn that opens a third of all
   conversations is one row per task. A node belongs to its smallest member; the nodes of one member form a path, cut
   into segments of ``SEGMENT`` depths. A digest whose rows disagree in depth, parent or size stops the job.
3. Sums of whole subtrees between segments come from doubling: a segment adds the sums of those whose pointer names it, then
   all pointers jump. The rounds are the logarithm of the height in segments, whatever the shape of the trie.
4. Segments are dealt to shards. A shard numbers its digests with a minimal perfect hash (levels of hashed bits; the slot of a digest
   is the rank of its bit), verifies every slot against the stored digest, scatters counts into flat arrays and
   adds them up through the array of parent slots, deepest level first. Sums of other segments enter at the slot they hang from.

Text of a node: turn ``depth`` of conversation ``conv_id``. Two different prefixes share a digest with a probability below 1e-18 at
1e10 nodes.

Defined cases: rows without conv_id belong to no conversation and take no part; null turns come first; equal turn numbers are
ordered by role, then by hash of the text; repeated rows are repeated turns; null role and text are empty; an empty table has no
nodes, not even a root; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import mix64, prepare

BRANCH, HEADS = 5, 9  # of the rebuilding: conversations of five share the first turns of one, fewer than nine
SEGMENT = 1 << 16  # depths of one path in one shard
SHARD_NODES = 200_000
CHUNK = 4096  # ids joined into one string before a node's strings meet
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, d1 long, d2 long"


# -- running values over slices

def _scan_slice(key: str, lanes: dict[str, str], number: str, fields: list[str]):
    """Rows sorted by key: the place of each within its key and running exclusive ors, counted from the start of the slice."""

    def run(batches):
        last, count, state = None, 0, {k: np.int64(0) for k in lanes}
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            k = col[key].to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            group = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
            place = np.arange(len(k)) - start[group] + 1
            goes_on = last is not None and k[0] == last
            place[group == 0] += count if goes_on else 0
            out = {number: place}
            for lane, name in lanes.items():
                total = np.concatenate([[0], np.bitwise_xor.accumulate(col[lane].to_numpy(zero_copy_only=False))])
                run_ = total[1:] ^ total[start[group]]
                if goes_on:
                    run_[group == 0] ^= state[lane]
                out[name] = run_
                state[lane] = run_[-1]
            last, count = k[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*(col[f] for f in fields), *(pa.array(v.astype(np.int64)) for v in out.values())], [*fields, *out])

    return run


def scan(rows: DataFrame, key: str, order: list[str], number: str, lanes: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with their place within ``key`` (from 1, by ``order``, nulls first) and running exclusive ors of ``lanes`` (column: new name).

    One row per slice is brought to the driver: the state of the last key of the slice.
    """
    spark, lanes = rows.sparkSession, lanes or {}
    sliced = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_slice", F.spark_partition_id())
    new = [number, *lanes.values()]
    schema = StructType([*sliced.schema.fields, *(StructField(n, LongType()) for n in new)])
    local = sliced.mapInArrow(_scan_slice(key, lanes, number, sliced.columns), schema).checkpoint(eager=True)
    ends = local.groupBy("_slice").agg(F.max(F.struct(key, *new)).alias("last")).orderBy("_slice").collect()
    carry, held = [], (None, [])
    for here, following in zip(ends, ends[1:]):
        name, state = here["last"][key], [here["last"][n] for n in new]
        if held[0] == name:  # the whole slice is of one key, which began in an earlier one
            state = [state[0] + held[1][0], *(a ^ b for a, b in zip(state[1:], held[1][1:], strict=True))]
        held = name, state
        carry.append((following["_slice"], name, *state))
    before = spark.createDataFrame(carry, f"_slice int, {key} long, " + ", ".join(f"_before_{n} long" for n in new))
    out = local.join(F.broadcast(before), ["_slice", key], "left")  # a row per slice
    out = out.withColumn(number, F.col(number) + F.coalesce(f"_before_{number}", F.lit(0)))
    for n in lanes.values():
        out = out.withColumn(n, F.col(n).bitwiseXOR(F.coalesce(f"_before_{n}", F.lit(0))))
    return out.drop("_slice", *(f"_before_{n}" for n in new))


# -- turns

def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), k1, k2 (hashes of role and text), bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv is not null")
    hashed = slim.select("conv", "turn", "role", F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "role", "text").alias("k2"),
                         F.octet_length("text").cast("long").alias("bytes"))
    return scan(hashed, "conv", ["turn", "role", "k1", "k2"], "pos").select("conv", "pos", "k1", "k2", "bytes")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, k1, k2, bytes) and (conv, size) of conversations as they stand."""
    return turns.withColumnRenamed("pos", "depth"), turns.groupBy("conv").agg(F.max("pos").alias("size"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same after rebuilding: the first h turns of conversation c - c % 5, then the own turns after the first h; h = crc32(c) % 9."""
    size = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    convs = size.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv") - F.col("conv") % BRANCH)
    convs = convs.join(size.select(F.col("conv").alias("base"), F.col("own").alias("given")), "base", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0)))).checkpoint(eager=True)
    kept = turns.join(convs.select("conv", "h", "given"), "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "k1", "k2", "bytes")
    heads = turns.filter((F.col("pos") < HEADS) & (F.col("conv") % BRANCH == 0)).withColumnRenamed("conv", "base")
    lent = convs.select("conv", "base", "h").join(heads, "base").filter("pos <= h").select("conv", F.col("pos").alias("depth"), "k1", "k2", "bytes")
    return kept.unionByName(lent), convs.select("conv", (F.col("given") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("size"))


# -- the node table of a shard

class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests: levels of hashed bits, the slot is the rank of a digest's bit."""

    def __init__(self, a: np.ndarray, b: np.ndarray, levels: int = 64):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        left, base = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == levels:
                raise ValueError("two nodes have one digest")
            h = self._hash(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(h, minlength=2 * len(left)) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            placed = alone[h]
            self.a[rank[h[placed]]], self.b[rank[h[placed]]] = a[left[placed]], b[left[placed]]
            left, base = left[~placed], base + int(alone.sum())

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(a ^ mix64(b + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for one that is not in the table."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            h = self._hash(a[left], b[left], level, len(alone))
            hit = alone[h]
            out[left[hit]] = rank[h[hit]]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        wrong = (self.a[out[found]] != a[found]) | (self.b[out[found]] != b[found])
        out[found[wrong]] = -1
        return out


def accumulate(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> None:
    """Add every slot's values to its parent's slot, deepest level first (parent -1: none)."""
    order = np.argsort(-depth, kind="stable")
    borders = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, borders):
        level = level[parent[level] >= 0]
        for v in values:
            np.add.at(v, parent[level], v[level])


def _shard(segment: int):
    """A shard: its nodes and the sums that hang from them, to finished nodes."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        col = {f: table.column(f).to_numpy() for f in ("owner", "block", "depth", "n", "children", "leaves", "saved", "parent_owner")}
        d1, d2, p1, p2 = (np.ascontiguousarray(table.column(f).to_numpy()).view(np.uint64) for f in ("d1", "d2", "p1", "p2"))
        node = table.column("is_node").to_numpy()
        own = np.flatnonzero(node)
        slots = SlotTable(d1[own], d2[own])
        at = slots.slots(d1, d2)
        if (at < 0).any():
            raise ValueError("a sum hangs from a node of another shard")
        flat = {}
        for f in ("children", "leaves", "saved"):
            flat[f] = np.zeros(len(own), np.int64)
            np.add.at(flat[f], at, col[f])
        put = {f: np.zeros(len(own), np.int64) for f in ("owner", "depth", "n", "parent_owner")}
        for f, v in put.items():
            v[at[own]] = col[f][own]
        # the parent is here if it belongs to the same segment
        inside = own[(col["depth"][own] > 0) & (col["parent_owner"][own] == col["owner"][own]) & ((col["depth"][own] - 1) // segment == col["block"][own])]
        parent = np.full(len(own), -1)
        parent[at[inside]] = slots.slots(p1[inside], p2[inside])
        if (parent[at[inside]] < 0).any():
            raise ValueError("a parent is missing in its shard")
        np.add.at(flat["children"], parent[parent >= 0], 1)
        accumulate(parent, put["depth"], flat["leaves"], flat["saved"])
        up = pa.array(put["parent_owner"], mask=put["depth"] == 0)
        arrays = [pa.array(put["owner"]), pa.array(put["depth"]), up, pa.array(put["n"]), *(pa.array(flat[f]) for f in ("children", "leaves", "saved")),
                  pa.array(slots.a.view(np.int64)), pa.array(slots.b.view(np.int64))]
        for batch in pa.Table.from_arrays(arrays, [c.split()[0] for c in NODE.split(", ")]).to_batches(max_chunksize=1 << 16):
            yield batch

    return run


# -- members that end at a node

def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cut = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(d1)]):
        yield (int(d1[a]), int(d2[a])), a, b


def _chunks(batches):
    """Rows (d1, d2, conv) in order: ids of a node joined with commas, at most CHUNK and of one batch in a string."""
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, rows = batch.column(2).to_pylist(), []
        for (x, y), a, b in _groups(batch):
            rows += [(x, y, conv[s], ",".join(map(str, conv[s: min(b, s + CHUNK)]))) for s in range(a, b, CHUNK)]
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["d1", "d2", "first", "ids"])


def _digests(batches):
    """Strings of a node in order, hashed as they come: memory does not grow with a node."""
    key, sha = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        out, ids = [], batch.column(3).to_pylist()
        for k, a, b in _groups(batch):
            if k != key:
                if sha:
                    out.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids[a].encode())
                a += 1
            for s in ids[a:b]:
                sha.update(b"," + s.encode())
        if out:
            yield _digest_batch(out)
    if sha:
        yield _digest_batch([(*key, sha.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["d1", "d2", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    parts = ends.repartitionByRange("d1", "d2", "conv").sortWithinPartitions("d1", "d2", "conv").mapInArrow(_chunks, "d1 long, d2 long, first long, ids string")
    return parts.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(_digests, "d1 long, d2 long, ends_sha256 string")


# -- the trie

def _node_rows(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per member and node: conv, depth, digest, parent's digest, bytes, and whether the member ends there."""
    lanes = rows.select("conv", "depth", "bytes", F.xxhash64(F.lit(3), "depth", "k1", "k2").alias("l1"), F.xxhash64(F.lit(4), "depth", "k1", "k2").alias("l2"))
    inner = scan(lanes, "conv", ["depth"], "pos", {"l1": "d1", "l2": "d2"}).join(convs, "conv")
    inner = inner.select("conv", "depth", "d1", "d2", F.col("d1").bitwiseXOR(F.col("l1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("l2")).alias("p2"), "bytes", (F.col("depth") == F.col("size")).alias("ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), none.alias("p1"), none.alias("p2"), zero.alias("bytes"), (F.col("size") == 0).alias("ends"))
    return inner.unionByName(root)


def _nodes(members: DataFrame, segment: int) -> DataFrame:
    same = [F.min(c).eqNullSafe(F.max(c)) for c in ("depth", "p1", "p2", "bytes")]
    one = F.when(same[0] & same[1] & same[2] & same[3], F.count(F.lit(1))).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    nodes = members.groupBy("d1", "d2").agg(one.alias("n"), F.min("conv").alias("owner"), F.sum(F.col("ends").cast("long")).alias("ended"), F.min("depth").alias("depth"),
                                           F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes")).checkpoint(eager=True)
    up = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("owner").alias("parent_owner"))
    nodes = nodes.join(up, ["p1", "p2"], "left")
    return nodes.select("owner", F.expr(f"depth div {segment}").alias("block"), "d1", "d2", "p1", "p2", "depth", "n", F.lit(0).cast("long").alias("children"),
                        (F.col("ended") == F.col("n")).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"), "parent_owner").checkpoint(eager=True)


def _hanging(nodes: DataFrame, segment: int) -> DataFrame:
    """Sums of whole subtrees of segments, by the node of another segment that they hang from."""
    top = F.min_by(F.struct(F.col("parent_owner").alias("po"), F.expr(f"(depth - 1) div {segment}").alias("pb"), F.col("p1").alias("a1"), F.col("p2").alias("a2")), "depth")
    segs = nodes.groupBy("owner", "block").agg(top.alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    segs = segs.select("owner", "block", "leaves", "saved", "up.po", F.when(F.col("up.po").isNotNull(), F.col("up.pb")).alias("pb"), "up.a1", "up.a2", F.col("up.po").alias("ao"), F.col("up.pb").alias("ab"))
    segs = segs.checkpoint(eager=True)
    while segs.filter("po is not null").take(1):
        add = segs.filter("po is not null").groupBy(F.col("po").alias("owner"), F.col("pb").alias("block")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = segs.filter("po is not null").select(F.col("owner").alias("po"), F.col("block").alias("pb"), F.col("po").alias("to"), F.col("pb").alias("tb"))
        segs = (segs.join(add, ["owner", "block"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
                .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaves", "more_saved")
                .join(jump, ["po", "pb"], "left").withColumn("po", F.col("to")).withColumn("pb", F.col("tb")).drop("to", "tb").checkpoint(eager=True))
    return (segs.filter("ao is not null").groupBy(F.col("ao").alias("owner"), F.col("ab").alias("block"), F.col("a1").alias("d1"), F.col("a2").alias("d2"))
            .agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))


def trie(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Every node of the prefix trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and its digest (d1, d2).

    ``rows``: conv, depth (from 1 without gaps), k1, k2, bytes; ``convs``: conv and size, one row per conversation.
    """
    spark = rows.sparkSession
    prepare(spark)
    members = _node_rows(rows, convs).checkpoint(eager=True)
    nodes = _nodes(members, segment)
    sums = _hanging(nodes, segment)
    zero = F.lit(0).cast("long")
    both = nodes.withColumn("is_node", F.lit(True)).unionByName(sums.select("*", *(zero.alias(c) for c in ("p1", "p2", "depth", "n", "parent_owner")), F.lit(False).alias("is_node")))
    both = both.fillna(0, ["p1", "p2", "parent_owner"])
    shards = max(spark.sparkContext.defaultParallelism, -(-nodes.count() // SHARD_NODES))
    done = both.repartition(shards, "owner", "block").mapInArrow(_shard(segment), NODE)
    out = done.join(_ends(members.filter("ends").select("d1", "d2", "conv")), ["d1", "d2"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def report(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The trie of the rebuilt conversations, without digests."""
    prepare(conversations.sparkSession)
    return trie(*rebuilt(numbered_turns(conversations)), segment).drop("d1", "d2")
