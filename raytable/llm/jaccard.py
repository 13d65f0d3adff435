"""N-gram Jaccard join with set-relation skipping: components of documents whose shingle sets are similar.

Equal sets form one class first, so copies never meet each other. Distinct sets are joined exactly at a similarity of
``PER_CENT``:

1. Index lists. Tokens (64-bit names of shingles) have one global order, rare ones first. Their counts come from one exchange
   of 40-bit fingerprints by hash range; each range leaves fixed-size bitmaps of tokens seen 2, 8 and 64 times. Bitmaps may take
   a rare token for a common one, never the reverse: an unshared token needs no list, and any order is right. A set enters
   the lists of its shared prefix tokens with position and size. Entries form blocks by size; an entry's position bounds the
   size of a partner, and blocks without a possible partner are skipped as a whole.
2. Answers from a hub. Every other set x of a run of blocks is compared with one hub h of the run (the set with most
   copies), which leaves its difference from h. The overlap of two sets follows from their differences from any third set, so only
   differences are looked at, and they are made short: what most sets of the run change against the hub is changed in the
   hub, which gives the centre of the run. Sets near enough to the centre are linked by the length of their differences alone,
   and two sets that are both linked with the hub are in one component already. For the others a prefix join over the
   differences, rare ones within the run first, finds every pair that can still be linked; it is decided exactly.
3. Components of the links, then the smallest document id.

Every pair of similar sets shares the list of its first common token, lies in one run there and is therefore decided or
joined through the hub: no link between components is lost and no group is expanded into pairs.

Defined cases: null, empty and word-less texts have no shingles and link with nothing; a text shorter than a shingle is one
shingle; repeated rows are copies; a null doc_id takes part, and a component of null ids only has a null component_id; an
empty table gives no rows; other columns take no part. Names are 64-bit hashes: two shingles of one comparison share a name
with a probability below 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raytable.operators.graph import components

from .common import Numbering, id_text, mix64, prepare, release_memory, text_chunks, utf8

SHINGLE = 3
PER_CENT = 90
FILTER_BITS = 1 << 25  # of the filter that spares texts without a candidate in the last pass; a full one spares none
SALT = 1024  # sets that meet one copy of a hub
_REMOVED = np.uint64(0x5BD1E9955BD1E995)  # marks tokens of the hub that a set lacks
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

LEVELS = (2, 8, 64)  # counts that the order of tokens tells apart
LEVEL_BITS = 1 << 26  # of each level's bitmap over all ranges; a full one only makes the order coarser
COUNTS = "span long, names binary"
BITMAPS = "span long, " + ", ".join(f"level{k} binary" for k in range(len(LEVELS)))
ROWS = "doc_id long, n int, cls binary, entries array<struct<pos:int,token:long>>"
SETS = "cls binary, tokens binary"


class Shared:
    """How common a token is, by range of its top bits: bitmaps with two bits a token."""

    def __init__(self, range_bits: int, rows):
        self.shift, self.bits = np.uint64(64 - range_bits), LEVEL_BITS >> range_bits
        self.maps = [np.zeros((1 << range_bits, self.bits // 8), np.uint8) for _ in LEVELS]
        for r in rows:
            for k, m in enumerate(self.maps):
                m[r["span"]] = np.frombuffer(r[f"level{k}"], np.uint8)
        self.maps = [m.ravel() for m in self.maps]

    def level(self, tokens: np.ndarray) -> np.ndarray:
        """0 for a token of one set; higher, the more common."""
        base = (tokens >> self.shift) * np.uint64(self.bits)
        level = np.zeros(len(tokens), np.int8)
        at = [(base + p).astype(np.int64) for p in _places(tokens & _LOW, self.bits)]
        for m in self.maps:
            level += np.logical_and.reduce([(m[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in at]).astype(np.int8)
        return level


_LOW = np.uint64((1 << 40) - 1)


def _places(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return names % np.uint64(bits), mix64(names + np.uint64(1)) % np.uint64(bits)


def _counts_pass(size: int, range_bits: int):
    """Names of the distinct tokens of a batch by range, as often as distinct sets have them (64 times at most)."""

    def run(batches):
        release_memory()
        for batch in batches:
            distinct = {_class_of(tokens): tokens for _, tokens in token_sets(utf8(batch.column(1)), size) if len(tokens)}
            tokens, count = np.unique(np.concatenate(list(distinct.values())), return_counts=True) if distinct else (np.zeros(0, np.uint64), np.zeros(0, int))
            tokens = np.repeat(tokens, np.minimum(count, LEVELS[-1]))
            names = np.ascontiguousarray(tokens, "<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            span, first = np.unique(tokens >> np.uint64(64 - range_bits), return_index=True)
            cuts = [*first.tolist(), len(tokens)]
            yield pa.RecordBatch.from_arrays([pa.array(span.astype(np.int64)), pa.array([names[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["span", "names"])

    return run


def _bitmap_pass(range_bits: int):
    """Bitmaps of each range, from rows sorted by range."""
    bits = LEVEL_BITS >> range_bits

    def close(span: int, parts: list[bytes]) -> list:
        raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        names, count = np.unique(wide.view("<u8").ravel(), return_counts=True)
        row = [span]
        for least in LEVELS:
            flags = np.zeros(bits, np.uint8)
            for p in _places(names[count >= least], bits):
                flags[p.astype(np.int64)] = 1
            row.append(np.packbits(flags, bitorder="little").tobytes())
        return row

    def run(batches):
        span, parts = None, []
        for batch in batches:
            rows = []
            for s, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != span and parts:
                    rows.append(close(span, parts))
                    parts = []
                span = s
                parts.append(names)
            if rows:
                yield _bitmap_batch(rows)
        if parts:
            yield _bitmap_batch([close(span, parts)])

    return run


def _bitmap_batch(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], [c.split()[0] for c in BITMAPS.split(", ")])


def token_sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, distinct tokens in ascending order) of every text."""
    none = np.zeros(0, np.uint64)
    for a, b in text_chunks(texts):
        number = Numbering()
        rows = [t.translate(_UPPER).split() for t in texts[a:b]]
        flat = np.fromiter((number[w] for r in rows for w in r), np.int64)
        names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        word = names[flat]
        shingle = word[: max(0, len(word) - size + 1)].copy()
        for k in range(1, size):
            shingle = mix64(shingle + np.uint64(k)) + word[k: k + len(shingle)]
        shingle = mix64(shingle)
        at = 0
        for i, r in enumerate(rows, a):
            if not r:
                yield i, none
            elif len(r) < size:
                yield i, np.array([xxhash.xxh3_64_intdigest(b"\0".join(r), seed=len(r))], np.uint64)
            else:
                yield i, np.unique(shingle[at: at + len(r) - size + 1])
            at += len(r)


def _class_of(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _rows_pass(size: int, per_cent: int, table):
    """A row per document; the first of a class in a batch carries the index entries of its shared prefix tokens."""

    def run(batches):
        release_memory()
        shared = table.value
        for batch in batches:
            texts = utf8(batch.column(1))
            n, cls, found = np.zeros(len(texts), np.int32), [None] * len(texts), set()
            held, borders, none = [(np.zeros(0, np.int32), np.zeros(0, np.int64))], np.zeros(len(texts) + 1, np.int32), np.ones(len(texts), bool)
            for i, tokens in token_sets(texts, size):
                n[i], cls[i] = len(tokens), _class_of(tokens)
                if cls[i] is None or cls[i] in found:
                    continue
                found.add(cls[i])
                level = shared.level(tokens)
                order = np.lexsort((tokens, level))[: n[i] + (-int(n[i]) * per_cent) // 100 + 1]
                pos = np.flatnonzero(level[order])
                held.append((pos.astype(np.int32), _signed(tokens[order[pos]])))
                borders[i + 1], none[i] = len(pos), False
            entries = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["pos", "token"])
            entries = pa.ListArray.from_arrays(pa.array(np.cumsum(borders, dtype=np.int32)), entries, mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cls, pa.binary()), entries], ["doc_id", "n", "cls", "entries"])

    return run


def _sets_pass(size: int, wanted):
    def run(batches):
        release_memory()
        bits = wanted.value
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for _, tokens in token_sets(utf8(batch.column(1)), size):
                if len(tokens):
                    cls = _class_of(tokens)
                    bit = int.from_bytes(cls[:8], "little") % FILTER_BITS
                    if bits[bit >> 3] >> (bit & 7) & 1:
                        found[cls] = tokens.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["cls", "tokens"])

    return run


def _bit(cls: pa.Array) -> pa.Array:
    return pa.array(np.array([int.from_bytes(c[:8], "little") % FILTER_BITS for c in cls.to_pylist()], np.int64))


def _class_filter(classes: DataFrame) -> np.ndarray:
    """Bitmap over class names, FILTER_BITS long whatever the number of classes."""
    bit = classes.select(F.arrow_udf(_bit, "long")("cls").alias("bit"))
    rows = bit.groupBy(F.floor(F.col("bit") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return words.view(np.uint8)


def _shared_tokens(slim: DataFrame, size: int) -> Shared:
    """Bitmaps of common tokens. The number of ranges follows the number of input partitions, so a range stays small; what
    comes to the driver has a fixed size."""
    range_bits = min(20, max(6, slim.rdd.getNumPartitions().bit_length() + 6))
    spans = slim.mapInArrow(_counts_pass(size, range_bits), COUNTS).repartition("span").sortWithinPartitions("span")
    return Shared(range_bits, spans.mapInArrow(_bitmap_pass(range_bits), BITMAPS).collect())


def _difference(batches):
    """Rows sorted by (hub, salt) with the hub first: for each other set its overlap with the hub and, where the run has a
    third set, the tokens of one but not of both."""
    release_memory()
    hub, h = None, np.zeros(0, np.uint64)
    for batch in batches:
        col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
        rows, own, delta = [], [], []
        for k, (g, x, crowd, tokens) in enumerate(zip(*(col[c].to_pylist() for c in ("hub", "id", "crowd", "tokens")), strict=True)):
            tokens = np.frombuffer(tokens, np.uint64)
            if g == x:
                hub, h = g, tokens
                continue
            if g != hub:
                raise ValueError("a set came before its hub")
            added = np.setdiff1d(tokens, h, assume_unique=True)
            rows.append(k)
            own.append(len(tokens) - len(added))
            delta.append(_signed(np.concatenate([added, np.setdiff1d(h, tokens, assume_unique=True) ^ _REMOVED])) if crowd > 2 else None)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([col["hub"].take(at), col["id"].take(at), col["n"].take(at), pa.array(own, pa.int32()), col["n_hub"].take(at),
                                          pa.array(delta, pa.list_(pa.int64()))], ["hub", "id", "n", "own", "n_hub", "delta"])


def _ceil_div(x: Column, by: int) -> Column:
    return F.ceil(x / F.lit(by)).cast("long")


def _runs(postings: DataFrame, per_cent: int) -> DataFrame:
    """(hub, n_hub, id, n, crowd): every set of a run of possible partners with the hub of the run; crowd is the largest run of both."""
    whole, part = 100 + per_cent, per_cent
    # the largest partner that an entry's position allows; the first common token of a pair obeys it on both sides
    p = postings.withColumn("most", F.floor((whole * (F.col("n") - F.col("pos")) - part * F.col("n")) / F.lit(part)).cast("int"))
    p = p.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / per_cent))).cast("int"))
    block = p.groupBy("token", "band").agg(F.count(F.lit(1)).alias("c"), F.max("most").alias("most"), F.min("n").alias("least"),
                                          F.min(F.struct((-F.col("copies")).alias("k"), "id", "n", "most")).alias("top"))
    by = Window.partitionBy("token").orderBy("band")  # bands per token: the logarithm of the largest size
    # partners lie in neighbouring bands (or two apart, by rounding at a border)
    near = F.coalesce(F.col("band") - F.lag("band").over(by) <= 2, F.lit(False)) & (F.col("least") <= F.max("most").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    block = block.withColumn("run", F.sum(F.when(near, 0).otherwise(1)).over(by))
    run = Window.partitionBy("token", "run")
    block = (block.withColumn("total", F.sum("c").over(run)).withColumn("hub", F.min("top").over(run)).withColumn("low", F.min("least").over(run))
             .filter((F.col("total") > 1) & (F.col("most") >= F.col("low"))))
    pairs = p.join(block.select("token", "band", "hub", "low", "total"), ["token", "band"]).filter((F.col("most") >= F.col("low")) & (F.col("hub.id") != F.col("id")))
    # in a run of two the positions of both must allow the pair itself
    pairs = pairs.filter((F.col("total") > 2) | ((F.col("most") >= F.col("hub.n")) & (F.col("hub.most") >= F.col("n"))))
    return pairs.groupBy(F.col("hub.id").alias("hub"), F.col("hub.n").alias("n_hub"), "id", "n").agg(F.max("total").alias("crowd"))


def _with_hubs(docs: DataFrame, classes: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """Every set of a run compared with its hub. A hub with many sets is copied to one key per SALT of them."""
    spark = docs.sparkSession
    salts = runs.groupBy("hub", "n_hub").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    member = runs.join(salts.drop("n_hub"), "hub").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("salts")
    head = salts.select("hub", "n_hub", F.col("hub").alias("id"), F.col("n_hub").alias("n"), F.lit(0).cast("long").alias("crowd"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    place = member.unionByName(head).join(classes.select("id", "cls"), "id").checkpoint(eager=True)
    wanted = spark.sparkContext.broadcast(_class_filter(place.select("cls").distinct()))
    sets = id_text(docs).mapInArrow(_sets_pass(size, wanted), SETS).groupBy("cls").agg(F.first("tokens").alias("tokens"))
    rows = sets.join(place, "cls").drop("cls").repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"))
    return rows.mapInArrow(_difference, "hub long, id long, n int, own int, n_hub int, delta array<long>")


def _links(docs: DataFrame, classes: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Links between classes (u, v) that span every component."""
    entry = classes.select("id", F.explode("entries").alias("e")).select("id", "e.pos", "e.token")
    shared = entry.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    postings = entry.join(shared, "token").join(classes.select("id", "n", "copies"), "id").checkpoint(eager=True)
    runs = _runs(postings, per_cent).checkpoint(eager=True)
    diff = _with_hubs(docs, classes, runs, size).checkpoint(eager=True)
    whole = 100 + per_cent
    diff = diff.withColumn("open", whole * F.col("own") < per_cent * (F.col("n") + F.col("n_hub")))  # not linked with the hub
    direct = diff.filter(~F.col("open")).select(F.col("hub").alias("u"), F.col("id").alias("v"))
    return direct.unionByName(_between(diff, whole, 100 - per_cent))


def _centred(diff: DataFrame, whole: int, apart: int) -> DataFrame:
    """Sets of runs with a set that is not linked with the hub, as differences from the centre of the run, with slack ``s``.

    Two sets are linked if whole * |x xor y| <= apart * (|x| + |y|), that is if 2 * whole * common >= s_x + s_y, where common
    is the common part of their differences from any third set and s = whole * |difference| - apart * |set|. The third set
    is the centre: the hub with every token changed that more than half of the run's sets change. A hub that is
    far from its run would put its own oddities into every difference.
    """
    diff = diff.filter("delta is not null")
    groups = diff.groupBy("hub", "n_hub").agg(F.count(F.lit(1)).alias("m"), F.max("open").alias("any")).filter("m > 1 and any").drop("any")
    head = groups.select("hub", F.col("hub").alias("id"), F.col("n_hub").alias("n"), F.lit(False).alias("open"), F.array().cast("array<bigint>").alias("delta"), "m")
    member = diff.join(groups.drop("n_hub"), "hub").select("hub", "id", "n", "open", "delta", "m").unionByName(head)
    changed = member.select("hub", "m", F.explode("delta").alias("token")).groupBy("hub", "token").agg(F.count(F.lit(1)).alias("c"), F.first("m").alias("m"))
    centre = changed.filter("2 * c > m + 1").groupBy("hub").agg(F.collect_list("token").alias("own"))  # no longer than two differences on average
    own = F.coalesce("own", F.array().cast("array<bigint>"))
    member = member.join(centre, "hub", "left").withColumn("delta", F.concat(F.array_except("delta", own), F.array_except(own, "delta"))).drop("own", "m")
    return member.withColumn("s", (whole * F.size("delta") - apart * F.col("n")).cast("long")).checkpoint(eager=True)


def _between(diff: DataFrame, whole: int, apart: int) -> DataFrame:
    """Links between two sets of a run of which at least one is not linked with the hub.

    The set b nearest to the centre is linked with every set whose slack allows it without a common difference; these, and
    those that are linked with the hub if b is, are of one component: no pair of them is looked at.
    """
    member = _centred(diff, whole, apart)
    best = member.groupBy("hub").agg(F.min(F.struct("s", "id", "open")).alias("b"), F.max(F.when(F.col("id") == F.col("hub"), F.col("s"))).alias("s_hub"))
    best = best.withColumn("near_hub", ~F.col("b.open") | (F.col("s_hub") + F.col("b.s") <= 0)).select("hub", F.col("b.id").alias("b"), F.col("b.s").alias("s_b"), "near_hub")
    member = member.join(best, "hub")
    certain = F.col("s") + F.col("s_b") <= 0
    links = member.filter(certain & (F.col("id") != F.col("b"))).select(F.col("b").alias("u"), F.col("id").alias("v"))
    main = certain | (F.col("id") == F.col("b")) | (F.col("near_hub") & ~F.col("open"))
    member = member.withColumn("open", ~main).drop("b", "near_hub")
    least = member.filter("open").groupBy("hub").agg(F.min("s").alias("s_open"))  # runs without an open set are done
    member = member.join(least, "hub").withColumn("size", F.size("delta")).checkpoint(eager=True)
    token = member.select("hub", "id", "n", "s", "s_b", "s_open", "open", "size", F.explode("delta").alias("token"))
    # tokens that the same sets have (one change of a text makes several) lie side by side in the order; the first of them stands for all
    count = token.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("of")).filter("c > 1").checkpoint(eager=True)
    alike = count.groupBy("hub", "c", "of").agg(F.min("token").alias("token")).withColumn("stands", F.lit(True))
    token = token.join(count.join(alike, ["hub", "c", "of", "token"], "left"), ["hub", "token"])
    mine = Window.partitionBy("hub", "id")
    token = token.withColumn("k", F.row_number().over(mine.orderBy("c", "of", "token")) + F.col("size") - F.count(F.lit(1)).over(mine)).filter("stands")
    # common part needed at least: against any open partner, for an open set against any partner at all, and with any set at all,
    # as linked sets x and y of a similarity t differ in less than |x| (1 - t) / t tokens
    far = F.col("size") - F.floor(F.col("n") * apart / (whole - apart) * 2).cast("long")
    token = token.withColumn("any_open", F.greatest(F.lit(1), far, _ceil_div(F.col("s") + F.col("s_open"), 2 * whole)))
    token = token.withColumn("any_set", F.greatest(F.lit(1), far, _ceil_div(F.col("s") + F.col("s_b"), 2 * whole)))
    token = token.withColumn("left", F.col("size") - F.col("k") + 1)  # of the set's difference, from this token on
    token = token.filter((F.col("left") >= F.col("any_open")) | (F.col("open") & (F.col("left") >= F.col("any_set")))).checkpoint(eager=True)
    index = token.filter(F.col("left") >= F.col("any_open")).select("hub", "token", F.col("id").alias("v"), F.col("open").alias("v_open"), F.col("left").alias("v_left"), F.col("s").alias("v_s"))
    probe = token.filter("open").filter(F.col("left") >= F.col("any_set")).select("hub", "token", F.col("id").alias("u"), F.col("left").alias("u_left"), F.col("s").alias("u_s"))
    # the first common token of linked sets leaves room for all the others
    room = 2 * whole * F.least("u_left", "v_left") >= F.col("u_s") + F.col("v_s")
    pairs = probe.join(index, ["hub", "token"]).filter((F.col("u") != F.col("v")) & (~F.col("v_open") | (F.col("u") < F.col("v"))) & room).select("hub", "u", "v").distinct()
    left = member.select("hub", F.col("id").alias("u"), F.col("s").alias("s_u"), F.col("delta").alias("d_u"))
    right = member.select("hub", F.col("id").alias("v"), F.col("s").alias("s_v"), F.col("delta").alias("d_v"))
    both = pairs.join(left, ["hub", "u"]).join(right, ["hub", "v"])
    return links.unionByName(both.filter(2 * whole * F.size(F.array_intersect("d_u", "d_v")) >= F.col("s_u") + F.col("s_v")).select("u", "v"))


def join_components(docs: DataFrame, size: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the component) for every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    slim = id_text(docs)
    table = spark.sparkContext.broadcast(_shared_tokens(slim, size))
    rows = slim.mapInArrow(_rows_pass(size, per_cent, table), ROWS).checkpoint(eager=True)
    classes = (rows.filter("cls is not null").groupBy("cls")
               .agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("entries", ignorenulls=True).alias("entries"), F.min("doc_id").alias("rep"))
               .withColumn("id", F.monotonically_increasing_id()).checkpoint(eager=True))
    links = _links(docs, classes, size, per_cent).checkpoint(eager=True)
    rep = classes.select("cls", "rep")
    if links.take(1):
        root = components(links).select(F.col("node").alias("id"), "component").join(classes.select("id", "cls"), "id").drop("id")
        named = root.join(rep, "cls").groupBy("component").agg(F.min("rep").alias("low"))
        rep = rep.join(root.join(named, "component").select("cls", "low"), "cls", "left").select("cls", F.coalesce("low", "rep").alias("rep"))
    out = rows.select("doc_id", "n", "cls").join(rep, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("rep")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """One document of each component, the one with the smallest id; columns as they were. Rows with a null id or no words stay."""
    marks = join_components(docs, size, per_cent).filter("doc_id is not null and n_shingles > 0")
    ids = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("_rows"), F.min("component_id").alias("_first")).checkpoint(eager=True)
    gone = ids.filter("_first <> __id").select("__id")
    again = ids.filter("_first = __id and _rows > 1").select("__id")
    own = docs.withColumn("__id", F.col("doc_id").cast("long"))
    single = own.join(gone.unionByName(again), "__id", "left_anti")
    repeated = own.join(again, "__id", "left_semi").dropDuplicates(["__id"])
    return single.unionByName(repeated).drop("__id")
