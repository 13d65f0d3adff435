"""Rasters as pixel and tile tables: mapping, resampling, compositing, pyramids, matching and profile scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raytable.runtime import materialize, stored

from .grids import CORNERS, CROSS, stencil
from .ordered import running_sum
from .quantiles import pctl
from .selection import best_two


def tile_ranges(sizes: DataFrame, by: list[str], th: int, tw: int) -> DataFrame:
    """1-based closed row/column ranges of every tile, ragged at the end (sizes: by…, height, width)."""
    t = sizes.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / th).cast("int"))))
    t = t.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / tw).cast("int"))))
    return t.select(*by, "tile_row", "tile_col", (F.col("tile_row") * th + 1).alias("row_first"), F.least(F.col("height"), (F.col("tile_row") + 1) * th).alias("row_last"),
                    (F.col("tile_col") * tw + 1).alias("col_first"), F.least(F.col("width"), (F.col("tile_col") + 1) * tw).alias("col_last"))


def tiles_from_pixels(pixels: DataFrame, size: int) -> DataFrame:
    """Pack pixels into square tiles: bounded arrays of values and validity ordered by position."""
    p = pixels.withColumn("tile_row", F.floor(F.col("r") / size).cast("int")).withColumn("tile_col", F.floor(F.col("c") / size).cast("int"))
    e = F.array_sort(F.collect_list(F.struct((F.col("r") % size).alias("i"), (F.col("c") % size).alias("j"), "v", "valid")))
    return p.groupBy("layer", "tile_row", "tile_col").agg(e.alias("cells"))


def pixels_from_tiles(tiles: DataFrame, size: int) -> DataFrame:
    return tiles.select("layer", "tile_row", "tile_col", F.inline("cells")).select(
        "layer", (F.col("tile_row") * size + F.col("i")).alias("r"), (F.col("tile_col") * size + F.col("j")).alias("c"), "v", "valid")


def tiles_for_mapping(mapping: DataFrame, size: int, halo: int = 1) -> DataFrame:
    """Distinct tile keys a mapping touches (with halo), used to prune the tile scan by a semi-join."""
    lo = lambda c: F.floor((F.col(c) - halo) / size).cast("int")
    hi = lambda c: F.floor((F.col(c) + halo) / size).cast("int")
    m = mapping.filter("src_r is not null and src_c is not null").select("layer", lo("src_r").alias("a"), hi("src_r").alias("b"), lo("src_c").alias("d"), hi("src_c").alias("e")).distinct()
    m = m.withColumn("tile_row", F.explode(F.sequence("a", "b"))).withColumn("tile_col", F.explode(F.sequence("d", "e")))
    return m.select("layer", "tile_row", "tile_col").distinct()


def read_region(tiles: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    return pixels_from_tiles(tiles.join(needed, ["layer", "tile_row", "tile_col"], "left_semi"), size)


# --- mapping and resampling --------------------------------------------------------------------------

def inverse_map(mesh: DataFrame, by: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Output cell -> continuous source position through mesh quads split in two triangles.

    mesh: by…, r, c (source position) and px, py (output position). Each triangle lists the output cells of its own
    bounding box; a cell on a shared edge keeps the triangle with the smallest id.
    """
    q = stencil(mesh.withColumn("sr", F.col("r").cast("double")).withColumn("sc", F.col("c").cast("double")), by, CORNERS, ["px", "py", "sr", "sc"])
    q = q.filter("n00 is not null and n01 is not null and n10 is not null and n11 is not null")
    tri = F.array(F.struct(F.lit(0).alias("t"), F.col("n00").alias("a"), F.col("n01").alias("b"), F.col("n10").alias("d")),
                  F.struct(F.lit(1).alias("t"), F.col("n11").alias("a"), F.col("n10").alias("b"), F.col("n01").alias("d")))
    t = q.select(*by, "r", "c", F.inline(tri))
    t = _cells(t)
    ax, ay = F.col("a.px"), F.col("a.py")
    e1x, e1y, e2x, e2y = F.col("b.px") - ax, F.col("b.py") - ay, F.col("d.px") - ax, F.col("d.py") - ay
    t = t.withColumn("_det", e1x * e2y - e1y * e2x).filter(F.abs("_det") > 1e-15)
    dx, dy = F.col("out_c") - ax, F.col("out_r") - ay
    t = t.withColumn("_l1", (dx * e2y - dy * e2x) / F.col("_det")).withColumn("_l2", (e1x * dy - e1y * dx) / F.col("_det"))
    t = t.filter((F.col("_l1") >= -tolerance) & (F.col("_l2") >= -tolerance) & (F.col("_l1") + F.col("_l2") <= 1 + tolerance))
    src = lambda n: F.col(f"a.{n}") + F.col("_l1") * (F.col(f"b.{n}") - F.col(f"a.{n}")) + F.col("_l2") * (F.col(f"d.{n}") - F.col(f"a.{n}"))
    t = t.select(*by, "out_r", "out_c", F.struct(F.col("r"), F.col("c"), F.col("t"), src("sr").alias("sr"), src("sc").alias("sc")).alias("_m"))
    return t.groupBy(*by, "out_r", "out_c").agg(F.min("_m").alias("_m")).select(*by, "out_r", "out_c", F.col("_m.sr").alias("src_r"), F.col("_m.sc").alias("src_c"))


def _cells(t: DataFrame) -> DataFrame:
    """Integer output cells inside each triangle's bounding box."""
    for axis, name in (("px", "out_c"), ("py", "out_r")):
        v = [F.col(f"{n}.{axis}") for n in "abd"]
        lo, hi = F.ceil(F.least(*v)).cast("bigint"), F.floor(F.greatest(*v)).cast("bigint")
        t = t.withColumn(name, F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    return t


def resample(mapping: DataFrame, pixels: DataFrame, by: list[str], method: str = "bilinear", fill: float = 0.0) -> DataFrame:
    """Source values at mapped positions; a cell is valid only if every contributing pixel is."""
    px = pixels.withColumn("v", F.when(F.col("valid"), F.col("v")))
    if method == "nearest":
        m = mapping.withColumn("r", F.floor(F.col("src_r") + 0.5).cast("bigint")).withColumn("c", F.floor(F.col("src_c") + 0.5).cast("bigint"))
        out = m.join(px.select(*by, F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "v"), by + ["r", "c"], "left").drop("r", "c")
    elif method == "bilinear":
        cells = stencil(px, by, CORNERS, ["v"]).filter("n00 is not null").withColumnRenamed("r", "_r").withColumnRenamed("c", "_c")
        m = mapping.withColumn("_r", F.floor("src_r").cast("bigint")).withColumn("_c", F.floor("src_c").cast("bigint"))
        m = m.withColumn("_fr", F.col("src_r") - F.col("_r")).withColumn("_fc", F.col("src_c") - F.col("_c"))
        out = m.join(cells, by + ["_r", "_c"], "left")
        # a zero fraction does not need the far corner (it may lie outside the image)
        g = lambda n, w: F.when(w == 0, 0.0).otherwise(w * F.col(f"{n}.v"))
        fr, fc = F.col("_fr"), F.col("_fc")
        out = out.withColumn("v", g("n00", (1 - fr) * (1 - fc)) + g("n01", (1 - fr) * fc) + g("n10", fr * (1 - fc)) + g("n11", fr * fc)).drop("_r", "_c", "_fr", "_fc", *CORNERS)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn("valid", F.col("v").isNotNull()).withColumn("v", F.coalesce("v", F.lit(float(fill))))


def all_bands_valid(df: DataFrame, cell: list[str], fill: float = 0.0) -> DataFrame:
    """Mask of a cell over its bands: valid only if all bands are."""
    m = df.groupBy(*cell).agg(F.bool_and("valid").alias("_all"))
    return df.join(m, cell).withColumn("valid", F.col("_all")).withColumn("v", F.when(F.col("_all"), F.col("v")).otherwise(float(fill))).drop("_all")


def composite(layers: DataFrame, cell: list[str], order: str = "layer", alpha: str = "alpha", background: float = 0.0) -> DataFrame:
    """Ordered alpha compositing c(1-a)+v a over valid layers; the mask is the union."""
    e = F.array_sort(F.collect_list(F.when(F.col("valid"), F.struct(F.col(order).alias("o"), F.col("v").alias("v"), F.col(alpha).alias("a")))))
    g = layers.groupBy(*cell).agg(e.alias("_s"))
    folded = F.aggregate("_s", F.lit(float(background)), lambda acc, s: acc * (1 - s["a"]) + s["v"] * s["a"])
    return g.select(*cell, folded.alias("v"), (F.size("_s") > 0).alias("valid"))


def composite_anaglyph(layers: DataFrame, cell: list[str], order: str = "layer") -> DataFrame:
    """Alternate layers go to channel 1 and channel 3, combined by maximum."""
    side = lambda k: F.coalesce(F.max(F.when(F.col("valid") & (F.col(order) % 2 == k), F.col("v"))), F.lit(0.0))
    return layers.groupBy(*cell).agg(side(0).alias("channel_1"), F.lit(0.0).alias("channel_2"), side(1).alias("channel_3"), F.bool_or("valid").alias("valid"))


def pyramid(pixels: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """Every level by block averages of the source (box filter) until both sides fit one tile.

    Sums and counts of a level come from the level below, so a level costs a quarter of it. Pixels of a block stay together, so
    sums combine before the next shuffle. Pixels beyond the stated size go to the last cell.
    """
    need = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("height", "width") / tile))).cast("int")
    sizes = stored(sizes.select("layer", "height", "width", need.alias("_need")))
    at = lambda c, f: F.floor(F.col(c) / f).cast("bigint")
    sums = lambda s, n: (F.sum(s).alias("s"), n.alias("n"), F.bool_or("valid").alias("valid"))
    base = pixels.select("layer", at("r", 1).alias("r"), at("c", 1).alias("c"), at("r", 64).alias("_i"), at("c", 64).alias("_j"), F.when(F.col("valid"), F.col("v")).alias("v"), "valid")
    base = base.repartition("layer", "_i", "_j").groupBy("layer", "_i", "_j", "r", "c").agg(*sums("v", F.count("v"))).drop("_i", "_j")
    levels = [stored(base)]
    for _ in range(sizes.agg(F.max("_need")).first()[0] or 0):
        levels.append(stored(levels[-1].groupBy("layer", at("r", 2).alias("r"), at("c", 2).alias("c")).agg(*sums("s", F.sum("n")))))
    p = reduce(DataFrame.unionByName, [d.withColumn("level", F.lit(k)) for k, d in enumerate(levels)]).join(sizes, "layer").filter("level <= _need")
    lim = lambda n: F.greatest(F.lit(2), F.ceil(F.col(n) / F.pow(F.lit(2), F.col("level")))) - 1
    p = p.select("layer", "level", F.least("r", lim("height")).cast("bigint").alias("pr"), F.least("c", lim("width")).cast("bigint").alias("pc"), "s", "n", "valid")
    cells = p.repartition("layer", "level", "pr", "pc").groupBy("layer", "level", "pr", "pc")
    return cells.agg(F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("v"), F.bool_or("valid").alias("valid"))


def tile_index(sizes: DataFrame, tile: int) -> DataFrame:
    """Tiles per level with their bounds in source pixels."""
    need = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("height", "width") / tile))).cast("int")
    lv = sizes.select("layer", "height", "width", F.explode(F.sequence(F.lit(0), need)).alias("level")).withColumn("f", F.pow(F.lit(2), F.col("level")))
    for n in ("height", "width"):
        lv = lv.withColumn("l" + n, F.greatest(F.lit(2), F.ceil(F.col(n) / F.col("f"))).cast("bigint"))
    lv = lv.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.floor((F.col("lheight") - 1) / tile).cast("int"))))
    lv = lv.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.floor((F.col("lwidth") - 1) / tile).cast("int"))))
    b = lambda t, k, n: F.least(F.col(n), (F.col(t) + k) * tile * F.col("f")).cast("bigint")
    return lv.select("layer", "level", "tile_row", "tile_col", b("tile_row", 0, "height").alias("row_low"), b("tile_row", 1, "height").alias("row_high"),
                     b("tile_col", 0, "width").alias("col_low"), b("tile_col", 1, "width").alias("col_high"))


def select_level(index: DataFrame, demand: DataFrame) -> DataFrame:
    """Coarsest level whose reduction does not exceed the demanded source pixels per output pixel."""
    lv = index.select("layer", "level").distinct().join(demand, "layer")
    return lv.groupBy("layer").agg(F.coalesce(F.max(F.when(F.pow(F.lit(2), F.col("level")) <= F.col("demand"), F.col("level"))), F.lit(0)).alias("level"))


def overlap_masks(pixels: DataFrame) -> DataFrame:
    """Jointly valid cells per layer pair."""
    a = pixels.filter("valid").select(F.col("layer").alias("layer_a"), "r", "c")
    b = pixels.filter("valid").select(F.col("layer").alias("layer_b"), "r", "c")
    return a.join(b, ["r", "c"]).filter("layer_a < layer_b").groupBy("layer_a", "layer_b").agg(F.count(F.lit(1)).alias("cells"))


def stretch(pixels: DataFrame, by: list[str], kind: str = "minmax") -> DataFrame:
    """Masked min-max to 0..1, or 1-99 percentile to 0..255."""
    live = pixels.filter("valid")
    if kind == "minmax":
        s = live.groupBy(*by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        top = 1.0
    elif kind == "percentile":
        s = pctl(live, by, F.col("v"), {"_lo": (0.01, "midpoint"), "_hi": (0.99, "midpoint")}).drop("_n")
        top = 255.0
    else:
        raise ValueError(f"unknown stretch {kind!r}")
    df = pixels.join(s, by, "left")
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.withColumn("v", F.when(F.col("valid"), top * F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).otherwise(0.0)).drop("_lo", "_hi")


# --- image statistics ----------------------------------------------------------------------------------

def highpass(df: DataFrame, by: list[str], index: str, value: str, window: int, name: str = "highpass") -> DataFrame:
    """Value minus its moving average, window shrinking at the ends (consecutive integer index per key).

    A distributed running sum makes every average two equi-joined lookups, whatever the window or key size.
    """
    half = window // 2
    ends = df.groupBy(*by).agg(F.min(index).alias("_a"), F.max(index).alias("_b"))
    cum = materialize(running_sum(df.select(*by, index, value), by, [index], F.col(value), "_s"))
    q = df.join(ends, by).withColumn("_hi", F.least(F.col(index) + half, F.col("_b"))).withColumn("_lo", F.greatest(F.col(index) - half, F.col("_a")) - 1)
    look = cum.select(*by, F.col(index).alias("_k"), "_s")
    q = q.join(look.withColumnRenamed("_k", "_hi").withColumnRenamed("_s", "_sh"), by + ["_hi"])
    q = q.join(look.withColumnRenamed("_k", "_lo").withColumnRenamed("_s", "_sl"), by + ["_lo"], "left")
    mean = (F.col("_sh") - F.coalesce("_sl", F.lit(0.0))) / (F.col("_hi") - F.col("_lo"))
    return q.withColumn(name, F.col(value) - mean).drop("_a", "_b", "_hi", "_lo", "_sh", "_sl")


def _slopes(pixels: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    s = stencil(pixels, by, CROSS, values).filter("here is not null")
    for v in values:
        for a, b, n in (("left", "right", "x"), ("low", "high", "y")):
            va, vb, v0 = F.col(f"{a}.{v}"), F.col(f"{b}.{v}"), F.col(f"here.{v}")
            s = s.withColumn(f"{v}_d{n}", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (vb - va) / 2).when(F.col(b).isNotNull(), vb - v0)
                             .when(F.col(a).isNotNull(), v0 - va).otherwise(0.0))
    return s.drop(*CROSS)


def texture(pixels: DataFrame, by: list[str]) -> DataFrame:
    """RMS and p95 (midpoint percentile) of the gradient magnitude per layer."""
    g = materialize(_slopes(pixels, by, ["v"]).withColumn("m", F.hypot("v_dx", "v_dy")))
    p = pctl(g, by, F.col("m"), {"gradient_p95": (0.95, "midpoint")}).drop("_n")
    return g.groupBy(*by).agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("gradient_rms")).join(p, by)


def footprint(mapping: DataFrame, by: list[str]) -> DataFrame:
    """Source pixels per output step: median and nearest-rank p90 of the mapping's gradient, and a power-of-two reduction."""
    m = mapping.withColumnRenamed("out_r", "r").withColumnRenamed("out_c", "c")
    g = _slopes(m, by, ["src_r", "src_c"])
    g = g.withColumn("fx", F.hypot("src_r_dx", "src_c_dx")).withColumn("fy", F.hypot("src_r_dy", "src_c_dy"))
    f = materialize(g.select(*by, F.greatest("fx", "fy").alias("f")).filter("f > 0"))
    s = pctl(f, by, F.col("f"), {"median": (0.5, "linear"), "p90": (0.9, "nearest")})
    return s.withColumn("reduction", F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("median"), F.lit(1.0)))))))


# --- comparison ---------------------------------------------------------------------------------------

def compare_rasters(a: DataFrame, b: DataFrame, cell: list[str]) -> DataFrame:
    """Readback comparison: common valid cells, mask mismatches, RMS, nearest-rank p95 and maximum difference."""
    x = a.select(*cell, F.col("v").alias("va"), F.col("valid").alias("ma"))
    y = b.select(*cell, F.col("v").alias("vb"), F.col("valid").alias("mb"))
    j = x.join(y, cell, "full_outer").withColumn("ma", F.coalesce("ma", F.lit(False))).withColumn("mb", F.coalesce("mb", F.lit(False)))
    j = materialize(j.withColumn("d", F.when(F.col("ma") & F.col("mb"), F.abs(F.col("va") - F.col("vb")))).select("ma", "mb", "d"))
    p = pctl(j, [], F.col("d"), {"p95": (0.95, "nearest")}).select("p95")
    s = j.agg(F.count("d").alias("common"), F.count_if(F.col("ma") != F.col("mb")).alias("mask_mismatch"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.max("d").alias("maximum"))
    return s.crossJoin(F.broadcast(p))  # one row against one row


def audit_repeat(a: DataFrame, b: DataFrame, cell: list[str]) -> DataFrame:
    """Repeatability: same keys, equal masks, largest difference, count retention."""
    x = a.select(*cell, F.col("v").alias("va"), F.col("valid").alias("ma"))
    y = b.select(*cell, F.col("v").alias("vb"), F.col("valid").alias("mb"))
    j = x.join(y, cell, "full_outer")
    out = j.agg(F.count("ma").alias("n_a"), F.count("mb").alias("n_b"), F.bool_and(F.col("ma").isNotNull() & F.col("mb").isNotNull()).alias("same_keys"),
                F.bool_and(F.coalesce(F.col("ma") == F.col("mb"), F.lit(False))).alias("equal_masks"), F.max(F.abs(F.col("va") - F.col("vb"))).alias("max_difference"),
                F.count_if("ma").alias("_va"), F.count_if("mb").alias("_vb"))
    return out.withColumn("retention", F.when(F.col("_va") > 0, F.col("_vb") / F.col("_va"))).drop("_va", "_vb")


def audit_disparity(df: DataFrame, by: list[str], gross: float = 3.0) -> DataFrame:
    """Disparity against truth: completeness, gross outliers, p95, left-right error, false-valid occlusion.

    df: by…, disparity, valid, truth, truth_valid, occluded, reverse (disparity found in the other view).
    """
    ok = F.col("valid") & F.col("truth_valid") & ~F.col("occluded")
    e = df.withColumn("_e", F.when(ok, F.abs(F.col("disparity") - F.col("truth"))))
    s = e.groupBy(*by).agg(
        (F.count_if(ok) / F.count_if(F.col("truth_valid") & ~F.col("occluded"))).alias("completeness"),
        (F.count_if(F.col("_e") > gross) / F.count("_e")).alias("outlier_rate"),
        F.avg(F.when(ok, F.abs(F.col("disparity") + F.col("reverse")))).alias("left_right_error"),
        (F.count_if(F.col("valid") & F.col("occluded")) / F.count_if("occluded")).alias("occlusion_false_valid"))
    p = pctl(materialize(e.select(*by, "_e")), by, F.col("_e"), {"p95": (0.95, "midpoint")}).drop("_n")
    return s.join(p, by)


# --- template matching ----------------------------------------------------------------------------------

def seed_grid(pixels: DataFrame, row_step: int, col_step: int, row_start: int = 0, col_start: int = 0) -> DataFrame:
    """Seeds on a regular lattice of an image (the matcher's sampling step)."""
    return pixels.filter((F.col("r") % row_step == row_start) & (F.col("c") % col_step == col_start))


def _patches(pixels: DataFrame, anchors: DataFrame, keys: list[str], radius: int, tag: str) -> DataFrame:
    """Every anchor (key, r, c) with its patch pixels; only complete, valid patches survive."""
    n = 2 * radius + 1
    off = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)))
    a = anchors.select(*keys, "r", "c", F.inline(off)).withColumn("_r", F.col("r") + F.col("i")).withColumn("_c", F.col("c") + F.col("j"))
    p = pixels.filter("valid").select(F.col("r").cast("bigint").alias("_r"), F.col("c").cast("bigint").alias("_c"), F.col("v").alias("v"))
    g = a.join(p, ["_r", "_c"]).groupBy(*keys, "r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "v"))), lambda s: s["v"]).alias("_p" + tag))
    return g.filter(F.size("_p" + tag) == n * n)


def correlation(a: Column, b: Column) -> Column:
    """Zero-mean normalised correlation of two equally long arrays."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ma, mb = total(a) / F.size(a), total(b) / F.size(b)
    da, db = F.transform(a, lambda v: v - ma), F.transform(b, lambda v: v - mb)
    dot = total(F.zip_with(da, db, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(da, lambda v: v * v))) * F.sqrt(total(F.transform(db, lambda v: v * v)))
    return dot / F.greatest(norm, F.lit(2.220446049250313e-16))


def rank_agreement(a: Column, b: Column) -> Column:
    """Census form: share of positions on the same side of their patch medians (odd patch sizes)."""
    above = lambda x: F.transform(x, lambda v: v > F.get(F.array_sort(x), (F.size(x) / 2).cast("int")))
    same = F.zip_with(above(a), above(b), lambda p, q: F.when(p == q, 1.0).otherwise(0.0))
    return F.aggregate(same, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def gradient_agreement(a: Column, b: Column, size: int) -> Column:
    """Normalised correlation of the patches' gradients (one-sided at patch edges)."""
    def grads(x):
        at = lambda i, j: F.get(x, F.lit(i * size + j))
        out = []
        for i in range(size):
            for j in range(size):
                for k, (p, q) in enumerate((((i, max(j - 1, 0)), (i, min(j + 1, size - 1))), ((max(i - 1, 0), j), (min(i + 1, size - 1), j)))):
                    step = (q[1] - p[1]) if k == 0 else (q[0] - p[0])
                    out.append((at(*q) - at(*p)) / float(max(step, 1)))
        return F.array(*out)

    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ga, gb = grads(a), grads(b)
    dot = total(F.zip_with(ga, gb, lambda p, q: p * q))
    return dot / F.greatest(F.sqrt(total(F.transform(ga, lambda v: v * v))) * F.sqrt(total(F.transform(gb, lambda v: v * v))), F.lit(2.220446049250313e-16))


def candidate_scores(seeds: DataFrame, moving: DataFrame, reference: DataFrame, dx: tuple[int, int], dy: tuple[int, int], radius: int, method: str = "zncc") -> DataFrame:
    """Score of every seed at every disparity: patches are cut once per anchor and met by equi-joins."""
    mv = _patches(moving, seeds.select("seed", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c")), ["seed"], radius, "m")
    cand = mv.withColumn("dx", F.explode(F.sequence(F.lit(dx[0]), F.lit(dx[1])))).withColumn("dy", F.explode(F.sequence(F.lit(dy[0]), F.lit(dy[1]))))
    cand = cand.withColumn("_rr", F.col("r") - F.col("dy")).withColumn("_rc", F.col("c") - F.col("dx"))
    anchors = cand.select(F.col("_rr").alias("r"), F.col("_rc").alias("c")).distinct()
    rf = _patches(reference, anchors, [], radius, "r").withColumnRenamed("r", "_rr").withColumnRenamed("c", "_rc")
    j = cand.join(rf, ["_rr", "_rc"])
    score = {"zncc": lambda: correlation(F.col("_pm"), F.col("_pr")), "censusRank": lambda: rank_agreement(F.col("_pm"), F.col("_pr")),
             "gradientCorrelation": lambda: gradient_agreement(F.col("_pm"), F.col("_pr"), 2 * radius + 1)}[method]()
    std = F.sqrt(F.aggregate(F.transform("_pm", lambda v: v * v), F.lit(0.0), lambda s, v: s + v) / F.size("_pm")
                 - F.pow(F.aggregate("_pm", F.lit(0.0), lambda s, v: s + v) / F.size("_pm"), 2.0))
    n = float((2 * radius + 1) ** 2)
    # scores are stored, patches are not: a row of a candidate is two patches long
    return stored(j.select("seed", "r", "c", "dx", "dy", score.alias("score"), (std * (n / (n - 1)) ** 0.5).alias("texture")))


def _parabola(l: Column, m: Column, r: Column) -> Column:
    den = l - 2 * m + r
    return F.when(F.abs(den) > 2.220446049250313e-16, F.least(F.lit(0.5), F.greatest(F.lit(-0.5), 0.5 * (l - r) / den))).otherwise(0.0)


def template_match(seeds: DataFrame, moving: DataFrame, reference: DataFrame, dx: tuple[int, int], dy: tuple[int, int], radius: int = 2, method: str = "zncc",
                   minimum_texture: float = 1.0, minimum_margin: float = 0.01, tolerance: float = 1.0) -> DataFrame:
    """Best disparity per seed with uniqueness, sub-pixel parabola and reverse consistency; first failing rule names the state."""
    s = candidate_scores(seeds, moving, reference, dx, dy, radius, method)
    two = best_two(s, ["seed"], "score", ["dx", "dy"])
    side = lambda k, n: s.select("seed", (F.col("dx") - k).alias("dx"), "dy", F.col("score").alias(n))
    b = two.join(side(-1, "_l"), ["seed", "dx", "dy"], "left").join(side(1, "_r"), ["seed", "dx", "dy"], "left")
    b = b.withColumn("sub", F.coalesce(_parabola(F.col("_l"), F.col("best"), F.col("_r")), F.lit(0.0)))
    tex = s.groupBy("seed", "r", "c").agg(F.max("texture").alias("texture"))
    b = materialize(b.join(tex, "seed").withColumn("disparity", F.col("dx") + F.col("sub")).drop("_l", "_r"))
    back = b.select("seed", F.round(F.col("r") - F.col("dy")).cast("bigint").alias("r"), F.round(F.col("c") - F.col("disparity")).cast("bigint").alias("c"))
    rs = candidate_scores(back, reference, moving, (-dx[1], -dx[0]), (-dy[1], -dy[0]), radius, method)
    rev = rs.groupBy("seed").agg(F.min(F.struct((-F.col("score")).alias("s"), "dx", "dy")).alias("m")).select("seed", F.col("m.dx").alias("rdx"), F.col("m.dy").alias("rdy"))
    out = seeds.join(b.drop("r", "c"), "seed", "left").join(rev, "seed", "left")
    err = F.hypot(F.col("disparity") + F.col("rdx"), (F.col("dy") + F.col("rdy")).cast("double"))
    margin = F.coalesce(F.col("margin"), F.lit(0.0))
    state = (F.when(~F.col("valid"), "masked").when(F.col("best").isNull(), "noMatch").when(F.col("texture") < minimum_texture, "insufficientTexture")
             .when((F.col("ties") > 1) | (margin < minimum_margin), "ambiguousRepetitive").when(err.isNull() | (err > tolerance), "occluded").otherwise("valid"))
    return out.withColumn("consistency", err).withColumn("state", state)


def refine_matches(matches: DataFrame, moving: DataFrame, reference: DataFrame, search: int = 2, radius: int = 2, minimum_peak: float = 0.5, minimum_margin: float = 0.005) -> DataFrame:
    """Local correlation refinement of a match: shift of the reference position, parabola in both axes, uncertainty and status.

    matches: seed, r, c (moving), rr, rc (reference), all integers.
    """
    mv = _patches(moving, matches.select("seed", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c")), ["seed"], radius, "m").drop("r", "c")
    off = F.sequence(F.lit(-search), F.lit(search))
    q = matches.select("seed", "rr", "rc").withColumn("oy", F.explode(off)).withColumn("ox", F.explode(off))
    q = q.withColumn("r", (F.col("rr") + F.col("oy")).cast("bigint")).withColumn("c", (F.col("rc") + F.col("ox")).cast("bigint"))
    rf = _patches(reference, q.select("r", "c").distinct(), [], radius, "r")
    s = materialize(q.join(rf, ["r", "c"]).join(mv, "seed").select("seed", "ox", "oy", correlation(F.col("_pm"), F.col("_pr")).alias("score")))
    two = best_two(s, ["seed"], "score", ["ox", "oy"])
    for ax, ay, n in ((1, 0, "x1"), (-1, 0, "x0"), (0, 1, "y1"), (0, -1, "y0")):
        two = two.join(s.select("seed", (F.col("ox") - ax).alias("ox"), (F.col("oy") - ay).alias("oy"), F.col("score").alias(n)), ["seed", "ox", "oy"], "left")
    fx, fy = _parabola(F.col("x0"), F.col("best"), F.col("x1")), _parabola(F.col("y0"), F.col("best"), F.col("y1"))
    curve = F.least(2 * F.col("best") - F.col("x0") - F.col("x1"), 2 * F.col("best") - F.col("y0") - F.col("y1"))
    out = matches.join(two, "seed", "left")
    edge = (F.abs("ox") == search) | (F.abs("oy") == search)
    status = (F.when(F.col("best").isNull(), "patchOutside").when(F.col("best") < minimum_peak, "weakPeak").when(edge, "edgeOfWindow")
              .when(F.coalesce(F.col("margin"), F.lit(0.0)) < minimum_margin, "ambiguousPeak").when(curve <= 0, "flatPeak").otherwise("refined"))
    return (out.withColumn("status", status).withColumn("shift_x", F.col("ox") + F.coalesce(fx, F.lit(0.0))).withColumn("shift_y", F.col("oy") + F.coalesce(fy, F.lit(0.0)))
            .withColumn("uncertainty", F.when(curve > 0, F.sqrt((1 - F.col("best")) / curve))).drop("x0", "x1", "y0", "y1"))


def triangulate_disparity(disparities: DataFrame, stride: int, maximum_separation: float) -> DataFrame:
    """Strided disparity samples with their two rays to points; the ray gap decides validity.

    disparities: r, c, disparity, valid and ray columns ao*, ad*, bo*, bd*.
    """
    from .association import with_pair_geometry

    s = disparities.filter((F.col("r") % stride == 0) & (F.col("c") % stride == 0))
    g = with_pair_geometry(s)
    ok = F.col("valid") & F.col("pair_forward_valid") & (F.col("pair_separation") <= maximum_separation)
    return g.withColumn("point_valid", F.coalesce(ok, F.lit(False)))


# --- vertical scale ------------------------------------------------------------------------------------

def row_profiles(pixels: DataFrame, strips: int, width: int) -> DataFrame:
    """Mean valid value per (layer, strip, row)."""
    strip = F.least(F.floor(F.col("c") * strips / width), F.lit(strips - 1)).cast("int")
    return pixels.filter("valid").groupBy("layer", strip.alias("strip"), "r").agg(F.avg("v").alias("p"))


def scale_scores(profiles: DataFrame, scales: list[float], shifts: list[int], window: int = 15) -> DataFrame:
    """Normalised correlation of every strip's two high-passed profiles for all scales and shifts.

    Layer 1 is read at row*scale + shift (linear interpolation through a join on the lower row); sums of products give
    the correlation, so a strip's profile is never gathered.
    """
    hp = materialize(highpass(profiles, ["layer", "strip"], "r", "p", window, "h").select("layer", "strip", "r", "h"))
    a = hp.filter("layer = 0").select("strip", "r", F.col("h").alias("ha"))
    b = hp.filter("layer = 1").select("strip", F.col("r").alias("_k"), F.col("h").alias("hb"))
    nxt = b.select("strip", (F.col("_k") - 1).alias("_k"), F.col("hb").alias("hn"))
    seg = b.join(nxt, ["strip", "_k"])
    q = a.withColumn("scale", F.explode(F.array(*(F.lit(float(s)) for s in scales)))).withColumn("shift", F.explode(F.array(*(F.lit(int(t)) for t in shifts))))
    q = q.withColumn("_u", F.col("r") * F.col("scale") + F.col("shift")).withColumn("_k", F.floor("_u").cast("bigint"))
    j = q.join(seg, ["strip", "_k"]).withColumn("hb", F.col("hb") + (F.col("_u") - F.col("_k")) * (F.col("hn") - F.col("hb")))
    return j.groupBy("strip", "scale", "shift").agg(F.count(F.lit(1)).alias("n"), F.corr("ha", "hb").alias("score"))


def vertical_scale(pixels: DataFrame, strips: int, width: int, scales: list[float], shifts: list[int], window: int = 15, minimum_rows: int = 16) -> DataFrame:
    """Scale of layer 1 against layer 0: best scale per strip, then refined about it, weighted median over strips, confidence."""
    from raytable.functions.scalars import confidence_class

    from .quantiles import median_mad, weighted_median

    prof = materialize(row_profiles(pixels, strips, width))
    best = lambda s: s.filter((F.col("n") >= minimum_rows) & F.col("score").isNotNull()).groupBy("strip").agg(
        F.min(F.struct((-F.col("score")).alias("m"), "scale", "shift")).alias("b")).select("strip", F.col("b.scale").alias("scale"), F.col("b.shift").alias("shift"), (-F.col("b.m")).alias("score"))
    coarse = best(scale_scores(prof, scales, shifts, window))
    centre = coarse.agg(F.avg("scale")).first()[0] or 1.0
    step = (max(scales) - min(scales)) / max(len(scales) - 1, 1)
    fine = [centre + step * k / 8 for k in range(-8, 9)]
    f = materialize(best(scale_scores(prof, fine, shifts, window)).withColumn("_one", F.lit(0)).withColumn("w", F.greatest(F.col("score"), F.lit(1e-6))))
    mid = weighted_median(f, ["_one"], "scale", "w", "scale")
    spread = median_mad(f, ["_one"], F.col("scale")).select("_one", (1.4826 * F.col("mad")).alias("spread"))
    s = f.groupBy("_one").agg(F.count(F.lit(1)).alias("strips"), F.avg("score").alias("correlation")).join(mid, "_one").join(spread, "_one").drop("_one")
    return s.withColumn("confidence", confidence_class(F.col("strips"), F.col("correlation"), F.col("spread")))
