"""Network estimation: consensus models, pointing adjustment, sensitivity and spline attitude.

Residuals, derivatives and sums of products are one pass per iteration; blocks, steps and inverses of the pointing
adjustment stay tables and only sums of one row reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raytable.functions.scalars import bspline_basis
from raytable.runtime import FEW, few, is_empty, materialize, stored

from .ordered import rank_rows
from .quantiles import median

# fixed values: index offsets of the deterministic hypotheses, as shares of the match count
PAIR_FRACTIONS = (0.17, 0.31, 0.47, 0.63)
TRIPLE_FRACTIONS = ((0.17, 0.47), (0.31, 0.67), (0.13, 0.73), (0.41, 0.83))


def _half_away(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def hypothesis_samples(n: int, size: int, maximum: int) -> list[tuple[int, ...]]:
    """Distinct sorted row-index samples (1-based) spread over n rows."""
    if n < size:
        return []
    bases = dict.fromkeys(int(b) for b in _half_away(np.linspace(1, n, min(n, max(1, maximum // 4)))))
    shares = [(f,) for f in PAIR_FRACTIONS] if size == 2 else TRIPLE_FRACTIONS
    out: dict[tuple[int, ...], None] = {}
    for b in bases:
        for fr in shares:
            s = tuple(sorted([b, *(int((b - 1 + max(1, int(np.floor(f * n + 0.5)))) % n) + 1 for f in fr)]))
            if len(set(s)) == size:
                out.setdefault(s)
    return list(out)[:maximum]


def _fit(kind: str, x, y, u, v):
    """Least-squares matrix (a b tx c d ty) of moving (x, y) onto reference (u, v); None if degenerate."""
    if kind == "similarity":
        mx, my, mu, mv = x.mean(), y.mean(), u.mean(), v.mean()
        dx, dy, du, dv = x - mx, y - my, u - mu, v - mv
        q = (dx * dx + dy * dy).sum()
        if q <= 1e-18:
            return None
        a, b = (dx * du + dy * dv).sum() / q, (dx * dv - dy * du).sum() / q
        return a, -b, mu - a * mx + b * my, b, a, mv - b * mx - a * my
    m = np.stack([x, y, np.ones_like(x)], 1)
    if np.linalg.matrix_rank(m) < 3:
        return None
    s = np.linalg.lstsq(m, np.stack([u, v], 1), rcond=None)[0]
    return s[0, 0], s[1, 0], s[2, 0], s[0, 1], s[1, 1], s[2, 1]


MATRIX = ("a", "b", "tx", "c", "d", "ty")
#: Scores of hypotheses are compared on this grid.
SCORE_GRID = 1e-12


def _residual() -> Column:
    px = F.col("a") * F.col("mx") + F.col("b") * F.col("my") + F.col("tx")
    py = F.col("c") * F.col("mx") + F.col("d") * F.col("my") + F.col("ty")
    return F.hypot(px - F.col("rx"), py - F.col("ry"))


def _refit(live: DataFrame, by: list[str], kind: str, minimum: int) -> DataFrame:
    """Closed-form refit per key from combined sums; keys with too few inliers are left out."""
    s = live.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(c).alias("_m" + c) for c in ("mx", "my", "rx", "ry")))
    z = live.join(stored(s), by)
    dx, dy, du, dv = (F.col(c) - F.col("_m" + c) for c in ("mx", "my", "rx", "ry"))
    g = z.groupBy(*by).agg(F.first("_n").alias("_n"), *(F.first("_m" + c).alias("_m" + c) for c in ("mx", "my", "rx", "ry")),
                           F.sum(dx * dx).alias("xx"), F.sum(dx * dy).alias("xy"), F.sum(dy * dy).alias("yy"), F.sum(dx * du).alias("xu"),
                           F.sum(dy * du).alias("yu"), F.sum(dx * dv).alias("xv"), F.sum(dy * dv).alias("yv")).filter(F.col("_n") >= minimum)
    if kind == "similarity":
        q = F.col("xx") + F.col("yy")
        a, b = F.try_divide(F.col("xu") + F.col("yv"), q), F.try_divide(F.col("xv") - F.col("yu"), q)
        g = g.withColumn("a", a).withColumn("c", b).withColumn("b", -F.col("c")).withColumn("d", F.col("a"))
    else:
        det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
        sol = lambda p, q, k: F.try_divide(F.col("yy") * F.col(p) - F.col("xy") * F.col(q), det) if k == 0 else F.try_divide(F.col("xx") * F.col(q) - F.col("xy") * F.col(p), det)
        g = g.withColumn("a", sol("xu", "yu", 0)).withColumn("b", sol("xu", "yu", 1)).withColumn("c", sol("xv", "yv", 0)).withColumn("d", sol("xv", "yv", 1))
    g = g.withColumn("tx", F.col("_mrx") - F.col("a") * F.col("_mmx") - F.col("b") * F.col("_mmy")).withColumn("ty", F.col("_mry") - F.col("c") * F.col("_mmx") - F.col("d") * F.col("_mmy"))
    return g.filter("a is not null and tx is not null").select(*by, *MATRIX)


def _contenders(tied: DataFrame, by: list[str]) -> DataFrame:
    """Hypotheses of the highest count that may still win, and whether counts alone settle them (``_settled``).

    A median is zero on the score grid if more than half of the rows are, and is not if fewer than half are: no score is below
    zero, so exact medians are left for hypotheses of which no median is known to be zero or just half of the rows are.
    """
    zero = lambda z, n: F.col(z) >= F.floor(F.col(n) / 2) + 1
    above = lambda z, n: ((F.col(n) % 2 == 1) & ~zero(z, n)) | (2 * F.col(z) < F.col(n))
    every = Window.partitionBy(*by)
    t = tied.filter("_w > 0").withColumn("_i0", zero("_cz", "_c")).withColumn("_m0", zero("_wz", "_w"))
    t = t.withColumn("_best_i", F.bool_or("_i0").over(every)).filter(~(F.col("_best_i") & above("_cz", "_c")))
    t = t.withColumn("_best", F.bool_or(F.col("_i0") & F.col("_m0")).over(every)).filter(~(F.col("_best") & above("_wz", "_w")))
    known = (F.col("_i0") & F.col("_m0")) | (F.count(F.lit(1)).over(every) == 1)
    return materialize(t.withColumn("_settled", known).select(*by, "_h", *MATRIX, "_settled"))


ROWS_AT_ONCE = 1024  # rows of a pack that meet all hypotheses of their pair in one step


def _packs(by: list[str]):
    """Rows of one pair in a batch as one row of arrays: nothing is shuffled, and a pair may have many packs."""
    def run(batches):
        for pdf in batches:
            at = pdf.groupby(by, sort=False, dropna=False).indices if by else {(): np.arange(len(pdf))}
            cols = {c: pdf[c].to_numpy(float) for c in ("mx", "my", "rx", "ry")}
            out = pdf.iloc[[i[0] for i in at.values()]][by].reset_index(drop=True)
            for c, v in cols.items():
                out["_" + c] = [v[i] for i in at.values()]
            yield out

    return run


def _counted(by: list[str], distance: float):
    """Per pack and hypothesis: rows within the distance, those of them that vanish, rows with a residual, and vanishing rows."""
    def run(batches):
        for pdf in batches:
            parts = []
            for k in range(len(pdf)):
                x, y, u, v = (np.asarray(pdf[c].iloc[k], float)[:, None] for c in ("_mx", "_my", "_rx", "_ry"))
                a, b, tx, c, d, ty = (np.asarray(pdf["_" + n].iloc[k], float) for n in MATRIX)
                sums = np.zeros((4, len(a)), np.int64)
                for i in range(0, len(x), ROWS_AT_ONCE):
                    one = slice(i, i + ROWS_AT_ONCE)
                    with np.errstate(invalid="ignore", over="ignore"):
                        e = a * x[one] + b * y[one] + tx - u[one]
                        f = c * x[one] + d * y[one] + ty - v[one]
                        # squares decide but for a narrow band around the limits, where the rounding of the root counts
                        s = e * e + f * f
                        near, small = s <= distance * distance, s < (0.5 * SCORE_GRID) ** 2
                        close = np.abs(s - distance * distance) <= 1e-12 * distance * distance
                        close |= np.abs(s - (0.5 * SCORE_GRID) ** 2) <= 1e-12 * (0.5 * SCORE_GRID) ** 2
                        if close.any():
                            r = np.hypot(e[close], f[close])
                            near[close], small[close] = r <= distance, r / SCORE_GRID < 0.5
                    sums += [near.sum(0), (near & small).sum(0), (~np.isnan(s)).sum(0), small.sum(0)]
                part = pdf[by].iloc[[k] * len(a)].reset_index(drop=True)
                part["_h"] = np.asarray(pdf["_hs"].iloc[k], np.int32)
                part["_c"], part["_cz"], part["_w"], part["_wz"] = sums
                parts.append(part)
                if sum(map(len, parts)) >= FEW:
                    yield pd.concat(parts)
                    parts = []
            if parts:
                yield pd.concat(parts)

    return run


def consensus_model(matches: DataFrame, by: list[str], order: list[str], kind: str = "similarity", distance: float = 3.0, maximum: int = 512,
                    refits: int = 3) -> tuple[DataFrame, DataFrame]:
    """Deterministic consensus per pair: (models, matches with residual and accepted).

    matches: by…, mx, my, rx, ry and the order columns. Hypotheses are fixed by the pair's row count; only the sampled
    rows are gathered. Inliers are counted for packs of rows, all hypotheses of their pair at once; exact medians are taken only for the
    hypotheses that share the highest count and that counts of vanishing residuals do not tell apart.
    Scores within 1e-12 keep the earlier hypothesis.
    """
    size = 2 if kind == "similarity" else 3
    m = stored(rank_rows(matches, by, order, "_rn", total="_n"))
    keys = ", ".join(f"`{c}` {m.schema[c].dataType.simpleString()}" for c in by)

    def samples(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                for h, s in enumerate(hypothesis_samples(int(rec["_n"]), size, maximum)):
                    rows += [{**{c: rec[c] for c in by}, "_h": h, "_j": j, "_rn": i} for j, i in enumerate(s)]
            yield pd.DataFrame(rows, columns=[*by, "_h", "_j", "_rn"])

    picks = stored(m.select(*by, "_n").distinct().mapInPandas(samples, f"{keys}, _h int, _j int, _rn bigint"))
    packed = m.select(*by, "_rn", "mx", "my", "rx", "ry").join(few(picks, picks), by + ["_rn"]).groupBy(*by, "_h").agg(
        F.array_sort(F.collect_list(F.struct("_j", "mx", "my", "rx", "ry"))).alias("_s"))  # two or three rows each

    def fits(batches):
        for pdf in batches:
            out = []
            for k in range(len(pdf)):
                s = pdf["_s"].iloc[k]
                f = _fit(kind, *(np.array([r[c] for r in s], float) for c in ("mx", "my", "rx", "ry")))
                if f is not None and np.isfinite(f).all():
                    out.append((*(pdf[c].iloc[k] for c in by), int(pdf["_h"].iloc[k]), *map(float, f)))
            yield pd.DataFrame(out, columns=[*by, "_h", *MATRIX])

    hyp = materialize(packed.mapInPandas(fits, f"{keys}, _h int, " + ", ".join(f"{c} double" for c in MATRIX)))
    lists = hyp.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_h", *MATRIX))).alias("_l")).select(
        *by, F.col("_l._h").alias("_hs"), *(F.col(f"_l.{c}").alias("_" + c) for c in MATRIX))  # `maximum` hypotheses a pair at most
    packs = m.select(*by, "mx", "my", "rx", "ry").mapInPandas(_packs(by), f"{keys}, " + ", ".join(f"_{c} array<double>" for c in ("mx", "my", "rx", "ry")))
    counts = packs.join(few(stored(lists), hyp), by).mapInPandas(_counted(by, distance), f"{keys}, _h int, _c bigint, _cz bigint, _w bigint, _wz bigint")
    counts = materialize(counts.groupBy(*by, "_h").agg(*(F.sum(c).alias(c) for c in ("_c", "_cz", "_w", "_wz"))))
    near = F.col("_e") <= distance
    top = counts.groupBy(*by).agg(F.max("_c").alias("_c"))
    tied = _contenders(materialize(counts.join(top, by + ["_c"]).join(hyp, by + ["_h"])), by)
    penalty = F.sqrt(F.pow(F.col("a") - 1, 2) + F.col("b") * F.col("b") + F.col("c") * F.col("c") + F.pow(F.col("d") - 1, 2))
    grid = lambda c: F.round(F.coalesce(c, F.lit(1e300)) / SCORE_GRID) * SCORE_GRID
    rest = tied.filter("not _settled")
    scored = tied.filter("_settled").select(*by, "_h", *MATRIX, F.lit(0.0).alias("i"), F.lit(0.0).alias("m"))
    if not is_empty(rest):
        res = materialize(m.select(*by, "mx", "my", "rx", "ry").join(rest, by).withColumn("_e", _residual()).select(*by, "_h", "_e"))
        whole = median(res, by + ["_h"], F.col("_e"), "_med").drop("_n")
        inl = median(res.filter(near), by + ["_h"], F.col("_e"), "_inl").drop("_n")
        exact = rest.join(whole, by + ["_h"]).join(inl, by + ["_h"], "left")
        scored = scored.unionByName(exact.select(*by, "_h", *MATRIX, grid(F.col("_inl")).alias("i"), grid(F.col("_med")).alias("m")))
    rank = F.struct("i", "m", grid(penalty).alias("p"), "_h")
    cur = stored(scored.groupBy(*by).agg(F.min_by(F.struct(*MATRIX), rank).alias("w")).select(*by, "w.*"))
    for _ in range(refits):
        live = m.join(cur, by).filter(_residual() <= distance).select(*by, "mx", "my", "rx", "ry")
        fresh = _refit(live, by, kind, size).select(*by, F.struct(*MATRIX).alias("w"))
        cur = stored(cur.select(*by, F.struct(*MATRIX).alias("o")).join(fresh, by, "left").select(*by, F.coalesce("w", "o").alias("w")).select(*by, "w.*"))
    out = m.join(cur, by, "left").withColumn("residual", _residual()).withColumn("accepted", F.coalesce(F.col("residual") <= distance, F.lit(False)))
    return cur, out.drop("_rn", "_n", *MATRIX)


# --- pointing adjustment ---------------------------------------------------------------------------

@dataclass(frozen=True)
class AdjustOptions:
    residual: str = "ray"          # ray: closest approach (3 components); coplanarity: one angular component
    loss: str = "huber"            # none, huber, cauchy or bisquare (square up to the scale, constant beyond)
    scale: float = 1.0
    prior_sigma: float = 0.05      # radians, holds the gauge
    step: float = 1e-6
    iterations: int = 8
    tolerance: float = 1e-9
    solver_tolerance: float = 1e-5  # of a step's conjugate gradients, against the first residual; the next step repairs the rest


def _turn(v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rotate rows of v by omega, phi, kappa rows of a."""
    (co, so), (cp, sp), (ck, sk) = ((np.cos(a[:, i]), np.sin(a[:, i])) for i in range(3))
    y, z = co * v[:, 1] - so * v[:, 2], so * v[:, 1] + co * v[:, 2]
    x, z = cp * v[:, 0] + sp * z, cp * z - sp * v[:, 0]
    return np.stack([ck * x - sk * y, sk * x + ck * y, z], 1)


def _gap(kind: str, oa, va, ob, vb) -> np.ndarray:
    va, vb = va / np.linalg.norm(va, axis=1, keepdims=True), vb / np.linalg.norm(vb, axis=1, keepdims=True)
    base = oa - ob
    if kind == "coplanarity":
        b = -base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-300)
        n = (b * np.cross(va, vb)).sum(1)
        den = np.sqrt((np.cross(vb, b) ** 2).sum(1) + (np.cross(b, va) ** 2).sum(1))
        return (n / np.maximum(den, 1e-8))[:, None]
    c, d, e = (va * vb).sum(1), (va * base).sum(1), (vb * base).sum(1)
    det = np.where(np.abs(1 - c * c) <= 1e-10, 1.0, 1 - c * c)
    return base + va * ((c * e - d) / det)[:, None] - vb * ((e - c * d) / det)[:, None]


def _weights(r: np.ndarray, opt: AdjustOptions) -> np.ndarray:
    a = np.abs(r)
    if opt.loss == "none":
        return np.ones_like(r)
    if opt.loss == "huber":
        return np.where(a > opt.scale, opt.scale / np.maximum(a, 1e-300), 1.0)
    if opt.loss == "cauchy":
        return 1 / (1 + (a / opt.scale) ** 2)
    return np.where(a > opt.scale, 0.0, 1.0)


def _loss(r: np.ndarray, opt: AdjustOptions) -> np.ndarray:
    """What the weights descend on: the loss of every residual component, its square where it is small."""
    a = np.abs(r)
    if opt.loss == "none":
        return r * r
    if opt.loss == "huber":
        return np.where(a > opt.scale, 2 * opt.scale * a - opt.scale ** 2, r * r)
    if opt.loss == "cauchy":
        return opt.scale ** 2 * np.log1p((r / opt.scale) ** 2)
    return np.minimum(a, opt.scale) ** 2


ANGLES = ("omega", "phi", "kappa")


def normal_blocks(records: DataFrame, angles: DataFrame | None, opt: AdjustOptions) -> DataFrame:
    """Per view pair: packed 6x6 normal block (21), gradient (6), sum of the loss, count, and rows without a finite residual.

    ``angles``: view_id, omega, phi, kappa; None or a view without a row stands for zero angles.
    """
    iu = np.triu_indices(6)

    def run(batches):
        for pdf in batches:
            get = lambda s, p: pdf[[f"{s}{p}{c}" for c in "xyz"]].to_numpy(float)
            oa, va, ob, vb = get("a", "o"), get("a", "d"), get("b", "o"), get("b", "d")
            ta, tb = (pdf[[f"{s}{c}" for c in ANGLES]].to_numpy(float) for s in "ab")
            value = lambda x, y: _gap(opt.residual, oa, _turn(va, x), ob, _turn(vb, y))
            r = value(ta, tb)
            cols = []
            for k in range(6):
                d = np.zeros(3)
                d[k % 3] = opt.step
                up, lo = ((ta + d, tb), (ta - d, tb)) if k < 3 else ((ta, tb + d), (ta, tb - d))
                cols.append((value(*up) - value(*lo)) / (2 * opt.step))
            j = np.stack(cols, 2)
            w = _weights(r, opt)
            ok = np.isfinite(r).all(1) & np.isfinite(j).all((1, 2))
            n = np.einsum("nck,nc,ncl->nkl", j, w, j)[:, iu[0], iu[1]]
            g = np.einsum("nck,nc,nc->nk", j, w, r)
            f = pd.DataFrame(np.where(ok[:, None], np.hstack([n, g, _loss(r, opt).sum(1)[:, None], ok[:, None], np.zeros((len(r), 1))]), np.eye(30)[29]))
            f["view_a"], f["view_b"] = pdf["view_a"], pdf["view_b"]
            s = f.groupby(["view_a", "view_b"], sort=False).sum()
            yield pd.DataFrame({"view_a": s.index.get_level_values(0), "view_b": s.index.get_level_values(1), "v": s.to_numpy().tolist()})

    cols = ["view_a", "view_b"] + [f"{s}{p}{c}" for s in "ab" for p in "od" for c in "xyz"]
    rows = records.select(*cols)
    for side in "ab":
        if angles is None:
            rows = rows.select("*", *(F.lit(0.0).alias(f"{side}{c}") for c in ANGLES))
        else:
            turn = angles.select(F.col("view_id").alias(f"view_{side}"), *(F.col(c).alias(f"{side}{c}") for c in ANGLES))
            rows = rows.join(turn, f"view_{side}", "left").fillna(0.0, [f"{side}{c}" for c in ANGLES])
    part = rows.mapInPandas(run, "view_a string, view_b string, v array<double>")
    flat = part.select("view_a", "view_b", F.posexplode("v").alias("p", "s")).groupBy("view_a", "view_b", "p").agg(F.sum("s").alias("s"))
    return flat.groupBy("view_a", "view_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda e: e["s"]).alias("v"))


# --- block conjugate gradients on the table of pair blocks -----------------------------------

def _packed(k: int, l: int) -> Column:
    k, l = min(k, l), max(k, l)
    return F.col("v")[6 * k - k * (k - 1) // 2 + l - k]


def _matrix(side: int, other: int) -> list[Column]:
    """3x3 part of a packed 6x6 block, row by row."""
    return [_packed(3 * side + k, 3 * other + l).alias(f"h{k}{l}") for k in range(3) for l in range(3)]


NINE = [f"h{k}{l}" for k in range(3) for l in range(3)]


def _system(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(view_id, h.., g0..g2): diagonal blocks and gradient; (i, j, h..): blocks between two views, both ways."""
    ends = [blocks.select(F.col(f"view_{'ab'[s]}").alias("view_id"), *_matrix(s, s), *(F.col("v")[21 + 3 * s + k].alias(f"g{k}") for k in range(3))) for s in (0, 1)]
    own = ends[0].unionByName(ends[1]).groupBy("view_id").agg(*(F.sum(c).alias(c) for c in [*NINE, "g0", "g1", "g2"]))
    ways = [blocks.select(F.col(f"view_{'ab'[s]}").alias("i"), F.col(f"view_{'ab'[1 - s]}").alias("j"), *_matrix(s, 1 - s)) for s in (0, 1)]
    return own, ways[0].unionByName(ways[1]).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in NINE))


def _held(own: DataFrame, opt: AdjustOptions, damp: float = 0.0) -> DataFrame:
    """Diagonal blocks with prior and damping."""
    for k in range(3):
        own = own.withColumn(f"h{k}{k}", (F.col(f"h{k}{k}") + opt.prior_sigma ** -2) * (1 + damp))
    return own


def _times(v: str) -> list[Column]:
    return [F.col(f"h{k}0") * F.col(f"{v}0") + F.col(f"h{k}1") * F.col(f"{v}1") + F.col(f"h{k}2") * F.col(f"{v}2") for k in range(3)]


def _divided(r: list[Column]) -> list[Column]:
    """Solution of a symmetric 3x3 system (columns h..) by its adjugate."""
    h = lambda k, l: F.col(f"h{k}{l}")
    cof = lambda k, l: h((k + 1) % 3, (l + 1) % 3) * h((k + 2) % 3, (l + 2) % 3) - h((k + 1) % 3, (l + 2) % 3) * h((k + 2) % 3, (l + 1) % 3)
    det = h(0, 0) * cof(0, 0) + h(0, 1) * cof(0, 1) + h(0, 2) * cof(0, 2)
    return [(cof(0, k) * r[0] + cof(1, k) * r[1] + cof(2, k) * r[2]) / det for k in range(3)]


def _dot(a: str, b: str) -> Column:
    return F.sum(sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in range(3)), F.lit(0.0)))


def solve_blocks(own: DataFrame, off: DataFrame, rhs: DataFrame, tolerance: float = 1e-11) -> DataFrame:
    """Solve a symmetric positive system of 3x3 blocks for many right sides at once: (rhs, view_id, x0, x1, x2).

    own: view_id, h..; off: i, j, h..; rhs: rhs, view_id, b0, b1, b2 (absent rows are zero). Preconditioned conjugate gradients in the
    form with one reduction a round: the matrix product is a join with the blocks and a grouped sum, a right side spreads over
    the network as its rows come up, and every right side stops on its own. One table is written a round, nothing is collected.
    """
    own, off = stored(own.select("view_id", *NINE)), stored(off)
    vectors = [f"{v}{k}" for v in "xrups" for k in range(3)]
    zero = F.lit(0.0)
    b = [F.col(f"b{k}") for k in range(3)]
    fresh = rhs.join(own, "view_id").select("rhs", "view_id", *(zero.alias(f"x{k}") for k in range(3)), *(c.alias(f"r{k}") for k, c in enumerate(b)),
                                            *(c.alias(f"u{k}") for k, c in enumerate(_divided(b))), *(zero.alias(f"{v}{k}") for v in "ps" for k in range(3)))
    none = F.lit(None).cast("double")
    fresh = fresh.withColumns({"first": none, "gamma": none, "alpha": none, "active": F.lit(True)})

    def with_product(state: DataFrame) -> DataFrame:
        live = state.filter("active").select("rhs", "view_id", "u0", "u1", "u2")
        near = live.join(own, "view_id").select("rhs", "view_id", *(c.alias(f"w{k}") for k, c in enumerate(_times("u"))))
        far = live.withColumnRenamed("view_id", "j").join(off, "j").select("rhs", F.col("i").alias("view_id"), *(c.alias(f"w{k}") for k, c in enumerate(_times("u"))))
        w = near.unionByName(far).groupBy("rhs", "view_id").agg(*(F.sum(f"w{k}").alias(f"w{k}") for k in range(3)))
        return stored(state.join(w, ["rhs", "view_id"], "full").fillna(0.0, [*vectors, "w0", "w1", "w2"]))

    state = with_product(fresh)
    while not is_empty(state.filter("active")):
        now = state.groupBy("rhs").agg(_dot("r", "u").alias("new"), _dot("w", "u").alias("delta"), *(F.max(c).alias(c) for c in ("first", "gamma", "alpha", "active")))
        now = now.withColumn("first", F.coalesce("first", "new"))
        beta = F.coalesce(F.col("new") / F.col("gamma"), zero)
        length = F.col("delta") - F.coalesce(beta * F.col("new") / F.col("alpha"), zero)
        going = F.col("active") & (F.col("new") > tolerance ** 2 * F.col("first")) & (length > 0)
        now = now.select("rhs", "first", going.alias("active"), beta.alias("beta"), F.when(going, F.col("new") / length).alias("alpha"), F.col("new").alias("gamma"))
        new = state.drop("first", "gamma", "alpha", "active").join(now, "rhs").join(own, "view_id")
        p = [F.col(f"u{k}") + F.col("beta") * F.col(f"p{k}") for k in range(3)]
        s = [F.col(f"w{k}") + F.col("beta") * F.col(f"s{k}") for k in range(3)]
        r = [F.when(F.col("active"), F.col(f"r{k}") - F.col("alpha") * s[k]).otherwise(F.col(f"r{k}")) for k in range(3)]
        x = [F.when(F.col("active"), F.col(f"x{k}") + F.col("alpha") * p[k]).otherwise(F.col(f"x{k}")) for k in range(3)]
        columns = {"x": x, "r": r, "u": _divided(r), "p": p, "s": s}
        state = with_product(new.select("rhs", "view_id", *(c.alias(f"{v}{k}") for v, cs in columns.items() for k, c in enumerate(cs)), "first", "gamma", "alpha", "active"))
    return state.select("rhs", "view_id", "x0", "x1", "x2")


def inverse_blocks(own: DataFrame, off: DataFrame, tolerance: float = 1e-11) -> DataFrame:
    """Blocks of the inverse inside every connected part of the network: (view_id, c, h..) with column view ``c``."""
    unit = [own.select(F.struct(F.col("view_id").alias("c"), F.lit(m).alias("m")).alias("rhs"), "view_id", *(F.lit(float(k == m)).alias(f"b{k}") for k in range(3))) for m in range(3)]
    x = solve_blocks(own, off, unit[0].unionByName(unit[1]).unionByName(unit[2]), tolerance)
    return x.groupBy("view_id", F.col("rhs.c").alias("c")).agg(*(F.max(F.when(F.col("rhs.m") == m, F.col(f"x{k}"))).alias(f"h{k}{m}") for k in range(3) for m in range(3)))


def adjust_views(records: DataFrame, opt: AdjustOptions = AdjustOptions(), sigmas: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pointing correction of every view from pair records: (views with angles and sigmas, final blocks).

    Gauss-Newton with damping on the loss itself. Angles, blocks and steps stay tables: blocks are sums per view pair, a step is
    solved by block conjugate gradients, and only sums of one row reach the driver. ``sigmas`` asks for the diagonal of the inverse,
    which costs a right side for every angle; without it the three columns are NULL.
    """
    rec = stored(records.select("view_a", "view_b", *(f"{s}{p}{c}" for s in "ab" for p in "od" for c in "xyz")))
    x = stored(rec.select(F.explode(F.array("view_a", "view_b")).alias("view_id")).distinct().select("view_id", *(F.lit(0.0).alias(c) for c in ANGLES)))

    def at(angles: DataFrame) -> tuple[DataFrame, float, int, int]:
        blocks = stored(normal_blocks(rec, angles, opt))
        held = angles.agg(F.sum(F.col("omega") ** 2 + F.col("phi") ** 2 + F.col("kappa") ** 2)).first()[0] or 0.0
        row = blocks.agg(*(F.sum(F.col("v")[k]) for k in (27, 28, 29))).first()
        return blocks, held / opt.prior_sigma ** 2 + (row[0] or 0.0), int(row[1] or 0), int(row[2] or 0)

    blocks, cost, count, lost = at(x)
    first, damp = cost, 0.0
    for _ in range(opt.iterations):
        own, off = _system(blocks)
        rhs = own.join(x, "view_id").select(F.lit(0).alias("rhs"), "view_id", *((-(F.col(f"g{k}") + F.col(c) / opt.prior_sigma ** 2)).alias(f"b{k}") for k, c in enumerate(ANGLES)))
        step = stored(solve_blocks(_held(own, opt, damp), off, rhs, opt.solver_tolerance))
        trial = stored(x.join(step, "view_id", "left").select("view_id", *((F.col(c) + F.coalesce(f"x{k}", F.lit(0.0))).alias(c) for k, c in enumerate(ANGLES))))
        tb, tc, tn, tl = at(trial)
        if tc <= cost:
            most = step.agg(F.max(F.greatest(*(F.abs(f"x{k}") for k in range(3))))).first()[0] or 0.0
            done = cost - tc <= opt.tolerance * max(cost, 1e-300) or most <= opt.tolerance
            x, blocks, cost, count, lost, damp = trial, tb, tc, tn, tl, damp / 10
            if done:
                break
        else:
            damp = max(1e-3, damp * 10)
    if sigmas:
        own, off = _system(blocks)
        inverse = inverse_blocks(_held(own, opt), off).filter("view_id = c")
        spread = inverse.select("view_id", *(F.sqrt(f"h{k}{k}").alias(f"sigma_{c}") for k, c in enumerate(ANGLES)))
        views = x.join(spread, "view_id", "left")
    else:
        views = x.select("*", *(F.lit(None).cast("double").alias(f"sigma_{c}") for c in ANGLES))
    figures = {"cost_before": float(first), "cost_after": float(cost), "records": count, "lost_records": lost}
    return views.select("*", *(F.lit(v).cast("double" if isinstance(v, float) else "long").alias(k) for k, v in figures.items())), blocks


def _without_pair(batches):
    """Per pair the six numbers whose product with the inverse's columns of both views is the change of all angles."""
    iu = np.triu_indices(6)
    for pdf in batches:
        out = np.zeros((len(pdf), 6))
        get = lambda cols, shape: pdf[cols].to_numpy(float).reshape(-1, *shape)
        aa, ab, bb = (get([f"{p}_{c}" for c in NINE], (3, 3)) for p in ("aa", "ab", "bb"))
        y = np.hstack([get([f"ya{k}" for k in range(3)], (3,)), get([f"yb{k}" for k in range(3)], (3,))])
        for n, v in enumerate(pdf["v"]):
            block = np.zeros((6, 6))
            block[iu] = v[:21]
            block += np.triu(block, 1).T
            g, s = np.asarray(v[21:27]), np.block([[aa[n], ab[n]], [ab[n].T, bb[n]]])
            out[n] = g - block @ np.linalg.solve(np.eye(6) - s @ block, y[n] - s @ g)
        yield pd.DataFrame({"view_a": pdf["view_a"], "view_b": pdf["view_b"], **{f"q{k}": out[:, k] for k in range(6)}})


def leave_one_out(blocks: DataFrame, opt: AdjustOptions = AdjustOptions()) -> DataFrame:
    """Change of the angles when one pair is left out: a rank-6 update of the inverse for every pair; no data is re-read.

    The step is linearised at the blocks' angles and equals a full refit of one step without the pair. Blocks of the inverse come from
    conjugate gradients; a pair meets the columns of its two views in joins. The work is the number of pairs times the views of their
    part of the network, as the change of every view goes into the maximum; nothing is collected. A pair whose removal isolates
    a view is named. view_a and view_b differ; one row per (view_a, view_b).
    """
    blocks = stored(blocks)
    own, off = _system(blocks)
    own = stored(_held(own, opt))
    inverse = stored(inverse_blocks(own, off))
    y = inverse.join(own.select(F.col("view_id").alias("c"), "g0", "g1", "g2"), "c").groupBy("view_id").agg(*(F.sum(c).alias(f"y{k}") for k, c in enumerate(_times("g"))))
    pairs = blocks.select("view_a", "view_b", "v")
    for name, (row, col) in {"aa": ("view_a", "view_a"), "ab": ("view_a", "view_b"), "bb": ("view_b", "view_b")}.items():
        cols = inverse.select(F.col("view_id").alias("_r"), F.col("c").alias("_c"), *(F.col(c).alias(f"{name}_{c}") for c in NINE))
        pairs = pairs.join(cols, (F.col(row) == F.col("_r")) & (F.col(col) == F.col("_c"))).drop("_r", "_c")
    for side in "ab":
        pairs = pairs.join(y.select(F.col("view_id").alias(f"view_{side}"), *(F.col(f"y{k}").alias(f"y{side}{k}") for k in range(3))), f"view_{side}")
    q = stored(pairs.mapInPandas(_without_pair, "view_a string, view_b string, " + ", ".join(f"q{k} double" for k in range(6))))
    moved = [q.select("view_a", "view_b", F.col(f"view_{side}").alias("c"), *(F.col(f"q{k + at}").alias(f"q{k}") for k in range(3))).join(inverse, "c")
             .select("view_a", "view_b", "view_id", *(c.alias(f"d{k}") for k, c in enumerate(_times("q")))) for side, at in (("a", 0), ("b", 3))]
    change = moved[0].unionByName(moved[1]).groupBy("view_a", "view_b", "view_id").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(3)))
    total = own.count()
    most = F.max(F.greatest(*(F.abs(f"d{k}") for k in range(3))))
    square = F.sum(F.col("d0") ** 2 + F.col("d1") ** 2 + F.col("d2") ** 2)
    out = change.groupBy("view_a", "view_b").agg(most.alias("max_change"), F.sqrt(square / (3 * total)).alias("rms_change"))
    degree = blocks.select(F.explode(F.array("view_a", "view_b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d")).filter("d = 1")
    for side in "ab":
        out = out.join(degree.select(F.col("n").alias(f"view_{side}"), F.col("n").alias(f"_lost_{side}")), f"view_{side}", "left")
    return out.select("view_a", "view_b", "max_change", "rms_change", F.concat_ws("|", "_lost_a", "_lost_b").alias("missing_views"))


def spline_blocks(residuals: DataFrame, by: str, column: str, width: float, spacing: float, residual: str = "r", sensitivity: str = "j") -> DataFrame:
    """Normal blocks of column-varying attitude: sums over the (at most four) active controls of every row."""
    b = residuals.withColumn("_b", bspline_basis(F.col(column), width, spacing))
    a = b.select(by, residual, sensitivity, F.col("_b.first").alias("_f"), F.posexplode("_b.weights").alias("_i", "_wi"), F.col("_b.weights").alias("_w"))
    a = a.select(by, (F.col("_f") + F.col("_i")).alias("i"), (F.col("_wi") * F.col(sensitivity)).alias("_ji"), F.col(residual).alias("_r"), "_f", sensitivity, F.posexplode("_w").alias("_k", "_wk"))
    a = a.withColumn("k", F.col("_f") + F.col("_k"))
    return a.filter("k >= i").groupBy(by, "i", "k").agg(F.sum(F.col("_ji") * F.col("_wk") * F.col(sensitivity)).alias("h"),
                                                        F.sum(F.when(F.col("k") == F.col("i"), F.col("_ji") * F.col("_r"))).alias("g"), F.count(F.lit(1)).alias("n"))


def adjust_spline(residuals: DataFrame, by: str, column: str, width: float, spacing: float, smooth: float = 1e-3, gauge: float = 1e-6,
                  maximum_controls: int = 3000) -> DataFrame:
    """Spline controls per view minimising r + j*s(column), with smoothness and gauge priors; NULL support is flagged.

    Each view's small system is solved in its own task (controls = width / spacing + 3).
    """
    count = -(-int(width) // int(spacing)) + 3
    if count > maximum_controls:
        raise ValueError("too many spline controls; use a coarser spacing")
    key = residuals.schema[by].dataType.simpleString()
    blocks = spline_blocks(residuals, by, column, width, spacing)
    packed = blocks.groupBy(by).agg(F.collect_list(F.struct("i", "k", "h", "g", "n")).alias("b"))  # bounded by 4 * controls

    def run(batches):
        d2 = np.diff(np.eye(count), 2, axis=0)
        for pdf in batches:
            out = []
            for v, bs in zip(pdf[by], pdf["b"]):
                h, g, n = smooth * d2.T @ d2 + gauge * np.eye(count), np.zeros(count), np.zeros(count, int)
                for e in bs:
                    h[e["i"], e["k"]] += e["h"]
                    if e["i"] != e["k"]:
                        h[e["k"], e["i"]] += e["h"]
                    else:
                        g[e["i"]] += e["g"]
                        n[e["i"]] += e["n"]
                c = -np.linalg.solve(h, g)
                out += [(v, i, float(c[i]), int(n[i]), bool(n[i] > 0)) for i in range(count)]
            yield pd.DataFrame(out, columns=[by, "control", "value", "support", "supported"])

    return packed.mapInPandas(run, f"{by} {key}, control int, value double, support bigint, supported boolean")
