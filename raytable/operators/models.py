"""Sensor models as tables: rational polynomials, node grids, fits, inversion and covariance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raytable.runtime import is_empty, materialize, stored

from .quantiles import median_mad


def exponents(degree: int = 3) -> list[tuple[int, int, int]]:
    """Monomial exponents up to a total degree: the third coordinate varies slowest."""
    return [(i, j, k) for k in range(degree + 1) for j in range(degree + 1) for i in range(degree + 1) if i + j + k <= degree]


# fixed values: coefficient order of the common 20-term exchange format (powers of the three coordinates)
EXCHANGE_ORDER = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2),
                  (1, 1, 1), (3, 0, 0), (1, 2, 0), (1, 0, 2), (2, 1, 0), (0, 3, 0), (0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 3)]


def reorder_coeffs(coeffs: Column, to_exchange: bool = False) -> Column:
    """Permute 20 coefficients between the exchange order and the degree-3 order of :func:`exponents`."""
    here, there = exponents(3), EXCHANGE_ORDER
    src, dst = (here, there) if to_exchange else (there, here)
    return F.array(*(F.get(coeffs, F.lit(src.index(e))) for e in dst))


def _power(c: Column, n: int) -> Column | None:
    out = None
    for _ in range(n):
        out = c if out is None else out * c
    return out


def monomials(x: Column, y: Column, z: Column, exps) -> list[Column]:
    rows = []
    for i, j, k in exps:
        term = None
        for c, n in ((x, i), (y, j), (z, k)):
            p = _power(c, n)
            if p is not None:
                term = p if term is None else term * p
        rows.append(F.lit(1.0) if term is None else term)
    return rows


def polynomial(df: DataFrame, coeffs: str, x: str, y: str, z: str, out: str, exps) -> DataFrame:
    terms = monomials(F.col(x), F.col(y), F.col(z), exps)
    return df.withColumn(out, sum((F.get(F.col(coeffs), F.lit(i)) * t for i, t in enumerate(terms)), F.lit(0.0)))


def normalize(df: DataFrame, columns: dict[str, tuple[str, str, str]]) -> DataFrame:
    """name -> (value, offset column, scale column): value scaled to about +-1."""
    for name, (v, off, sc) in columns.items():
        df = df.withColumn(name, (F.col(v) - F.col(off)) / F.col(sc))
    return df


def denormalize(df: DataFrame, columns: dict[str, tuple[str, str, str]]) -> DataFrame:
    for name, (v, off, sc) in columns.items():
        df = df.withColumn(name, F.col(v) * F.col(sc) + F.col(off))
    return df


def inside_domain(*normalized: str) -> Column:
    ok = F.lit(True)
    for n in normalized:
        ok = ok & F.col(n).between(-1, 1)
    return ok


def rational_project(points: DataFrame, models: DataFrame, x: str = "x", y: str = "y", z: str = "z", by: str = "model_id") -> DataFrame:
    """Row and column of normalised ground points through two cubic ratios of the joined model (rn, rd, cn, cd)."""
    df = points.join(models.select(by, "rn", "rd", "cn", "cd"), by)
    terms = monomials(F.col(x), F.col(y), F.col(z), exponents(3))
    # monomials once, shared by the four polynomials
    df = df.withColumns({f"_t{i}": t for i, t in enumerate(terms)})
    dot = lambda c: sum((F.get(F.col(c), F.lit(i)) * F.col(f"_t{i}") for i in range(len(terms))), F.lit(0.0))
    df = df.withColumns({"_" + c: dot(c) for c in ("rn", "rd", "cn", "cd")}).drop(*(f"_t{i}" for i in range(len(terms))))
    return (df.withColumn("row", F.try_divide(F.col("_rn"), F.col("_rd"))).withColumn("col", F.try_divide(F.col("_cn"), F.col("_cd")))
            .drop("_rn", "_rd", "_cn", "_cd", "rn", "rd", "cn", "cd"))


def model_domain(corners: DataFrame, by: str = "model_id") -> DataFrame:
    """Ground box, offsets and scales from the eight projected image corners; one failed corner fails the model."""
    g = corners.groupBy(by).agg(F.count(F.lit(1)).alias("corners"), F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).alias("ok"),
                                *(f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))))
    for c in "xyz":
        g = g.withColumn(f"{c}_offset", F.when(F.col("ok"), (F.col(f"{c}_low") + F.col(f"{c}_high")) / 2))
        g = g.withColumn(f"{c}_scale", F.when(F.col("ok"), F.greatest((F.col(f"{c}_high") - F.col(f"{c}_low")) / 2, F.lit(2.220446049250313e-16))))
    return g


def sample_lattice(domain: DataFrame, n: tuple[int, int, int]) -> DataFrame:
    """Evenly spaced rows x cols x heights per model (domain: row_low/high, col_low/high, z_low/high)."""
    out = domain
    for name, k in zip(("row", "col", "z"), n):
        out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        out = out.withColumn(name, F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col("_i") / F.lit(float(max(k - 1, 1)))).drop("_i")
    return out


# --- node grids ------------------------------------------------------------------------------------

def node_cells(nodes: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row per grid cell with its eight corner nodes (i, j, k indexed), built by one aggregation."""
    send = F.array(*(F.struct(F.lit(f"n{a}{b}{c}").alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                     for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    s = nodes.select(*by, "i", "j", "k", F.struct(*values).alias("_v"), F.explode(send).alias("_o"))
    s = s.select(*by, *((F.col(p) - F.col(f"_o.{q}")).alias(p) for p, q in zip("ijk", "abc")), F.col("_o.n").alias("_n"), "_v")
    names = [f"n{a}{b}{c}" for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    g = s.groupBy(*by, "i", "j", "k").agg(*(F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in names))
    full = F.lit(True)
    for n in names:
        full = full & F.col(n).isNotNull()
    return g.filter(full)


def grid_project(points: DataFrame, cells: DataFrame, by: list[str], low: tuple[float, float, float], step: tuple[float, float, float],
                 count: tuple[int, int, int], values: list[str]) -> DataFrame:
    """Trilinear node-grid projection by one equi-join with the cell table; NULL outside."""
    df, inside = points, F.lit(True)
    for c, p, lo, st, n in zip("xyz", "ijk", low, step, count):
        u = (F.col(c) - lo) / st
        inside = inside & u.between(0, n - 1)
        df = df.withColumn("_u" + p, u)
    for p, n in zip("ijk", count):
        df = df.withColumn("_" + p, F.when(inside, F.least(F.floor("_u" + p), F.lit(n - 2)).cast("bigint")))
        df = df.withColumn("_f" + p, F.col("_u" + p) - F.col("_" + p))
    cell = cells.select(*by, *(F.col(p).alias("_" + p) for p in "ijk"), *(c for c in cells.columns if c.startswith("n") and len(c) == 4))
    df = df.join(cell, by + ["_i", "_j", "_k"], "left")
    w = lambda bit, p: F.col("_f" + p) if bit else 1 - F.col("_f" + p)
    for v in values:
        total = sum((w(a, "i") * w(b, "j") * w(c, "k") * F.col(f"n{a}{b}{c}.{v}") for a in (0, 1) for b in (0, 1) for c in (0, 1)), F.lit(0.0))
        df = df.withColumn(v, total)
    return df.drop(*(q + p for p in "ijk" for q in ("_", "_u", "_f")), *(f"n{a}{b}{c}" for a in (0, 1) for b in (0, 1) for c in (0, 1)))


def refine_grid(models: DataFrame, by: str, project, low, high, start=(5, 5, 3), tolerance: float = 0.1, cap: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """Double the node density of every model until its cell-centre error meets the tolerance or the node cap stops it.

    ``models`` has one row per model, ``project(points, models)`` adds row and col to points with ``by``, x, y, z. Models that
    meet the tolerance leave; a round refines all others at once, so there are as many rounds as the cap allows doublings,
    whatever the number of models. Returns (nodes of every model's last grid, report with one row per model and
    round). ``state`` is refining, converged or nodeLimit; a model with a centre that projects nowhere stays open until the limit.
    """
    n, rounds, nodes_out, log = tuple(start), 0, None, None
    open_models = stored(models)
    while True:
        step = tuple((h - l) / (k - 1) for l, h, k in zip(low, high, n))
        last = (2 * n[0] - 1) * (2 * n[1] - 1) * (2 * n[2] - 1) > cap
        nodes = stored(project(_lattice(open_models.select(by), low, step, n), open_models))
        seen = project(_centre_means(nodes, by, low, step, n), open_models)
        err = F.hypot(F.col("row") - F.col("_row"), F.col("col") - F.col("_col"))
        e = seen.groupBy(by).agg(F.max(err).alias("max_error"), F.sqrt(F.avg(err * err)).alias("rms_error"), F.count_if(err.isNull()).alias("_void"))
        met = (F.col("_void") == 0) & (F.col("max_error") <= tolerance)
        e = stored(e.select(by, F.lit(rounds).alias("round"), *(F.lit(k).alias(c) for c, k in zip(("ni", "nj", "nk"), n)), "max_error", "rms_error",
                            F.when(F.coalesce(met, F.lit(False)), "converged").otherwise("nodeLimit" if last else "refining").alias("state")))
        log = e if log is None else log.unionByName(e)
        going = e.filter("state = 'refining'").select(by)
        ended = nodes.join(e.filter("state <> 'refining'").select(by), by, "left_semi")
        nodes_out = ended if nodes_out is None else nodes_out.unionByName(ended)
        open_models = stored(open_models.join(going, by, "left_semi"))
        if last or is_empty(open_models):
            return nodes_out, log
        n, rounds = tuple(2 * k - 1 for k in n), rounds + 1


def _centre_means(nodes: DataFrame, by: str, low, step, n) -> DataFrame:
    """Every cell centre with the mean of its eight corners. Lines along i move as arrays, whose length the node limit bounds,
    and only four of them meet in a line of cells."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("i", "row", "col"))), lambda v: F.struct(v["row"].alias("row"), v["col"].alias("col")))
    pair = lambda i, c: F.get("_v", i)[c] + F.get("_v", i + 1)[c]
    lines = nodes.groupBy(by, "k", "j").agg(line.alias("_v")).select(
        by, "k", "j", F.transform(F.sequence(F.lit(0), F.lit(n[0] - 2)), lambda i: F.struct(*(pair(i, c).alias(c) for c in ("row", "col")))).alias("_p"))
    to = F.array(*(F.struct((F.col("k") - a).alias("k"), (F.col("j") - b).alias("j")) for a in (0, 1) for b in (0, 1)))
    cells = lines.select(by, "_p", F.explode(to).alias("_c")).filter((F.col("_c.k").between(0, n[2] - 2)) & F.col("_c.j").between(0, n[1] - 2))
    cells = cells.groupBy(by, F.col("_c.k").alias("k"), F.col("_c.j").alias("j")).agg(F.collect_list("_p").alias("_q"))
    mean = lambda i, c: sum((F.get(F.get("_q", F.lit(q)), i)[c] for q in range(4)), F.lit(0.0)) / 8
    means = F.transform(F.sequence(F.lit(0), F.lit(n[0] - 2)), lambda i: F.struct(mean(i, "row").alias("row"), mean(i, "col").alias("col")))
    # the array of means, not the four lines, is taken apart, so no cell carries its lines along
    cells = cells.select(by, "k", "j", means.alias("_m")).select(by, "k", "j", F.posexplode("_m").alias("i", "_s"))
    at = [(F.lit(float(lo)) + (F.col(p) + 0.5) * float(s)).alias(c) for c, p, lo, s in zip("xyz", "ijk", low, step)]
    return cells.select(by, *at, F.col("_s.row").alias("_row"), F.col("_s.col").alias("_col"))


def _lattice(keys: DataFrame, low, step, n) -> DataFrame:
    """The same lattice for every key, layer by layer over the tasks; a stated number of them, as the few layers would be merged into one."""
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda c, k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias(c)
    r = keys.select("*", each("k", n[2])).repartition(tasks, *keys.columns, "k").select("*", each("j", n[1])).select("*", each("i", n[0]))
    return r.select(*keys.columns, "i", "j", "k", *((F.lit(float(lo)) + F.col(p) * float(s)).alias(c) for c, p, lo, s in zip("xyz", "ijk", low, step)))


# --- fits ------------------------------------------------------------------------------------------------

def _terms(pdf: pd.DataFrame, exps) -> np.ndarray:
    x, y, z = (np.asarray(pdf[c], float) for c in "xyz")
    return np.stack([x ** i * y ** j * z ** k for i, j, k in exps], axis=1)


def _packed(samples: DataFrame, by: str) -> DataFrame:
    """Samples of a model in a batch as one row of arrays x, y, z and t, stored: a model's coefficients then meet a row per pack, not per sample."""
    def run(batches):
        for pdf in batches:
            rows = [(m, *(g[c].to_numpy(float) for c in "xyzt")) for m, g in pdf.groupby(by, sort=False)]
            yield pd.DataFrame(rows, columns=[by, *"xyzt"])

    key = samples.schema[by].dataType.simpleString()
    return stored(samples.mapInPandas(run, f"{by} {key}, " + ", ".join(f"{c} array<double>" for c in "xyzt")))


def _added(part: DataFrame, by: str) -> DataFrame:
    """Arrays ``v`` added up per model by position, so a model of any size stays distributed."""
    flat = part.select(by, F.posexplode("v").alias("p", "s")).groupBy(by, "p").agg(F.sum("s").alias("s"))
    return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda e: e["s"]).alias("v"))


def normal_sums(samples: DataFrame, by: str, design, rhs: list[str], extra: list[str], size: int) -> DataFrame:
    """Per model: packed normal matrix and right sides. Batches add up their rows in numpy; Spark adds the batches by
    position, so a model of any size stays distributed. ``design(pdf)`` returns (matrix, weights, right sides)."""
    key = samples.schema[by].dataType.simpleString()
    iu = np.triu_indices(size)

    def run(batches):
        for pdf in batches:
            for m, g in pdf.groupby(by, sort=False):
                a, w, y = design(g)
                n = (a * w[:, None]).T @ a
                b = (a * w[:, None]).T @ y
                yield pd.DataFrame({by: [m], "v": [np.concatenate([n[iu], b.ravel(), [len(g)]])]})

    part = samples.select(by, "x", "y", "z", *rhs, *extra).mapInPandas(run, f"{by} {key}, v array<double>")
    return _added(part, by)


def _solve_packed(v, size: int, k: int, ridge: float) -> np.ndarray:
    v = np.asarray(v, float)
    half = size * (size + 1) // 2
    n = np.zeros((size, size))
    n[np.triu_indices(size)] = v[:half]
    n = n + np.triu(n, 1).T
    return np.linalg.solve(n + ridge * np.eye(size), v[half:half + size * k].reshape(size, k))


def fit_rational(samples: DataFrame, by: str, target: str, robust_passes: int = 3, huber: float = 1.5, ridge: float = 1e-12) -> DataFrame:
    """Cubic ratio per model: numerator a(20), denominator b(20, b0 = 1), rms and max error, smallest |denominator|."""
    exps = EXCHANGE_ORDER
    key = samples.schema[by].dataType.simpleString()
    data = _packed(samples.select(by, "x", "y", "z", F.col(target).cast("double").alias("t")), by)
    iu = np.triu_indices(39)
    coef, stats = None, None
    for k in range(robust_passes + 1):
        cur = data if coef is None else data.join(coef, by).join(stats, by)

        def add_up(batches):
            for pdf in batches:
                sums: dict = {}
                for row in pdf.itertuples(index=False):
                    t, y = _terms(row._asdict(), exps), np.asarray(row.t, float)
                    w = np.ones(len(y))
                    if "a" in pdf:
                        zc = np.abs((t @ np.asarray(row.a, float)) / (t @ np.asarray(row.b, float)) - y) / (huber * (1.4826 * row.mad + 2.220446049250313e-16))
                        w = np.where(zc > 1, 1 / np.maximum(zc, 1e-300), 1.0)
                    a = np.hstack([t, -y[:, None] * t[:, 1:]])
                    aw = (a * w[:, None]).T
                    v = np.concatenate([(aw @ a)[iu], aw @ y, [len(y)]])
                    sums[row[0]] = sums[row[0]] + v if row[0] in sums else v
                yield pd.DataFrame({by: list(sums), "v": list(sums.values())})

        sums = _added(cur.mapInPandas(add_up, f"{by} {key}, v array<double>"), by)

        def solve(batches):
            for pdf in batches:
                z = [_solve_packed(v, 39, 1, ridge)[:, 0] for v in pdf["v"]]
                yield pd.DataFrame({by: pdf[by], "a": [q[:20].tolist() for q in z], "b": [[1.0, *q[20:].tolist()] for q in z]})

        coef = stored(sums.mapInPandas(solve, f"{by} {key}, a array<double>, b array<double>"))

        def errors(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    t = _terms(row._asdict(), exps)
                    den = t @ np.asarray(row.b, float)
                    yield pd.DataFrame({by: [row[0]] * len(den), "e": t @ np.asarray(row.a, float) / den - np.asarray(row.t, float), "den": np.abs(den)})

        res = stored(data.join(coef, by).mapInPandas(errors, f"{by} {key}, e double, den double"))
        if k < robust_passes:  # the last residuals weigh nothing
            stats = stored(median_mad(res, [by], F.col("e")).select(by, "mad"))
    report = res.groupBy(by).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"), F.max(F.abs("e")).alias("max_error"), F.min("den").alias("min_denominator"))
    return coef.join(report, by)


def fit_linear(samples: DataFrame, by: str, targets: list[str], degree: int = 2, ridge: float = 1e-12) -> DataFrame:
    """Least-squares polynomials of a degree per model, one coefficient array per target."""
    exps = exponents(degree)
    key = samples.schema[by].dataType.simpleString()
    size = len(exps)

    def design(g):
        return _terms(g, exps), np.ones(len(g)), g[targets].to_numpy(float)

    def solve(batches):
        for pdf in batches:
            z = [_solve_packed(v, size, len(targets), ridge) for v in pdf["v"]]
            yield pd.DataFrame({by: pdf[by], **{f"c_{t}": [q[:, i].tolist() for q in z] for i, t in enumerate(targets)}})

    sums = normal_sums(samples, by, design, targets, [], size)
    return sums.mapInPandas(solve, f"{by} {key}, " + ", ".join(f"c_{t} array<double>" for t in targets))


def covariance_field(df: DataFrame, xx: str, xy: str, yy: str) -> DataFrame:
    """Positive part of a fitted 2x2 covariance: negative eigenvalues are set to zero."""
    a, b, d = F.col(xx), F.col(xy), F.col(yy)
    half, diff = (a + d) / 2, (a - d) / 2
    root = F.sqrt(diff * diff + b * b)
    hi, lo = F.greatest(half + root, F.lit(0.0)), F.greatest(half - root, F.lit(0.0))
    # spectral form: mean of the clamped pair plus its spread along the original deviator
    m, s = (hi + lo) / 2, F.coalesce(F.try_divide((hi - lo) / 2, root), F.lit(0.0))
    return df.withColumn("c_xx", m + s * diff).withColumn("c_xy", s * b).withColumn("c_yy", m - s * diff)


# --- covariance -------------------------------------------------------------------------------------------

def propagate_cov(j: list[list[Column]], c: list[list[Column]], k: list[list[Column]] | None = None) -> list[list[Column]]:
    """J C K' as expressions (K = J unless given: the cross-location form)."""
    k = k or j
    n = len(c)
    add = lambda xs: sum(xs[1:], xs[0])
    jc = [[add([j[r][p] * c[p][q] for p in range(n)]) for q in range(n)] for r in range(len(j))]
    return [[add([jc[r][q] * k[s][q] for q in range(n)]) for s in range(len(k))] for r in range(len(j))]


def condition_cov(c, floor: float = 1e-12) -> tuple[np.ndarray, int]:
    """Driver-side 6x6 conditioning: eigenvalues raised to floor * max(|largest|, 1); returns the matrix and the raised count."""
    c = np.asarray(c, float)
    c = np.diag(c) if c.ndim == 1 else (c + c.T) / 2
    d, v = np.linalg.eigh(c)
    up = np.maximum(d, floor * max(np.abs(d).max(), 1.0))
    return (v * up) @ v.T, int((up != d).sum())


def reduced_basis(jacobians: DataFrame, c, keep: float = 0.999, maximum: int = 6) -> tuple[np.ndarray, float]:
    """Directions of the pose covariance holding ``keep`` of the image response; only a 6x6 Gram matrix reaches the driver.

    jacobians: columns r0..r5 (row) and c0..c5 (column derivatives).
    """
    g = jacobians.agg(*((F.sum(F.col(f"r{i}") * F.col(f"r{j}")) + F.sum(F.col(f"c{i}") * F.col(f"c{j}"))).alias(f"g{i}{j}")
                        for i in range(6) for j in range(i, 6))).first()
    gram = np.array([[g[f"g{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)], float)
    d, v = np.linalg.eigh((np.asarray(c, float) + np.asarray(c, float).T) / 2)
    root = v * np.sqrt(np.maximum(d, 0))
    energy, w = np.linalg.eigh(root.T @ gram @ root)
    energy, w = np.maximum(energy[::-1], 0), w[:, ::-1]
    if energy.sum() <= 2.220446049250313e-16:
        raise ValueError("the pose covariance has no observable image response")
    k = min(int(np.searchsorted(np.cumsum(energy) / energy.sum(), keep) + 1), maximum, 6)
    return root @ w[:, :k], float(energy[:k].sum() / energy.sum())


def mc_covariance(df: DataFrame, id_col: str, jacobian: list[list[str]], root: np.ndarray, n: int, seed: int) -> DataFrame:
    """Population covariance of the image response over seeded draws, drawn and reduced inside each Arrow batch.

    The response is linear in the draws, so only their own moments are taken row by row. Rows are dealt by id: the draws take far
    longer than the scan, whose files may be few.
    """
    cols = [c for row in jacobian for c in row]
    key = df.schema[id_col].dataType.simpleString()
    size = len(jacobian[0])

    def run(batches):
        z, ones = np.empty((n, size)), np.ones(n)
        for pdf in batches:
            j = pdf[cols].to_numpy(float).reshape(len(pdf), len(jacobian), size) @ root
            moments = np.empty((len(pdf), size, size))
            for i, rid in enumerate(pdf["_seed"].to_list()):
                np.random.default_rng([seed, rid & 0x7FFFFFFFFFFFFFFF]).standard_normal(out=z)
                total = ones @ z
                moments[i] = z.T @ z - np.outer(total, total / n)
            o = (j @ (moments / n) @ j.transpose(0, 2, 1))[:, *np.triu_indices(len(jacobian))]
            yield pd.DataFrame({id_col: pdf[id_col], "mc_rr": o[:, 0], "mc_rc": o[:, 1], "mc_cc": o[:, 2]})

    dealt = df.select(id_col, *cols, F.xxhash64(id_col).alias("_seed")).repartition(id_col)
    return dealt.mapInPandas(run, f"{id_col} {key}, mc_rr double, mc_rc double, mc_cc double")


def invert_projection(pixels: DataFrame, models: DataFrame, by: str = "model_id", id_col: str = "record_id", steps: int = 15, tolerance: float = 1e-7) -> DataFrame:
    """Ground position (normalised x, y) of a pixel at height z by Newton steps, vectorised over Arrow batches.

    pixels: by, id, row, col, z. Rows of one batch share their models' coefficients; no group is gathered.
    """
    df = pixels.select(id_col, by, "row", "col", "z").join(models.select(by, "rn", "rd", "cn", "cd"), by)
    exps = exponents(3)
    types = {c: df.schema[c].dataType.simpleString() for c in (id_col, by)}
    h = 2e-6

    def run(batches):
        for pdf in batches:
            co = {c: np.stack(pdf[c].to_list()) for c in ("rn", "rd", "cn", "cd")}
            z, want = pdf["z"].to_numpy(float), pdf[["row", "col"]].to_numpy(float)
            x, y = np.zeros(len(pdf)), np.zeros(len(pdf))

            def image(x, y):
                t = np.stack([x ** i * y ** j * z ** k for i, j, k in exps], axis=1)
                with np.errstate(all="ignore"):
                    return np.stack([(t * co["rn"]).sum(1) / (t * co["rd"]).sum(1), (t * co["cn"]).sum(1) / (t * co["cd"]).sum(1)], axis=1)

            err = np.full(len(pdf), np.inf)
            for _ in range(steps):
                q = image(x, y)
                r = want - q
                err = np.linalg.norm(r, axis=1)
                todo = err >= tolerance
                if not todo.any():
                    break
                j1, j2 = (image(x + h, y) - q) / h, (image(x, y + h) - q) / h
                det = j1[:, 0] * j2[:, 1] - j2[:, 0] * j1[:, 1]
                with np.errstate(all="ignore"):
                    dx, dy = (j2[:, 1] * r[:, 0] - j2[:, 0] * r[:, 1]) / det, (j1[:, 0] * r[:, 1] - j1[:, 1] * r[:, 0]) / det
                go = todo & np.isfinite(dx) & np.isfinite(dy)
                x, y = np.where(go, x + dx, x), np.where(go, y + dy, y)
            err = np.linalg.norm(want - image(x, y), axis=1)
            yield pd.DataFrame({id_col: pdf[id_col], by: pdf[by], "x": x, "y": y, "converged": err < 10 * tolerance})

    return df.mapInPandas(run, f"{id_col} {types[id_col]}, {by} {types[by]}, x double, y double, converged boolean")


def audit_model(projected: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Held-out error per model (row/col against true_row/true_col) and the pass flag."""
    e = F.hypot(F.col("row") - F.col("true_row"), F.col("col") - F.col("true_col"))
    return projected.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(e * e)).alias("rms"), F.max(e).alias("max_error")).withColumn(
        "passed", F.col("max_error") <= tolerance)
