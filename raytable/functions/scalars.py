"""Scalar functions: content ids, robust kernels, parsing, radiometry, packing, splines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def content_id(prefix: str, **fields: Column) -> Column:
    """prefix + first 16 hex digits of SHA-256 over key-sorted JSON."""
    body = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, 16))


def pair_id(a: Column, b: Column, checked: bool = True) -> Column:
    """Order-free id of two views; equal ids are an error (unless the caller already excludes them)."""
    ordered = F.to_json(F.array(F.least(a, b), F.greatest(a, b)))
    if not checked:
        return F.concat(F.lit("pair:"), ordered)
    return F.when(F.assert_true(a != b, "a pair needs two different views").isNull(), F.concat(F.lit("pair:"), ordered))


def robust_residual(r: Column, loss: str, scale: float) -> Column:
    a, s = F.abs(r), float(scale)
    if loss == "none":
        return r
    if loss == "huber":
        return F.when(a > s, F.signum(r) * F.sqrt(F.greatest(F.lit(0.0), 2 * s * a - s * s))).otherwise(r)
    if loss == "bisquare":
        return F.when(a > s, F.signum(r) * s).otherwise(r)
    if loss == "cauchy":
        return F.signum(r) * s * F.sqrt(F.log1p((r / s) * (r / s)))
    raise ValueError(f"unknown loss {loss!r}")


def robust_derivative(r: Column, loss: str, scale: float) -> Column:
    a, s = F.abs(r), float(scale)
    if loss == "none":
        return F.lit(1.0)
    if loss == "huber":
        return F.when(a > s, s / F.greatest(F.abs(robust_residual(r, loss, scale)), F.lit(EPS))).otherwise(1.0)
    if loss == "bisquare":
        return F.when(a > s, 0.0).otherwise(1.0)
    if loss == "cauchy":
        return F.when(a > EPS, F.try_divide(s * a, (s * s + a * a) * F.sqrt(F.log1p((a / s) * (a / s))))).otherwise(1.0)
    raise ValueError(f"unknown loss {loss!r}")


def huber_weight(r: Column, s: float) -> Column:
    return F.least(F.lit(1.0), F.lit(float(s)) / F.greatest(r, F.lit(EPS)))


def quantized_obs_id(view: Column, row: Column, col: Column, tol: float) -> Column:
    """Observation id of a source pixel rounded (half away from zero) to a tolerance."""
    q = lambda c: F.round(c / F.lit(float(tol))).cast("bigint")
    return content_id("obs-", view=view, r=q(row), c=q(col))


def parse_acquisition(text: Column) -> Column:
    """Strict UTC text (DDMMYY_HHmmSS or DDMMYYYY_HHmmSS, optional fraction); NULL if impossible."""
    rx = r"^(\d{2})(\d{2})(\d{4}|\d{2})_(\d{2})(\d{2})(\d{2})(\.\d+)?$"
    part = lambda i: F.regexp_extract(text, rx, i)
    num = lambda i: F.when(part(i) != "", part(i)).cast("int")
    short = F.length(part(3)) == 2
    year = F.when(short & (num(3) >= 80), num(3) + 1900).when(short, num(3) + 2000).otherwise(num(3))
    days = F.dayofmonth(F.last_day(F.make_date(year, F.least(F.greatest(num(2), F.lit(1)), F.lit(12)), F.lit(1))))
    ok = (text.rlike(rx) & num(2).between(1, 12) & num(1).between(1, days) & (year >= 1)
          & num(4).between(0, 23) & num(5).between(0, 59) & num(6).between(0, 59))
    seconds = F.concat(part(6), part(7)).cast("decimal(16,6)")
    return F.when(ok, F.make_timestamp(year, num(2), num(1), num(4), num(5), seconds))


CLASS_MAXIMUM = {"uint8": 255, "uint16": 65535, "single": 1}


def radiometric_encode(v: Column, scale: float, offset: float, kind: str, policy: str = "clip",
                       fill: float = 0.0) -> Column:
    """Physical value to stored value: normalised to 0..1, clipped (or checked), scaled to the class."""
    if kind not in CLASS_MAXIMUM:
        raise ValueError(f"unsupported output class {kind!r}")
    known = F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(float(fill)))
    unit = (known - F.lit(float(offset))) / F.lit(float(scale))
    stored = F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit))
    if kind != "single":
        stored = F.round(stored * F.lit(float(CLASS_MAXIMUM[kind])))
    if policy == "clip":
        return stored
    if policy == "error":
        fits = (unit >= 0) & (unit <= 1)
        return F.when(F.assert_true(fits, "value outside the radiometric range").isNull(), stored)
    raise ValueError(f"unknown out-of-range policy {policy!r}")


def radiometric_decode(stored: Column, scale: float, offset: float, kind: str) -> Column:
    return stored / F.lit(float(CLASS_MAXIMUM[kind])) * F.lit(float(scale)) + F.lit(float(offset))


def pack_tri(matrix: list[list[Column]]) -> Column:
    """Upper triangle of a symmetric matrix, row by row."""
    n = len(matrix)
    return F.array(*(matrix[i][j] for i in range(n) for j in range(i, n)))


def unpack_tri(packed: Column, n: int) -> list[list[Column]]:
    index = {}
    k = 0
    for i in range(n):
        for j in range(i, n):
            index[i, j] = index[j, i] = k
            k += 1
    return [[packed[index[i, j]] for j in range(n)] for i in range(n)]


def bspline_basis(col: Column, width: float, spacing: float) -> Column:
    """Cubic uniform B-spline weights: struct(first control index, array of four non-zero weights)."""
    segments = max(1, -(-int(width) // int(spacing)))
    u = F.greatest(F.lit(0.0), F.least(F.lit(float(width)), col)) / F.lit(float(spacing))
    k = F.least(F.floor(u), F.lit(segments - 1)).cast("bigint")
    t = u - k
    w = [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6,
         (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]
    return F.struct(k.alias("first"), F.array(*w).alias("weights"))


def improvement_fraction(before: Column, after: Column) -> Column:
    return F.when(before > EPS, (before - after) / before)


def confidence_class(n: Column, corr: Column, spread: Column) -> Column:
    return (F.when((n < 2) | corr.isNull() | (corr < 0.08) | (spread > 0.01), "low")
            .when((corr < 0.15) | (spread > 0.003), "moderate")
            .otherwise("high"))


def sum_of(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def round6(c: Column) -> Column:
    """Six decimals without negative zero."""
    return F.round(c, 6) + F.lit(0.0)
