"""Descriptor matching: exhaustive nearest two, in bounded blocks, without emitting pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raytable.runtime import materialize

BLOCK = 2048
CHUNK = 65536  # rows whose exact distances are taken at a time


def _blocks(df: DataFrame, by: list[str], id_col: str, vector: str, tag: str) -> DataFrame:
    """Fixed-size blocks of descriptors per key, however large the key is."""
    df = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    n = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_nb")) if by else df.agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_nb"))
    d = df.join(n, by) if by else df.crossJoin(F.broadcast(n))  # one-row count
    d = d.withColumn(f"_blk_{tag}", F.pmod(F.xxhash64(id_col), F.col("_nb")))
    row = F.struct(F.col(id_col).alias("i"), F.col(vector).alias("v"))  # as stored; distances are taken in double precision
    return d.groupBy(*by, f"_blk_{tag}").agg(F.array_sort(F.collect_list(row)).alias(f"_{tag}"), F.max("_nb").alias(f"_n{tag}"))


def _facing(blocks: DataFrame, other: DataFrame, by: list[str], tag: str, other_tag: str) -> DataFrame:
    """Each block once for every block of the other side of its key, named by number, so that blocks meet in an equi-join."""
    n = other.groupBy(*by).agg(F.max(f"_n{other_tag}").alias("_n")) if by else other.agg(F.max(f"_n{other_tag}").alias("_n")).filter("_n is not null")
    d = blocks.join(n, by) if by else blocks.crossJoin(F.broadcast(n))  # one-row count
    return d.select(*by, f"_blk_{tag}", f"_{tag}", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)).alias(f"_blk_{other_tag}"))


def _closest(va: np.ndarray, vb: np.ndarray, k: int):
    """(row of va, row of vb, squared distance) of the k nearest rows of vb, exact, ties to the smaller row.

    The matrix product only screens: every row within its rounding error of the k-th smallest product value gets its exact
    distance. Of equal rows of vb the first k can be an answer; the others are left out beforehand.
    """
    _, group = np.unique(vb, axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    sorted_group = group.ravel()[order]
    copy = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
    keep = np.sort(order[copy < k])
    vb = vb[keep]
    na, nb = (va ** 2).sum(1), (vb ** 2).sum(1)
    gram = na[:, None] + nb[None, :] - 2 * va @ vb.T
    k = min(k, len(keep))
    slack = 8 * (va.shape[1] + 4) * np.finfo(float).eps * (na + nb.max())
    row, col = np.nonzero(gram <= (np.partition(gram, k - 1, axis=1)[:, k - 1] + slack)[:, None])
    d2 = np.concatenate([((va[row[i:i + CHUNK]] - vb[col[i:i + CHUNK]]) ** 2).sum(1) for i in range(0, len(row), CHUNK)] or [np.empty(0)])
    order = np.lexsort((col, d2, row))
    row, col, d2 = row[order], col[order], d2[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], keep[col[first]], d2[first]


def _nearest_two(by: list[str]):
    def run(batches):
        for pdf in batches:
            frames = []
            for k in range(len(pdf)):
                left, right = pdf["_a"].iloc[k], pdf["_b"].iloc[k]
                ia, ib = np.array([r["i"] for r in left]), np.array([r["i"] for r in right])
                va, vb = np.array([r["v"] for r in left], float), np.array([r["v"] for r in right], float)
                head = {c: pdf[c].iloc[k] for c in by}
                i, j, d2 = _closest(va, vb, 2)
                frames.append(pd.DataFrame({**head, "a": ia[i], "b": ib[j], "d2": d2, "rev": False}))
                j, i, d2 = _closest(vb, va, 1)
                frames.append(pd.DataFrame({**head, "a": ia[i], "b": ib[j], "d2": d2, "rev": True}))
            yield pd.concat(frames) if frames else pd.DataFrame(columns=[*by, "a", "b", "d2", "rev"])

    return run


def match_descriptors(a: DataFrame, b: DataFrame, by: list[str], id_col: str, vector: str, max_ratio: float = 0.8,
                      unique: bool = True) -> DataFrame:
    """Nearest neighbour of every ``a`` in ``b`` within a key, kept if clearly better than the second and mutual.

    Each block of ``a`` meets each block of ``b`` once as a matrix product in a task; only the two nearest rows per
    descriptor leave the task, by exact distance and then id, and are merged by min aggregates. Of equal descriptors the
    smallest id is the nearest and another copy the second. Rows without id or vector match nothing.
    """
    left, right = materialize(_blocks(a, by, id_col, vector, "a")), materialize(_blocks(b, by, id_col, vector, "b"))
    meet = _facing(left, right, by, "a", "b").join(_facing(right, left, by, "b", "a"), [*by, "_blk_a", "_blk_b"])
    key = a.schema[id_col].dataType.simpleString()
    heads = "".join(f"`{c}` {a.schema[c].dataType.simpleString()}, " for c in by)
    near = materialize(meet.select(*by, "_a", "_b").mapInPandas(_nearest_two(by), f"{heads}a {key}, b {key}, d2 double, rev boolean"))
    fwd = near.filter("not rev")
    best = fwd.groupBy(*by, "a").agg(F.min(F.struct("d2", "b")).alias("m"))
    second = fwd.join(best.select(*by, "a", F.col("m.b").alias("_b1")), by + ["a"]).filter("b <> _b1").groupBy(*by, "a").agg(F.min("d2").alias("d2nd"))
    out = best.join(second, by + ["a"], "left").select(*by, "a", F.col("m.b").alias("b"), F.sqrt("m.d2").alias("distance"), F.sqrt("d2nd").alias("second"))
    out = out.filter(F.col("second").isNull() | (F.col("distance") <= max_ratio * F.col("second")))
    if unique:
        back = near.filter("rev").groupBy(*by, "b").agg(F.min(F.struct("d2", "a")).alias("m")).select(*by, "b", F.col("m.a").alias("a"))
        out = out.join(back, by + ["a", "b"], "left_semi")
    return out.select(*by, F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"), "distance", "second")
