"""Three-vectors as column triples. Everything stays a Catalyst expression."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @staticmethod
    def cols(x: str, y: str, z: str) -> "Vec":
        return Vec(F.col(x), F.col(y), F.col(z))

    @staticmethod
    def prefixed(prefix: str) -> "Vec":
        return Vec.cols(f"{prefix}x", f"{prefix}y", f"{prefix}z")

    @staticmethod
    def field(name: str) -> "Vec":
        return Vec.cols(f"{name}.x", f"{name}.y", f"{name}.z")

    @staticmethod
    def lit(x: float, y: float, z: float) -> "Vec":
        return Vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    def __add__(self, o):  # type: ignore[override]
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o):
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def scale(self, s) -> "Vec":
        return Vec(self.x * s, self.y * s, self.z * s)

    def div(self, s) -> "Vec":
        return Vec(*(F.try_divide(v, s) for v in self))

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Vec") -> "Vec":
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> "Vec":
        return self.div(self.norm())

    def finite(self) -> Column:
        ok = F.lit(True)
        for v in self:
            ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        return ok

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def with_vec(df, name: str, vec: Vec):
    """Store a vector as a struct column so later expressions reference it instead of repeating it."""
    return df.withColumn(name, vec.struct())


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def acos_degrees(c: Column) -> Column:
    return F.degrees(F.acos(clamp(c, -1.0, 1.0)))
