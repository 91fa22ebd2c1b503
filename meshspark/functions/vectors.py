"""Vector arithmetic on column triples; plain expressions that stay inside generated code."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @staticmethod
    def cols(prefix: str, suffix: str = "") -> "Vec":
        return Vec(*[F.col(f"{prefix}{a}{suffix}") for a in "xyz"])

    @staticmethod
    def of(x, y, z) -> "Vec":
        return Vec(*[F.lit(v) if not isinstance(v, Column) else v for v in (x, y, z)])

    def minus(self, o: "Vec") -> "Vec":
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def plus(self, o: "Vec") -> "Vec":
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def times(self, s) -> "Vec":
        return Vec(self.x * s, self.y * s, self.z * s)

    def over(self, s: Column) -> "Vec":
        return Vec(*[F.try_divide(v, s) for v in self])

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Vec") -> "Vec":
        return Vec(self.y * o.z - self.z * o.y,
                   self.z * o.x - self.x * o.z,
                   self.x * o.y - self.y * o.x)

    def sq(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.sq())

    def unit(self) -> "Vec":
        """Null components for a zero vector."""
        n = self.norm()
        return Vec(*[F.when(n > 0, F.try_divide(v, n)) for v in self])

    def reject(self, axis: "Vec") -> "Vec":
        """Component perpendicular to a unit axis."""
        return self.minus(axis.times(self.dot(axis)))

    def named(self, prefix: str) -> list[Column]:
        return [v.alias(f"{prefix}{a}") for v, a in zip(self, "xyz")]

    def as_array(self) -> Column:
        return F.array(*self)


def add_vec(df, prefix: str, v: Vec):
    return df.withColumns({f"{prefix}{a}": c for a, c in zip("xyz", v)})


def add_unit(df, prefix: str, v: Vec):
    """Add the unit vector of ``v``. The steps become columns of their own: nested in one expression they would
    multiply, because each component repeats the norm."""
    d = add_vec(df, "_s", v).withColumn("_len", Vec.cols("_s").norm())
    n = F.col("_len")
    unit = Vec(*[F.when(n > 0, F.try_divide(c, n)) for c in Vec.cols("_s")])
    return add_vec(d, prefix, unit).drop("_sx", "_sy", "_sz", "_len")


def add_reject(df, prefix: str, v: Vec, axis: Vec):
    """Add the component of ``v`` perpendicular to a unit axis, in separate steps."""
    d = add_vec(df, "_v", v).withColumn("_dot", Vec.cols("_v").dot(axis))
    return add_vec(d, prefix, Vec.cols("_v").minus(axis.times(F.col("_dot")))).drop("_vx", "_vy", "_vz", "_dot")


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def angle_between(u: Vec, v: Vec) -> Column:
    cosine = F.try_divide(u.dot(v), u.norm() * v.norm())
    return F.acos(clip(cosine, -1.0, 1.0))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


COMPASS = ["E", "NE", "N", "NW", "W", "SW", "S", "SE"]  # fixed values


def angle_deg(v: Column, u: Column) -> Column:
    """Angle of the in-plane direction (u, v) in degrees."""
    return F.degrees(F.atan2(v, u))


def compass(angle: Column) -> Column:
    sector = F.floor(F.pmod(angle + 22.5, F.lit(360.0)) / 45.0).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in COMPASS]), F.least(sector, F.lit(7)) + 1)


def linspace(low: float, high: float, n: int, i: Column) -> Column:
    """Value i of n evenly spaced values from low to high (both included)."""
    return F.lit(low) + (i.cast("double") * F.lit(high - low)) / F.lit(float(max(n - 1, 1)))


PI = math.pi
