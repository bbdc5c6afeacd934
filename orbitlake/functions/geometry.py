"""Vectors, angles and dihedrals as column expressions; points are lists of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def vector(prefix: str) -> Vector:
    return [F.col(f"{prefix}{c}") for c in "xyz"]


def minus(a: Vector, b: Vector) -> Vector:
    return [p - q for p, q in zip(a, b)]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Vector, b: Vector, c: Vector) -> Column:
    """Angle at b, in radians; null if an arm has no length."""
    u, v = minus(a, b), minus(c, b)
    size = norm(u) * norm(v)
    return F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / size))))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Torsion about b-c, in radians, from -pi to pi."""
    p, q, r = minus(b, a), minus(c, b), minus(d, c)
    m, n = cross(p, q), cross(q, r)
    return F.atan2(norm(q) * dot(p, n), dot(m, n))


def rotate(v: Vector, axis: tuple[float, float, float], radians: float) -> Vector:
    """Rotation about an axis through the origin; an axis without length leaves the vector as it is."""
    import math

    size = math.sqrt(sum(x * x for x in axis))
    if size < 1e-15:
        return v
    k = [F.lit(x / size) for x in axis]
    s, c = math.sin(radians), math.cos(radians)
    w, along = cross(k, v), dot(k, v)
    return [v[n] * c + w[n] * s + k[n] * along * (1 - c) for n in range(3)]
