"""Regions of space as boolean columns, with their bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Bounds = list[tuple[float, float]]


class Region:
    def contains(self, x: Column, y: Column, z: Column) -> Column:
        raise NotImplementedError

    def bounds(self) -> Bounds:
        raise NotImplementedError

    def __and__(self, other: Region) -> Region:
        return _Both(self, other)

    def __or__(self, other: Region) -> Region:
        return _Either(self, other)

    def __invert__(self) -> Region:
        return _Outside(self)


@dataclass(frozen=True)
class Sphere(Region):
    """d <= radius."""

    centre: tuple[float, float, float]
    radius: float

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        return _square(self.centre, x, y, z) <= self.radius * self.radius

    def bounds(self) -> Bounds:
        return [(c - self.radius, c + self.radius) for c in self.centre]


@dataclass(frozen=True)
class Shell(Region):
    """inner < d <= outer."""

    centre: tuple[float, float, float]
    inner: float
    outer: float

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        d = _square(self.centre, x, y, z)
        return (d > self.inner * self.inner) & (d <= self.outer * self.outer)

    def bounds(self) -> Bounds:
        return [(c - self.outer, c + self.outer) for c in self.centre]


@dataclass(frozen=True)
class _Both(Region):
    a: Region
    b: Region

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        return self.a.contains(x, y, z) & self.b.contains(x, y, z)

    def bounds(self) -> Bounds:
        return [(max(p[0], q[0]), min(p[1], q[1])) for p, q in zip(self.a.bounds(), self.b.bounds())]


@dataclass(frozen=True)
class _Either(Region):
    a: Region
    b: Region

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        return self.a.contains(x, y, z) | self.b.contains(x, y, z)

    def bounds(self) -> Bounds:
        return [(min(p[0], q[0]), max(p[1], q[1])) for p, q in zip(self.a.bounds(), self.b.bounds())]


@dataclass(frozen=True)
class _Outside(Region):
    """The rest of space; its bounds are those of the operand."""

    a: Region

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        return ~self.a.contains(x, y, z)

    def bounds(self) -> Bounds:
        return self.a.bounds()


def _square(c: tuple[float, float, float], x: Column, y: Column, z: Column) -> Column:
    d = [v - F.lit(float(k)) for v, k in zip((x, y, z), c)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
