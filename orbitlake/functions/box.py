"""Simulation boxes as column expressions.

A box is a 3x3 matrix whose columns are the lattice vectors (h11 .. h33), an origin (o1 .. o3) and periodic flags
(p1 .. p3). Position = origin + H * fractional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

H = [f"h{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)]
O = ["o1", "o2", "o3"]  # noqa: E741
P = ["p1", "p2", "p3"]
I = [f"i{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)]  # noqa: E741
BOX = [*H, *O, *P]


def boxes(frames: DataFrame) -> DataFrame:
    """frame_id, the box columns, the determinant and the inverse (i11 .. i33), one row for each frame that has a box; repeated rows count once. A singular box is none."""
    one = frames.where("box_h is not null").groupBy("frame_id").agg(F.min(F.struct("box_h", "box_origin", "box_pbc")).alias("b"))
    cols = [F.col("b.box_h")[r][c].alias(f"h{r + 1}{c + 1}") for r in range(3) for c in range(3)]
    cols += [F.coalesce(F.col("b.box_origin")[k], F.lit(0.0)).alias(f"o{k + 1}") for k in range(3)]
    cols += [F.coalesce(F.col("b.box_pbc")[k], F.lit(False)).alias(f"p{k + 1}") for k in range(3)]
    one = one.select("frame_id", *cols).withColumn("det", determinant()).where(F.abs("det") > 1e-12)
    return one.select("frame_id", *BOX, "det", *[_inverse(r, c).alias(f"i{r}{c}") for r in (1, 2, 3) for c in (1, 2, 3)])


def _h(r: int, c: int) -> Column:
    return F.col(f"h{r}{c}")


def determinant() -> Column:
    return _h(1, 1) * (_h(2, 2) * _h(3, 3) - _h(2, 3) * _h(3, 2)) - _h(1, 2) * (_h(2, 1) * _h(3, 3) - _h(2, 3) * _h(3, 1)) + _h(1, 3) * (_h(2, 1) * _h(3, 2) - _h(2, 2) * _h(3, 1))


def volume() -> Column:
    return F.abs("det")


def inverse(r: int, c: int) -> Column:
    return F.col(f"i{r}{c}")


def _inverse(r: int, c: int) -> Column:
    rows, cols = [k for k in (1, 2, 3) if k != c], [k for k in (1, 2, 3) if k != r]
    minor = _h(rows[0], cols[0]) * _h(rows[1], cols[1]) - _h(rows[0], cols[1]) * _h(rows[1], cols[0])
    return (minor if (r + c) % 2 == 0 else -minor) / F.col("det")


def fractional(x: Column, y: Column, z: Column) -> list[Column]:
    """Fractional coordinates of a position, not wrapped."""
    d = [x - F.col("o1"), y - F.col("o2"), z - F.col("o3")]
    return [inverse(r, 1) * d[0] + inverse(r, 2) * d[1] + inverse(r, 3) * d[2] for r in (1, 2, 3)]


def cartesian(f: list[Column], origin: bool = True) -> list[Column]:
    out = [_h(r, 1) * f[0] + _h(r, 2) * f[1] + _h(r, 3) * f[2] for r in (1, 2, 3)]
    return [F.col(o) + v for o, v in zip(O, out)] if origin else out


def wrapped(f: list[Column]) -> list[Column]:
    """Fractional coordinates moved into [0, 1) on the periodic axes."""
    return [F.when(F.col(p), v - F.floor(v)).otherwise(v) for p, v in zip(P, f)]


def nearest(d: list[Column]) -> list[Column]:
    """Fractional differences of the nearest image: halves are rounded away from zero."""
    return [F.when(F.col(p), v - F.signum(v) * F.floor(F.abs(v) + 0.5)).otherwise(v) for p, v in zip(P, d)]


def inside(f: list[Column]) -> Column:
    """Whether 0 <= fractional < 1 on all axes, periodic or not."""
    return (f[0] >= 0) & (f[0] < 1) & (f[1] >= 0) & (f[1] < 1) & (f[2] >= 0) & (f[2] < 1)


def lengths() -> list[Column]:
    return [F.sqrt(_h(1, c) * _h(1, c) + _h(2, c) * _h(2, c) + _h(3, c) * _h(3, c)) for c in (1, 2, 3)]


def plane_distances() -> list[Column]:
    """Distance between opposite faces: the reciprocal of the length of a row of the inverse."""
    return [1.0 / F.sqrt(inverse(r, 1) * inverse(r, 1) + inverse(r, 2) * inverse(r, 2) + inverse(r, 3) * inverse(r, 3)) for r in (1, 2, 3)]
