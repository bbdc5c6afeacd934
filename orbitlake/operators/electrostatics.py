"""Long-range electrostatics of periodic frames by particle-mesh summation.

The direct part is a neighbour join with the complementary error function; the reciprocal part spreads charges on a mesh by
cardinal B-splines and solves there. Spreading is a sum by mesh point, so that frames of any size are summed by many tasks;
only the mesh of a frame, whose size is a parameter, is taken as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.functions import box as B

#: Fixed value: energy of two elementary charges one angstrom apart, in kcal/mol.
COULOMB = 332.0637128


def erfc(x: Column) -> Column:
    """The complementary error function, in Arrow batches."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(math.erfc, na_action="ignore")

    return run(x)


def spline(order: int, u: float) -> np.ndarray:
    """The cardinal B-spline of an order at u, u + 1, .., u + order - 1, for u in [0, 1): weights that add up to 1."""
    w = np.zeros(order)
    w[0], w[1] = u, 1 - u
    for n in range(3, order + 1):
        w[n - 1] = 0.0
        new = np.zeros(order)
        for k in range(n):
            new[k] = ((u + k) * w[k] + (n - u - k) * (w[k - 1] if k else 0.0)) / (n - 1)
        w = new
    return w


def moduli(n: int, order: int) -> np.ndarray:
    """Squared lengths of the Fourier sums of the spline over n mesh points; zeros are replaced by the mean of their neighbours."""
    at = spline(order, 0.0)
    k = np.arange(n)
    b = sum(at[j] * np.exp(2j * np.pi * k * j / n) for j in range(1, order))
    out = np.abs(b) ** 2
    for i in np.where(out < 1e-7)[0]:
        out[i] = (out[i - 1] + out[(i + 1) % n]) / 2
    return out


def self_energy(charges: DataFrame, alpha: float) -> DataFrame:
    return charges.groupBy("frame_id").agg((F.lit(-COULOMB * alpha / math.sqrt(math.pi)) * F.sum(F.col("q") * F.col("q"))).alias("energy"))


def direct_energy(pairs: DataFrame, charges: DataFrame, alpha: float, excluded: DataFrame | None = None) -> DataFrame:
    """Of pairs (frame_id, i, j, dist_sq) within the cutoff that are not excluded (frame_id, i, j). Coincident pairs do not count."""
    key = ["frame_id", "i", "j"]
    left = pairs.where("dist_sq > 0").select(*key, "dist_sq")
    left = left.join(excluded.select(*key).distinct(), key, "left_anti") if excluded is not None else left
    r = F.sqrt("dist_sq")
    rows = _charged(left, charges)
    return rows.withColumn("e", F.lit(COULOMB) * F.col("qi") * F.col("qj") * erfc(F.lit(alpha) * r) / r).groupBy("frame_id").agg(F.sum("e").alias("energy"))


def exclusion_energy(excluded: DataFrame, charges: DataFrame, alpha: float) -> DataFrame:
    """What the mesh counts for excluded pairs (frame_id, i, j, dist_sq), taken off again."""
    r = F.sqrt("dist_sq")
    rows = _charged(excluded.where("dist_sq > 0"), charges)
    return rows.withColumn("e", F.lit(-COULOMB) * F.col("qi") * F.col("qj") * (1 - erfc(F.lit(alpha) * r)) / r).groupBy("frame_id").agg(F.sum("e").alias("energy"))


def _charged(rows: DataFrame, charges: DataFrame) -> DataFrame:
    for e in "ij":
        rows = rows.join(charges.select("frame_id", F.col("id").alias(e), F.col("q").alias(f"q{e}")), ["frame_id", e])
    return rows


def mesh(charges: DataFrame, boxes: DataFrame, n: tuple[int, int, int], order: int = 4) -> DataFrame:
    """frame_id, k (index of the mesh point, the last axis fastest), q: the charges spread on the mesh."""
    at = charges.join(boxes, "frame_id")
    f = B.fractional(F.col("x"), F.col("y"), F.col("z"))
    at = at.select("frame_id", "q", *[((v - F.floor(v)) * m).alias(f"u{a}") for a, (v, m) in enumerate(zip(f, n))])

    def spread(batches):
        for b in batches:
            if not len(b):
                continue
            keys, frames, parts = [], [], []
            base, weights = [], []
            for a in range(3):
                u = b[f"u{a}"].to_numpy()
                low = np.floor(u).astype(int)
                weights.append(np.array([spline(order, x) for x in u - low]))
                base.append((low[:, None] - np.arange(order)[None, :]) % n[a])
            q = b["q"].to_numpy()
            for i in range(order):
                for j in range(order):
                    for k in range(order):
                        keys.append((base[0][:, i] * n[1] + base[1][:, j]) * n[2] + base[2][:, k])
                        frames.append(b["frame_id"].to_numpy())
                        parts.append(q * weights[0][:, i] * weights[1][:, j] * weights[2][:, k])
            out = pd.DataFrame({"frame_id": np.concatenate(frames), "k": np.concatenate(keys), "q": np.concatenate(parts)})
            yield out.groupby(["frame_id", "k"], as_index=False)["q"].sum()

    return at.mapInPandas(spread, "frame_id long, k long, q double").groupBy("frame_id", "k").agg(F.sum("q").alias("q"))


def reciprocal_energy(charges: DataFrame, boxes: DataFrame, alpha: float, n: tuple[int, int, int] = (32, 32, 32), order: int = 4) -> DataFrame:
    """frame_id, energy of the mesh. One task takes one mesh of n points, whatever the number of atoms."""
    cols = [*B.H]
    points = mesh(charges, boxes, n, order).join(boxes.select("frame_id", *cols), "frame_id")
    b = [moduli(m, order) for m in n]

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        h = g[cols].iloc[0].to_numpy(dtype=float).reshape(3, 3)
        volume = abs(np.linalg.det(h))
        grid = np.zeros(n[0] * n[1] * n[2])
        grid[g["k"].to_numpy()] = g["q"].to_numpy()
        s = np.abs(np.fft.fftn(grid.reshape(n))) ** 2
        inverse = np.linalg.inv(h)
        m = np.meshgrid(*[np.fft.fftfreq(x, 1 / x) for x in n], indexing="ij")
        waves = sum(m[a][..., None] * inverse[a] for a in range(3))
        m2 = (waves**2).sum(-1)
        m2[0, 0, 0] = 1.0
        c = np.exp(-((np.pi / alpha) ** 2) * m2) / m2 / (b[0][:, None, None] * b[1][None, :, None] * b[2][None, None, :])
        c[0, 0, 0] = 0.0
        return pd.DataFrame({"frame_id": [key[0]], "energy": [COULOMB * float((c * s).sum()) / (2 * np.pi * volume)]})

    return points.groupBy("frame_id").applyInPandas(solve, "frame_id long, energy double")


def pme_energy(charges: DataFrame, boxes: DataFrame, pairs: DataFrame, alpha: float, n: tuple[int, int, int] = (32, 32, 32), order: int = 4, excluded: DataFrame | None = None) -> DataFrame:
    """frame_id, energy of frames with a box: self, direct, excluded and reciprocal parts together. charges: frame_id, id, x, y, z, q; excluded has dist_sq too."""
    parts = [self_energy(charges.join(boxes.select("frame_id"), "frame_id", "left_semi"), alpha), direct_energy(pairs, charges, alpha, excluded), reciprocal_energy(charges, boxes, alpha, n, order)]
    if excluded is not None:
        parts.append(exclusion_energy(excluded, charges, alpha))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("frame_id").agg(F.sum("energy").alias("energy"))
