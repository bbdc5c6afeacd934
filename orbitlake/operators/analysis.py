"""Analyses of frames: radial distribution, mean squared displacement, and moments of groups of atoms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.functions import box as B
from orbitlake.functions.elements import mass
from orbitlake.operators.components import components
from orbitlake.operators.skew import hot_keys, lookup, numbered
from orbitlake.runtime import Scratch


def rdf_counts(spark, pairs: DataFrame, n_bins: int, r_max: float, r_min: float = 0.0) -> DataFrame:
    """bin, n_r: pairs with r_min <= d < r_max by distance; coincident points do not count. Every bin has a row."""
    if n_bins < 1 or not 0 <= r_min < r_max:
        raise ValueError("n_bins >= 1 and 0 <= r_min < r_max are needed")
    width = (r_max - r_min) / n_bins
    binned = pairs.where((F.col("dist_sq") > 0) & (F.col("dist_sq") >= r_min * r_min) & (F.col("dist_sq") < r_max * r_max)).select(F.floor((F.sqrt("dist_sq") - r_min) / width).cast("int").alias("bin"))
    counts = binned.where(F.col("bin") < n_bins).groupBy("bin").agg(F.count("*").alias("n_r"))
    return spark.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n_r", F.lit(0).cast("long")).alias("n_r"))


def rdf(spark, pairs: DataFrame, sizes: DataFrame, n_bins: int, r_max: float, r_min: float = 0.0, volume: float | None = None) -> DataFrame:
    """bin, r, n_r, g. sizes has a row for each frame: n (self) or n_a and n_b (cross), and volume unless one is given.

    Self pairs: g = 2 n_r / (rho v_shell n n_frames) with rho = n / V of the mean frame; cross pairs: n_r / (n_a n_b v_shell / V n_frames).
    """
    cross = "n_a" in sizes.columns
    v = F.lit(float(volume)) if volume else F.avg("volume")
    means = [F.avg("n_a").alias("n_a"), F.avg("n_b").alias("n_b")] if cross else [F.avg("n").alias("n")]
    total = sizes.agg(*means, v.alias("v"), F.count("*").alias("n_frames"))
    width = (r_max - r_min) / n_bins
    low = F.col("bin") * width + r_min
    high = low + width
    shell = 4.0 / 3.0 * math.pi * (high * high * high - low * low * low)
    ideal = F.col("n_a") * F.col("n_b") * shell / F.col("v") * F.col("n_frames") if cross else F.col("n") / F.col("v") * shell * F.col("n") * F.col("n_frames") / 2
    return rdf_counts(spark, pairs, n_bins, r_max, r_min).join(F.broadcast(total)).select("bin", ((low + high) / 2).alias("r"), "n_r", (F.col("n_r") / ideal).alias("g"))


def msd(trajectory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(step, particle, sq) and (step, msd) against step 0, without unwrapping. trajectory: step, particle, x, y, z."""
    first = trajectory.where("step = 0").select("particle", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"))
    d = [F.col(c) - F.col(f"{c}0") for c in "xyz"]
    each = trajectory.join(first, "particle").select("step", "particle", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("sq"))
    return each, each.groupBy("step").agg(F.avg("sq").alias("msd"))


def squares(moved: DataFrame) -> DataFrame:
    """Adds sq, the squared distance between x, y, z and x0, y0, z0; nothing is unwrapped."""
    return moved.withColumn("sq", sum(((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "xyz"), F.lit(0.0)))


def clusters(pairs: DataFrame, pts: DataFrame, scratch: Scratch, min_size: int = 1) -> DataFrame:
    """frame_id, id, cluster_id: components of the neighbour graph, numbered from 0 by their lowest atom; -1 in clusters under min_size."""
    roots = components(pairs.select(F.col("frame_id").alias("scope"), F.col("i").alias("u"), F.col("j").alias("v")), scratch)
    of = pts.select("frame_id", "id").join(roots.select(F.col("scope").alias("frame_id"), F.col("node").alias("id"), "root"), ["frame_id", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    of = scratch.put(of)
    heads = of.groupBy("frame_id", "root").agg(F.min("id").alias("low"), F.count("*").alias("size")).where(F.col("size") >= min_size)
    heads = numbered(heads, "frame_id", ["low"], "cluster_id", scratch).select("frame_id", "root", "cluster_id")
    hot, _ = hot_keys(of, ["frame_id", "root"], scratch)
    return lookup(of, heads, ["frame_id", "root"], hot).select("frame_id", "id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def relative(pts: DataFrame, groups: list[str], boxes: DataFrame) -> DataFrame:
    """Points with ux, uy, uz, their nearest-image displacement from the first member (lowest id) of the group, its position x0 .. z0, and m, the mass."""
    first = pts.groupBy(*groups).agg(F.min(F.struct("id", "x", "y", "z")).alias("r")).select(*groups, *[F.col(f"r.{c}").alias(f"{c}0") for c in "xyz"])
    all_ = pts.join(first, groups).join(boxes, "frame_id", "left")
    d = [F.col(c) - F.col(f"{c}0") for c in "xyz"]
    f = [B.inverse(r, 1) * d[0] + B.inverse(r, 2) * d[1] + B.inverse(r, 3) * d[2] for r in (1, 2, 3)]
    u = B.cartesian(B.nearest(f), origin=False)
    boxed = F.col("h11").isNotNull()
    return all_.select(*groups, "id", "x0", "y0", "z0", *[F.when(boxed, u[k]).otherwise(d[k]).alias(f"u{c}") for k, c in enumerate("xyz")], mass(F.col("element")).alias("m"))


def group_moments(rel: DataFrame, groups: list[str]) -> DataFrame:
    """One row for each group: n, mass, centre (cx ..), centre of mass (mx ..), radius of gyration rg, and the gyration (gxx ..) and inertia (ixx ..) tensors.

    All come from one aggregation of products, about the first member, that is shifted to the centres afterwards.
    """
    u = {c: F.col(f"u{c}") for c in "xyz"}
    sums = [F.count("*").alias("n"), F.sum("m").alias("mass"), *[F.first(f"{c}0").alias(f"{c}0") for c in "xyz"]]
    sums += [F.sum(u[c]).alias(f"s{c}") for c in "xyz"] + [F.sum(u[c] * F.col("m")).alias(f"w{c}") for c in "xyz"]
    two = ["xx", "yy", "zz", "xy", "xz", "yz"]
    sums += [F.sum(u[a] * u[b]).alias(f"s{a}{b}") for a, b in two] + [F.sum(u[a] * u[b] * F.col("m")).alias(f"w{a}{b}") for a, b in two]
    g = rel.groupBy(*groups).agg(*sums)
    n, m = F.col("n"), F.col("mass")
    cov = {ab: F.col(f"w{ab}") - F.col(f"w{ab[0]}") * F.col(f"w{ab[1]}") / m for ab in two}
    trace = cov["xx"] + cov["yy"] + cov["zz"]
    return g.select(
        *groups, "n", "mass", *[(F.col(f"{c}0") + F.col(f"s{c}") / n).alias(f"c{c}") for c in "xyz"], *[(F.col(f"{c}0") + F.col(f"w{c}") / m).alias(f"m{c}") for c in "xyz"],
        F.sqrt(F.greatest(trace, F.lit(0.0)) / m).alias("rg"), *[(F.col(f"s{ab}") / n - F.col(f"s{ab[0]}") * F.col(f"s{ab[1]}") / n / n).alias(f"g{ab}") for ab in two],
        *[(trace - cov[ab] if ab[0] == ab[1] else -cov[ab]).alias(f"i{ab}") for ab in two],
    )


def pca(rows: DataFrame, vector: str, key: str, n: int = 2) -> DataFrame:
    """key, pc1 .. pcn: z-scored columns projected on the first eigenvectors of their covariance; the sign makes each vector's sum >= 0.

    At least 3 rows, and no constant column. Only the k x k sums go to the driver.
    """
    k = rows.select(F.max(F.size(vector))).first()[0]
    v = [F.col(vector)[a].cast("double") for a in range(k)]
    flat = rows.select(key, *[x.alias(f"v{a}") for a, x in enumerate(v)])
    stats = flat.agg(F.count("*").alias("n"), *[F.avg(f"v{a}").alias(f"a{a}") for a in range(k)], *[F.stddev_samp(f"v{a}").alias(f"s{a}") for a in range(k)]).first()
    if stats["n"] < 3 or any(not stats[f"s{a}"] > 1e-12 for a in range(k)):
        raise ValueError("at least 3 rows and no constant column are needed")
    z = [(F.col(f"v{a}") - stats[f"a{a}"]) / stats[f"s{a}"] for a in range(k)]
    scaled = flat.select(key, F.array(*z).alias("z"))
    parts = scaled.mapInPandas(_outer(k), ", ".join(["a int", "row array<double>"]))
    covariance = np.zeros((k, k))
    for r in parts.groupBy("a").agg(*[F.sum(F.col("row")[b]).alias(f"b{b}") for b in range(k)]).collect():
        covariance[r["a"]] = [r[f"b{b}"] for b in range(k)]
    values, vectors = np.linalg.eigh(covariance / (stats["n"] - 1))
    out = [key]
    for c in range(n):
        w = vectors[:, np.argsort(-values)[c]]
        w = w if w.sum() >= 0 else -w
        out.append(F.aggregate(F.zip_with("z", F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias(f"pc{c + 1}"))
    return scaled.select(*out)


def _outer(k: int):
    def run(batches):
        import pandas as pd

        total = np.zeros((k, k))
        for b in batches:
            if len(b):
                m = np.array(b["z"].tolist())
                total += m.T @ m
        yield pd.DataFrame({"a": range(k), "row": total.tolist()}).astype({"a": "int32"})

    return run


def assign(rows: DataFrame, key: str, cols: list[str], centroids: list[list[float]]) -> DataFrame:
    """key, cols, label, of the nearest centroid; ties go to the lowest label."""
    best = F.array_min(F.array(*[F.struct(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(cols, m)), F.lit(0.0)).alias("d"), F.lit(k).alias("label")) for k, m in enumerate(centroids)]))
    return rows.withColumn("label", best["label"]).select(key, *cols, "label")


def spread_starts(rows: DataFrame, key: str, cols: list[str], k: int, seed: int) -> list[list[float]]:
    """k starting centroids: each is drawn with a chance in proportion to the squared distance from those before it, the first evenly.

    The draw keeps the row with the greatest u ** (1 / weight), u being a hash of seed, draw and key, so that it is one aggregation and the same
    for the same seed, however rows are spread. Fewer different rows than k give fewer centroids.
    """
    out: list[list[float]] = []
    for n in range(k):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), F.col(key)), F.lit(1 << 52)) + 1) / float(1 << 52)
        near = F.least(*[sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(cols, m)), F.lit(0.0)) for m in out], F.lit(float("inf"))) if out else F.lit(1.0)
        best = rows.select(near.alias("w"), u.alias("u"), *cols).where("w > 0").agg(F.max(F.struct((F.log("u") / F.col("w")).alias("s"), *cols)).alias("b")).first()["b"]
        if best is None:
            break
        out.append([float(best[c]) for c in cols])
    return out


def kmeans(rows: DataFrame, key: str, cols: list[str], centroids: list[list[float]], rounds: int = 100) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's iteration from given centroids until they move less than 1e-8 together; an empty cluster keeps its centroid."""
    for _ in range(rounds):
        got = {r["label"]: [r[f"m{c}"] for c in cols] for r in assign(rows, key, cols, centroids).groupBy("label").agg(*[F.avg(c).alias(f"m{c}") for c in cols]).collect()}
        new = [got.get(k, m) for k, m in enumerate(centroids)]
        moved = sum((a - b) ** 2 for m, w in zip(centroids, new) for a, b in zip(m, w))
        centroids = new
        if moved < 1e-16:
            break
    return assign(rows, key, cols, centroids), centroids
