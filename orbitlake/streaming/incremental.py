"""Radial distribution and mean squared displacement of streams of frames.

Pair counts, sizes and volumes of frames add up, so that the distribution needs no more state than a row for each bin. The
displacement needs the first place of each particle, which is held as state by particle and never expires.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rdf_counts(pairs: DataFrame, n_bins: int, r_max: float, r_min: float = 0.0) -> DataFrame:
    """bin, n_r of all pairs so far: run it in update or complete mode. pairs: a stream with dist_sq; coincident points do not count."""
    if n_bins < 1 or not 0 <= r_min < r_max:
        raise ValueError("n_bins >= 1 and 0 <= r_min < r_max are needed")
    width = (r_max - r_min) / n_bins
    near = pairs.where((F.col("dist_sq") > 0) & (F.col("dist_sq") >= r_min * r_min) & (F.col("dist_sq") < r_max * r_max))
    return near.select(F.floor((F.sqrt("dist_sq") - r_min) / width).cast("int").alias("bin")).where(F.col("bin") < n_bins).groupBy("bin").agg(F.count("*").alias("n_r"))


def frame_sizes(frames: DataFrame) -> DataFrame:
    """One row: n_frames, sum_n, sum_volume so far. frames: a stream with n (particles) and volume for each frame."""
    return frames.groupBy().agg(F.count("*").alias("n_frames"), F.sum("n").alias("sum_n"), F.sum("volume").alias("sum_volume"))


def rdf(counts: DataFrame, sizes: DataFrame, n_bins: int, r_max: float, r_min: float = 0.0) -> DataFrame:
    """bin, r, n_r, g of what the two streams have written: tables of the latest counts and sizes. Bins without pairs have 0."""
    width = (r_max - r_min) / n_bins
    low = F.col("bin") * width + r_min
    shell = 4.0 / 3.0 * math.pi * (F.pow(low + width, F.lit(3.0)) - F.pow(low, F.lit(3.0)))
    n, v = F.col("sum_n") / F.col("n_frames"), F.col("sum_volume") / F.col("n_frames")
    bins = counts.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    return bins.crossJoin(F.broadcast(sizes)).select("bin", (low + width / 2).alias("r"), "n_r", (2 * F.col("n_r") / (n / v * shell * n * F.col("n_frames"))).alias("g"))


def displacements(stream: DataFrame) -> DataFrame:
    """particle, step, sq: squared distance of each row from the place of the particle at its lowest step so far, for a stream of particle, step, x, y, z.

    The rows of a particle within a batch are taken in the order of their steps; the first that ever arrives is the reference.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("step")
        first = state.get if state.exists else tuple(float(v) for v in rows.iloc[0][["x", "y", "z"]])
        state.update(first)
        sq = sum((rows[c] - v) ** 2 for c, v in zip("xyz", first))
        yield pd.DataFrame({"particle": key[0], "step": rows["step"].astype("int64"), "sq": sq})

    return stream.groupBy("particle").applyInPandasWithState(run, "particle long, step long, sq double", "x double, y double, z double", "append", GroupStateTimeout.NoTimeout)


def msd(found: DataFrame) -> DataFrame:
    """step, msd of the displacements that were written."""
    return found.groupBy("step").agg(F.avg("sq").alias("msd"))
