"""Problem 6: filling containers of fixed capacity, by pattern packing with non-negative least squares.

Sizes are put into bins; patterns of a few bins that fill a container are enumerated, and their repeat counts are
fitted to the histogram by non-negative least squares and rounded down. What is left of the histogram is packed by best
fit, again on counts. Only the plan is made on the driver: its size depends on the number of bins, never on the items.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.runtime import Scratch

#: Bins of a capacity; an item counts with the upper edge of its bin in the plan.
BINS = 512
#: Most items of a pattern that is enumerated.
DEPTH = 3
#: Parts into which each bin is split, so that no task numbers a whole bin.
PARTS = 64


def patterns(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of one to ``depth`` bins (1-based, descending) whose sum is the container, or one bin in 128 less at most."""
    slack = max(1, bins // 128)
    out: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int, most: int) -> None:
        if chosen and left <= slack:
            out.append(chosen)
        if len(chosen) < depth:
            low = max(1, left - slack) if len(chosen) == depth - 1 else 1
            for b in range(min(most, left), low - 1, -1):
                grow((*chosen, b), left - b, b)

    grow((), bins, bins)
    return out


def fit(histogram: np.ndarray, shapes: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|^2, weighted by bin, by accelerated projected gradient.

    Column k of A holds the bins of pattern k. It is never built: A x is a weighted count, and the transposed product a lookup.
    """
    n = len(histogram)
    at = np.array([[*(b - 1 for b in s), *[n] * (DEPTH - len(s))][:DEPTH] for s in shapes])
    scale = max(float(histogram.max()), 1.0)
    weight = np.append(np.sqrt(np.arange(1, n + 1) / n), 0.0)
    h = np.append(histogram / scale, 0.0) * weight

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(at.ravel(), weights=np.repeat(x, DEPTH), minlength=n + 1) * weight

    def back(r: np.ndarray) -> np.ndarray:
        return (r * weight)[at].sum(axis=1)

    v = np.ones(len(shapes))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = np.zeros(len(shapes))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        z = np.maximum(0.0, y - step * back(forward(y) - h))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / t2 * (z - x), z, t2
    return x * scale


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, number of containers) covering the histogram exactly: fitted patterns first, then best fit of the residual.

    Fractions of repeat counts are carried on to the next pattern, so that rounding keeps their sum.
    """
    bins = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        shapes = patterns(bins, depth)
        counts = fit(left.astype(float), shapes)
        carried = 0.0
        for k in np.lexsort((np.arange(len(shapes)), -counts)):
            carried += counts[k]
            need = Counter(shapes[k])
            n = min([int(carried), *(int(left[b - 1]) // m for b, m in need.items())])
            if n > 0:
                carried -= n
                for b, m in need.items():
                    left[b - 1] -= n * m
                out.append((shapes[k], n))
    while left.sum():
        top = int(np.nonzero(left)[0][-1]) + 1
        room, chosen = bins - top, [top]
        used = left.copy()
        used[top - 1] -= 1
        while room > 0:
            fits = np.nonzero(used[:room])[0]
            if not len(fits):
                break
            b = int(fits[-1]) + 1
            chosen.append(b)
            used[b - 1] -= 1
            room -= b
        need = Counter(chosen)
        n = min(int(left[b - 1]) // m for b, m in need.items())
        for b, m in need.items():
            left[b - 1] -= n * m
        out.append((tuple(chosen), n))
    return out


def pieces(sized: DataFrame, capacities: DataFrame) -> DataFrame:
    """pack_code, capacity, doc_id, piece_no, first_token, n_tokens: whole texts, and cuts of those that alone exceed the capacity.

    A text of n > capacity tokens gives full pieces and one rest. An empty text is one piece of 0 tokens.
    """
    caps = F.broadcast(capacities.select("pack_code", F.col("capacity_tokens").cast("long").alias("capacity")))
    n, c = F.col("n_tokens"), F.col("capacity")
    count = F.greatest(F.ceil(n / c), F.lit(1))
    each = F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("piece_no")
    return sized.crossJoin(caps).select("pack_code", "capacity", "doc_id", "n_tokens", each).select("pack_code", "capacity", "doc_id", "piece_no", (F.col("piece_no") * c).alias("first_token"), F.least(c, n - F.col("piece_no") * c).alias("n_tokens"))


def pack(sized: DataFrame, capacities: DataFrame, scratch: Scratch) -> DataFrame:
    """pack_code, container_id, slot, doc_id, piece_no, first_token, n_tokens: every piece in exactly one container of each capacity.

    sized: doc_id (unique) and n_tokens; capacities: a few rows pack_code, capacity_tokens. Full pieces have a container of
    their own, pieces of 0 tokens share container 0 with no room taken. Containers are numbered from 1, without gaps for each
    pack_code: planned ones first, then the full ones.
    """
    part = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(PARTS)).cast("int")
    width = F.ceil(F.col("capacity") / F.lit(BINS))
    cut = pieces(sized, capacities).withColumn("bin", F.when(F.col("n_tokens") == F.col("capacity"), -1).otherwise(F.ceil(F.col("n_tokens") / width)).cast("int")).withColumn("part", part)
    cut = scratch.put(cut)
    counts = [tuple(r) for r in cut.where("n_tokens > 0").groupBy("pack_code", "capacity", "bin", "part").count().collect()]
    sizes: dict[tuple[str, int], dict[int, int]] = defaultdict(lambda: defaultdict(int))
    offsets, total = [], defaultdict(int)
    for code, capacity, b, p, n in sorted(counts):
        offsets.append((code, b, p, total[code, b]))
        total[code, b] += n
        sizes[code, capacity][b] += n
    segments = []
    for (code, capacity), by in sorted(sizes.items()):
        bins = capacity // -(-capacity // BINS)
        histogram = np.zeros(bins, dtype=np.int64)
        over = 0
        for b, n in by.items():
            if b == -1:
                over = n
            elif b <= bins:
                histogram[b - 1] += n
        loose = sum(n for b, n in by.items() if b > bins)
        number, taken = 1, defaultdict(int)
        for shape, n in plan(histogram):
            for slot, b in enumerate(shape):
                segments.append((code, b, taken[b], taken[b] + n, number, slot))
                taken[b] += n
            number += n
        if loose:
            segments.append((code, bins + 1, 0, loose, number, 0))
            number += loose
        if over:
            segments.append((code, -1, 0, over, number, 0))
    spark = sized.sparkSession
    where = spark.createDataFrame(pd.DataFrame(offsets, columns=["pack_code", "bin", "part", "before"]).astype({"bin": "int32", "part": "int32"}) if offsets else [], "pack_code string, bin int, part int, before long")
    planned = spark.createDataFrame(pd.DataFrame(segments, columns=["pack_code", "bin", "low", "high", "number", "slot"]) if segments else [], "pack_code string, bin int, low long, high long, number long, slot int")
    table = planned.groupBy("pack_code", "bin").agg(F.sort_array(F.collect_list(F.struct("low", "high", "number", "slot"))).alias("segments"))
    rank = F.row_number().over(Window.partitionBy("pack_code", "bin", "part").orderBy("doc_id", "piece_no")) - 1
    ranked = cut.where("n_tokens > 0").withColumn("rank", rank).join(F.broadcast(where), ["pack_code", "bin", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    hit = F.element_at(F.filter("segments", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), 1)
    placed = ranked.join(F.broadcast(table), ["pack_code", "bin"]).withColumn("s", hit).select("pack_code", (F.col("s.number") + F.col("rank") - F.col("s.low")).alias("container_id"), F.col("s.slot").alias("slot"), "doc_id", "piece_no", "first_token", "n_tokens")
    empty = cut.where("n_tokens = 0").select("pack_code", F.lit(0).cast("long").alias("container_id"), F.lit(0).alias("slot"), "doc_id", "piece_no", "first_token", "n_tokens")
    return placed.unionByName(empty)


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """pack_code, capacity_tokens, n_containers, n_tokens, fill_share: how well the containers are filled."""
    sums = packed.where("container_id > 0").groupBy("pack_code").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return capacities.select("pack_code", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).join(sums, "pack_code", "left").select("pack_code", "capacity_tokens", F.coalesce("n_containers", F.lit(0)).alias("n_containers"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill_share"))
