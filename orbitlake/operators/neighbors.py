"""Neighbour search: a range join under a periodic metric, rewritten as an equi-join on cells.

Cells are at least as wide as the cutoff, so that partners lie in adjacent cells. Each point is sent to its own cell, and
on the other side to the adjacent cells; a cell visited twice, as on axes of few cells, counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.functions import box as B


def points(atoms: DataFrame) -> DataFrame:
    """frame_id, id, x, y, z, molecule_id, element, charge: the earliest recorded row of each atom with finite coordinates."""
    good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyz"]
    rows = atoms.where(good[0] & good[1] & good[2] & F.col("frame_id").isNotNull() & F.col("id").isNotNull())
    cols = ["x", "y", "z", "molecule_id", "element", "charge"]
    one = rows.groupBy("frame_id", "id").agg(F.min(F.struct("recorded_at", "ingested_at", *cols)).alias("r"))
    return one.select("frame_id", F.col("id").cast("long").alias("id"), *[F.col(f"r.{c}").alias(c) for c in cols])


def located(pts: DataFrame, boxes: DataFrame, cutoff: float) -> DataFrame:
    """Points with their box and cell (c1 .. c3, and numbers of cells n1 .. n3). Points of a frame without a box are free: no axis is periodic."""
    free = {c: F.lit(cutoff if c in ("h11", "h22", "h33") else 0.0) for c in B.H} | {c: F.lit(1 / cutoff if c in ("i11", "i22", "i33") else 0.0) for c in B.I} | {c: F.lit(0.0) for c in B.O} | {c: F.lit(False) for c in B.P}
    out = pts.join(boxes, "frame_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), v) for c, v in free.items()})
    out = out.withColumns({f"n{k + 1}": F.greatest(F.lit(1), F.floor(d / cutoff)).cast("int") for k, d in enumerate(B.plane_distances())})
    out = out.withColumns({f"f{k + 1}": f for k, f in enumerate(B.fractional(F.col("x"), F.col("y"), F.col("z")))})
    # On free axes points lie outside the box too, so that the cells of a box narrower than the cutoff are wider than it.
    free_n = [F.least(F.col(f"n{k + 1}").cast("double"), d / cutoff) for k, d in enumerate(B.plane_distances())]
    cell = [F.floor(F.when(F.col(f"p{k}"), (F.col(f"f{k}") - F.floor(F.col(f"f{k}"))) * F.col(f"n{k}")).otherwise(F.col(f"f{k}") * free_n[k - 1])).cast("int") for k in (1, 2, 3)]
    return out.withColumns({f"c{k}": F.when(F.col(f"p{k}"), F.pmod(cell[k - 1], F.col(f"n{k}"))).otherwise(cell[k - 1]) for k in (1, 2, 3)})


def _around(at: DataFrame) -> DataFrame:
    """Points in their own and all adjacent cells (s1 .. s3), each cell once: an axis of one or two periodic cells has no more neighbours than that."""
    for k in (1, 2, 3):
        steps = F.when(F.col(f"p{k}") & (F.col(f"n{k}") == 1), F.array(F.lit(0))).when(F.col(f"p{k}") & (F.col(f"n{k}") == 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        at = at.withColumn("step", F.explode(steps))
        c = F.col(f"c{k}") + F.col("step")
        at = at.withColumn(f"s{k}", F.when(F.col(f"p{k}"), F.pmod(c, F.col(f"n{k}"))).otherwise(c)).drop("step")
    return at


def _pairs(left: DataFrame, right: DataFrame, half: bool, cutoff: float) -> DataFrame:
    sent = _around(left)
    if half:
        sent = sent.where((F.col("s1") > F.col("c1")) | ((F.col("s1") == F.col("c1")) & ((F.col("s2") > F.col("c2")) | ((F.col("s2") == F.col("c2")) & (F.col("s3") >= F.col("c3"))))))
    same = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("s3") == F.col("c3"))
    sent = sent.select("frame_id", F.col("id").alias("a"), "f1", "f2", "f3", *B.H, *B.P, same.alias("same"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("s3").alias("c3"))
    there = right.select("frame_id", F.col("id").alias("b"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("f3").alias("g3"), "c1", "c2", "c3")
    met = sent.join(there, ["frame_id", "c1", "c2", "c3"])
    if half:
        met = met.where(~F.col("same") | (F.col("a") < F.col("b")))
    # Rows of one element, as a filter on the distance would else be pushed into the differences and repeat them.
    near = B.nearest([F.col(f"g{k}") - F.col(f"f{k}") for k in (1, 2, 3)])
    met = met.select("frame_id", "a", "b", *B.H, F.explode(F.array(F.struct(*[v.alias(f"q{k + 1}") for k, v in enumerate(near)]))).alias("q"))
    d = B.cartesian([F.col(f"q.q{k}") for k in (1, 2, 3)], origin=False)
    met = met.select("frame_id", "a", "b", F.explode(F.array(F.struct(d[0].alias("dx"), d[1].alias("dy"), d[2].alias("dz")))).alias("d")).select("frame_id", "a", "b", "d.*")
    return met.withColumn("dist_sq", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(F.col("dist_sq") <= cutoff * cutoff)


def pairs_self(pts: DataFrame, boxes: DataFrame, cutoff: float) -> DataFrame:
    """frame_id, i, j, dist_sq, dx, dy, dz: every unordered pair within the cutoff (inclusive) once, i < j, the difference being r_j - r_i."""
    at = located(pts, boxes, cutoff)
    met = _pairs(at, at, True, cutoff)
    turn = F.when(F.col("a") < F.col("b"), 1.0).otherwise(-1.0)
    return met.select("frame_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "dist_sq", *[(F.col(c) * turn).alias(c) for c in ("dx", "dy", "dz")])


def pairs_cross(query: DataFrame, reference: DataFrame, boxes: DataFrame, cutoff: float) -> DataFrame:
    """frame_id, i (of query), j (of reference), dist_sq, dx, dy, dz: all ordered pairs within the cutoff, also of a point with itself."""
    met = _pairs(located(query, boxes, cutoff), located(reference, boxes, cutoff), False, cutoff)
    return met.select("frame_id", F.col("a").alias("i"), F.col("b").alias("j"), "dist_sq", "dx", "dy", "dz")


def coordination(pairs: DataFrame, pts: DataFrame) -> DataFrame:
    """frame_id, id, n_neighbors of every point, 0 for lone ones."""
    ends = pairs.select("frame_id", F.explode(F.array("i", "j")).alias("id")).groupBy("frame_id", "id").agg(F.count("*").alias("n"))
    return pts.select("frame_id", "id").join(ends, ["frame_id", "id"], "left").select("frame_id", "id", F.coalesce("n", F.lit(0).cast("long")).alias("n_neighbors"))
