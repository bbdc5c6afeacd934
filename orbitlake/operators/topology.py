"""Topology of the bond graph: angles, dihedrals, impropers, degrees, non-bonded pairs, and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.operators.references import orphans


def edges(bonds: DataFrame, pts: DataFrame) -> DataFrame:
    """frame_id, i, j with i < j: every bond between two existing atoms once, without self-links and nulls."""
    clean = bonds.where("atom_i is not null and atom_j is not null").select("frame_id", F.least("atom_i", "atom_j").cast("long").alias("i"), F.greatest("atom_i", "atom_j").cast("long").alias("j")).where("i < j").distinct()
    ids = pts.select("frame_id", "id")
    return clean.join(ids.withColumnRenamed("id", "i"), ["frame_id", "i"], "left_semi").join(ids.withColumnRenamed("id", "j"), ["frame_id", "j"], "left_semi").select("frame_id", "i", "j")


def both_ways(e: DataFrame, a: str, b: str) -> DataFrame:
    s = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    return e.select("frame_id", s.alias("s")).select("frame_id", F.col("s.a").alias(a), F.col("s.b").alias(b))


def degree(e: DataFrame, pts: DataFrame) -> DataFrame:
    n = both_ways(e, "id", "o").groupBy("frame_id", "id").agg(F.count("*").alias("n"))
    return pts.select("frame_id", "id").join(n, ["frame_id", "id"], "left").select("frame_id", "id", F.coalesce("n", F.lit(0).cast("long")).alias("degree"))


def angles(e: DataFrame) -> DataFrame:
    """frame_id, i, j, k: pairs i < k of neighbours of j."""
    return both_ways(e, "j", "i").join(both_ways(e, "j", "k"), ["frame_id", "j"]).where("i < k").select("frame_id", "i", "j", "k")


def dihedrals(e: DataFrame) -> DataFrame:
    """frame_id, i, j, k, l: for each bond j < k, a neighbour i of j and a neighbour l of k, all different."""
    middle = e.select("frame_id", F.col("i").alias("j"), F.col("j").alias("k"))
    return middle.join(both_ways(e, "j", "i"), ["frame_id", "j"]).where("i != k").join(both_ways(e, "k", "l"), ["frame_id", "k"]).where("l != j and l != i").select("frame_id", "i", "j", "k", "l")


def impropers(e: DataFrame) -> DataFrame:
    """frame_id, centre, a, b, c: sorted triples of neighbours of every atom with three or more."""
    n = both_ways(e, "centre", "a")
    out = n.join(n.withColumnRenamed("a", "b"), ["frame_id", "centre"]).where("a < b")
    return out.join(n.withColumnRenamed("a", "c"), ["frame_id", "centre"]).where("b < c").select("frame_id", "centre", "a", "b", "c")


def nonbonded(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """frame_id, i, j, is_14: pairs within a cutoff without those of one or two bonds; is_14 where the ends of a dihedral meet."""
    two = angles(e).select("frame_id", F.col("i"), F.col("k").alias("j"))
    three = dihedrals(e).select("frame_id", F.least("i", "l").alias("i"), F.greatest("i", "l").alias("j")).distinct().withColumn("is_14", F.lit(True))
    key = ["frame_id", "i", "j"]
    left = pairs.select(*key).join(e.unionByName(two).distinct(), key, "left_anti")
    return left.join(three, key, "left").select(*key, F.coalesce("is_14", F.lit(False)).alias("is_14"))


def invalid_bonds(bonds: DataFrame, pts: DataFrame) -> DataFrame:
    """bond_id, field, id of the ends that are no atoms of the frame: the frame check."""
    ends = bonds.select("bond_id", "frame_id", F.explode(F.array(F.struct(F.lit("atom_i").alias("field"), F.col("atom_i").cast("long").alias("id")), F.struct(F.lit("atom_j").alias("field"), F.col("atom_j").cast("long").alias("id")))).alias("e")).select("bond_id", "frame_id", "e.*")
    return orphans(ends, pts, ["frame_id", "id"]).select("bond_id", "field", "id").distinct()


def remove_atoms(pts: DataFrame, e: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds without the atoms of gone (frame_id, id) and the bonds at them."""
    g = gone.select("frame_id", "id").distinct()
    left = e.join(g.withColumnRenamed("id", "i"), ["frame_id", "i"], "left_anti").join(g.withColumnRenamed("id", "j"), ["frame_id", "j"], "left_anti")
    return pts.join(g, ["frame_id", "id"], "left_anti"), left.select("frame_id", "i", "j")


def coarse_bonds(e: DataFrame, beads: DataFrame) -> DataFrame:
    """frame_id, bead_i, bead_j: beads joined by a bond between their atoms. beads: frame_id, id, bead."""
    a = e.join(beads.select("frame_id", F.col("id").alias("i"), F.col("bead").alias("x")), ["frame_id", "i"]).join(beads.select("frame_id", F.col("id").alias("j"), F.col("bead").alias("y")), ["frame_id", "j"])
    return a.where("x != y").select("frame_id", F.least("x", "y").alias("bead_i"), F.greatest("x", "y").alias("bead_j")).distinct()
