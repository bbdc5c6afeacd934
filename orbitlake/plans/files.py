"""Queries that write the atoms in a format, read them back and show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions import box as B
from orbitlake.operators import neighbors, topology
from orbitlake.plans.molecules import BOXES, POINTS
from orbitlake.runtime import Scratch, table
from orbitlake.sources import formats


def _points(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.points(table(spark, d, "atoms"))


def dump_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    pts, scratch = _points(spark, d), Scratch(spark, "dump")
    frames = pts.groupBy("frame_id").agg(F.array(*[F.min(c) for c in "xyz"]).alias("lo"), F.array(*[F.max(c) for c in "xyz"]).alias("hi")).select("frame_id", F.col("frame_id").alias("step"), "lo", "hi", F.array(F.lit(True), F.lit(False), F.lit(True)).alias("pbc"))
    formats.write_dump(frames, pts.select("frame_id", "id", F.lit("1").alias("type"), "x", "y", "z"), f"{scratch.root}/frames.dump")
    back = formats.read_dump(spark, f"{scratch.root}/frames.dump")
    return back.select(F.col("step").alias("frame_id"), F.col("atom")["id"].cast("long").alias("id"), *[F.col("atom")[c].cast("double").alias(c) for c in "xyz"])


def xyz_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    pts, scratch = _points(spark, d), Scratch(spark, "xyz")
    formats.write_xyz(pts, f"{scratch.root}/frames.xyz")
    back = formats.read_xyz(spark, f"{scratch.root}/frames.xyz")
    return back.select(F.col("meta")["frame"].cast("long").alias("frame_id"), F.col("more")["id"].cast("long").alias("id"), "x", "y", "z")


def _pdb(spark: SparkSession, d: str) -> str:
    """The file of all frames, with their elements, boxes, and the bonds of bonds and conect between existing atoms."""
    pts, path = _points(spark, d), f"{Scratch(spark, 'pdb').root}/frames.pdb"
    element = F.coalesce(F.nullif(F.trim("element"), F.lit("")), F.lit("X"))
    angle = lambda p, q: F.degrees(F.acos(sum(F.col(f"h{r}{p}") * F.col(f"h{r}{q}") for r in (1, 2, 3)) / (B.lengths()[p - 1] * B.lengths()[q - 1])))
    boxes = B.boxes(table(spark, d, "frames")).select(F.col("frame_id").alias("model"), *[v.alias(c) for v, c in zip(B.lengths(), "abc")], angle(2, 3).alias("alpha"), angle(1, 3).alias("beta"), angle(1, 2).alias("gamma"))
    records = table(spark, d, "conect").select("frame_id", F.col("serial").alias("atom_i"), F.explode("bonded").alias("atom_j")).where("atom_j > 0")
    bonds = topology.edges(table(spark, d, "bonds").select("frame_id", "atom_i", "atom_j").unionByName(records), pts)
    atoms = pts.select(F.col("frame_id").alias("model"), F.col("id").alias("serial"), element.alias("name"), element.alias("element"), "x", "y", "z")
    formats.write_pdb(atoms, path, boxes, bonds.withColumnRenamed("frame_id", "model"))
    return path


def pdb_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = formats.read_pdb(spark, _pdb(spark, d))
    return back.select(F.col("model").cast("long").alias("frame_id"), (F.col("serial") % 100000).cast("long").alias("id"), "x", "y", "z")


def pdb_elements(spark: SparkSession, d: str) -> DataFrame:
    back = formats.read_pdb(spark, _pdb(spark, d))
    return back.select(F.col("model").cast("long").alias("frame_id"), F.col("serial").cast("long").alias("id"), "element")


def pdb_boxes(spark: SparkSession, d: str) -> DataFrame:
    back = formats.read_pdb_boxes(spark, _pdb(spark, d))
    return back.select(F.col("model").cast("long").alias("frame_id"), "a", "b", "c", "alpha", "beta", "gamma")


def pdb_bonds(spark: SparkSession, d: str) -> DataFrame:
    back = formats.read_pdb_bonds(spark, _pdb(spark, d))
    return back.select(F.col("model").cast("long").alias("frame_id"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


_BACK = "WITH " + POINTS + " SELECT frame_id, {id} id, round(x, {n}) x, round(y, {n}) y, round(z, {n}) z FROM pts"
QUERIES = {f.__name__: f for f in (dump_roundtrip, xyz_roundtrip, pdb_roundtrip, pdb_elements, pdb_boxes, pdb_bonds)}
SQL = {"dump_roundtrip": _BACK.format(id="id", n=6), "xyz_roundtrip": _BACK.format(id="id", n=6), "pdb_roundtrip": _BACK.format(id="id % 100000", n=3)}

_LENGTH = "sqrt(h1{0}*h1{0}+h2{0}*h2{0}+h3{0}*h3{0})"
_ANGLE = "round(degrees(acos((h1{0}*h1{1}+h2{0}*h2{1}+h3{0}*h3{1})/(" + _LENGTH.format("{0}") + "*" + _LENGTH.format("{1}") + "))), 2)"
SQL["pdb_elements"] = f"WITH {POINTS} SELECT frame_id, id, coalesce(nullif(trim(element), ''), 'X') AS element FROM pts"
SQL["pdb_boxes"] = f"WITH {BOXES}, {POINTS} SELECT frame_id, " + ", ".join(f"round({_LENGTH.format(k)}, 3) {c}" for k, c in zip((1, 2, 3), "abc")) + ", " + ", ".join(f"{_ANGLE.format(*k)} {c}" for k, c in (((2, 3), "alpha"), ((1, 3), "beta"), ((1, 2), "gamma"))) + " FROM boxes WHERE frame_id IN (SELECT frame_id FROM pts)"
SQL["pdb_bonds"] = f"""WITH {POINTS}, records AS (SELECT frame_id, atom_i, atom_j FROM bonds UNION ALL SELECT frame_id, serial, b FROM (SELECT frame_id, serial, unnest(bonded) b FROM conect) WHERE b > 0)
SELECT DISTINCT r.frame_id, least(atom_i, atom_j)::BIGINT i, greatest(atom_i, atom_j)::BIGINT j FROM records r JOIN pts p ON p.frame_id = r.frame_id AND p.id = r.atom_i JOIN pts q ON q.frame_id = r.frame_id AND q.id = r.atom_j WHERE atom_i <> atom_j"""
