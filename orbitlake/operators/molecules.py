"""Molecules as groups of atoms and bonds: tables in, tables out, one molecule at a time inside.

A molecule is a component of the bond graph of a frame. Frames may be of any size, so that the group is the component and
not the frame; its atoms and bonds meet in one cogrouped pandas call, which hands a ``Molecule`` to a kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.functions import elements, smiles
from orbitlake.functions import molecule as M
from orbitlake.operators.components import components
from orbitlake.operators.skew import hot_keys, lookup
from orbitlake.runtime import Scratch


def split(atoms: DataFrame, bonds: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds with ``mol``, the lowest atom of their component.

    atoms: frame_id, id, element and, if known, formal_charge, x, y, z; bonds: frame_id, i, j, bond_order, place (of the bond among its kind).
    """
    roots = components(bonds.select(F.col("frame_id").alias("scope"), F.col("i").alias("u"), F.col("j").alias("v")), scratch)
    roots = scratch.put(roots.select(F.col("scope").alias("frame_id"), F.col("node").alias("id"), "root"))
    a = atoms.join(roots, ["frame_id", "id"], "left").withColumn("mol", F.coalesce("root", "id")).drop("root")
    b = bonds.join(roots.withColumnRenamed("id", "i"), ["frame_id", "i"], "left").withColumn("mol", F.coalesce("root", "i")).drop("root")
    return scratch.put(a), scratch.put(b)


def _read(atoms: pd.DataFrame, bonds: pd.DataFrame) -> tuple[M.Molecule, list[int]]:
    """A molecule with its atoms by id and its bonds by place; and the ids."""
    atoms = atoms.sort_values("id")
    ids = [int(x) for x in atoms["id"]]
    at = {x: k for k, x in enumerate(ids)}
    charge = atoms["formal_charge"].fillna(0.0) if "formal_charge" in atoms else [0.0] * len(ids)
    xyz = atoms[["x", "y", "z"]].to_numpy() if "x" in atoms else [None] * len(ids)
    mol = M.Molecule([M.Atom(e.strip().capitalize() if isinstance(e, str) else None, float(q), xyz=None if p is None else tuple(p)) for e, q, p in zip(atoms["element"], charge, xyz)])
    for r in bonds.sort_values(["place", "i", "j"]).itertuples():
        if r.i in at and r.j in at:
            mol.bond(at[r.i], at[r.j], None if pd.isna(r.bond_order) else float(r.bond_order))
    return mol, ids


def each(atoms: DataFrame, bonds: DataFrame, schema: str, kernel: Callable[[M.Molecule, list[int]], list[tuple]]) -> DataFrame:
    """frame_id, mol and the rows of a kernel for each molecule. atoms and bonds as ``split`` gives them."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = kernel(*_read(a, b)) if len(a) else []
        return pd.DataFrame([(key[0], key[1], *r) for r in rows], columns=["frame_id", "mol", *names])

    keys = ["frame_id", "mol"]
    return atoms.groupBy(*keys).cogroup(bonds.groupBy(*keys)).applyInPandas(run, f"frame_id long, mol long, {schema}")


def cyclic(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The atoms and bonds of molecules with a ring: those with as many bonds as atoms, or more."""
    keys = ["frame_id", "mol"]
    n = atoms.groupBy(*keys).agg(F.count("*").alias("n_a")).join(bonds.groupBy(*keys).agg(F.count("*").alias("n_b")), keys).where("n_b >= n_a").select(*keys)
    return atoms.join(n, keys, "left_semi"), bonds.join(n, keys, "left_semi")


def rings(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """frame_id, mol, ring (from 0), size, ids: a smallest independent set of rings of each molecule, ids in the order of the ring."""
    return each(*cyclic(atoms, bonds), "ring int, size int, ids array<bigint>", lambda mol, ids: [(k, len(r), [ids[i] for i in r]) for k, r in enumerate(M.rings(mol))])


def ring_membership(found: DataFrame, atoms: DataFrame) -> DataFrame:
    """frame_id, id, n_rings, smallest (null outside rings) of every atom."""
    of = found.select("frame_id", "size", F.explode("ids").alias("id")).groupBy("frame_id", "id").agg(F.count("*").alias("n"), F.min("size").alias("smallest"))
    return atoms.select("frame_id", "id").join(of, ["frame_id", "id"], "left").select("frame_id", "id", F.coalesce("n", F.lit(0).cast("long")).alias("n_rings"), "smallest")


def ring_bonds(found: DataFrame) -> DataFrame:
    """frame_id, i, j (i < j) of the bonds in a ring."""
    nxt = F.concat(F.slice("ids", 2, 1_000_000_000), F.slice("ids", 1, 1))
    pairs = found.select("frame_id", F.explode(F.arrays_zip(F.col("ids").alias("a"), nxt.alias("b"))).alias("p"))
    return pairs.select("frame_id", F.least("p.a", "p.b").alias("i"), F.greatest("p.a", "p.b").alias("j")).distinct()


def rotatable(atoms: DataFrame, bonds: DataFrame, scratch: Scratch) -> DataFrame:
    """frame_id, i, j of the bonds of order 1 outside rings, both ends of which have another neighbour."""
    ends = bonds.select("frame_id", F.explode(F.array("i", "j")).alias("id")).groupBy("frame_id", "id").agg(F.count("*").alias("n"))
    inner = scratch.put(ends.where("n > 1").select("frame_id", "id"))
    single = bonds.where(F.abs(F.coalesce("bond_order", F.lit(1.0)) - 1.0) <= 0.01).select("frame_id", "i", "j")
    for e in "ij":
        single = single.join(inner.withColumnRenamed("id", e), ["frame_id", e], "left_semi")
    return single.select("frame_id", "i", "j").join(ring_bonds(rings(atoms, bonds)), ["frame_id", "i", "j"], "left_anti")


#: Atoms on sides of bonds that one Arrow batch holds, or those of one bond.
SIDE_ATOMS = 1_000_000


def downstream(bonds: DataFrame, scratch: Scratch) -> DataFrame:
    """frame_id, mol, i, j, ids: of each rotatable bond, the atoms on the side of j, which a rotation moves.

    bonds: frame_id, i, j, bond_order, place, between atoms. An atom without a bond has no part in it, nor has a molecule of
    two bonds, which can't turn about any. Molecules go to Python many at a time.
    """
    held = scratch.put(bonds.select("frame_id", "i", "j", "bond_order", "place"))
    roots = components(held.select(F.col("frame_id").alias("scope"), F.col("i").alias("u"), F.col("j").alias("v")), scratch)
    roots = roots.select(F.col("scope").alias("frame_id"), F.col("node").alias("i"), "root")
    sorted_ = F.sort_array(F.collect_list(F.struct("place", "i", "j", "bond_order")))
    mols = held.join(roots, ["frame_id", "i"], "left").groupBy("frame_id", F.coalesce("root", "i").alias("mol")).agg(sorted_.alias("b")).where(F.size("b") > 2)
    mols = mols.select("frame_id", "mol", *[F.col(f"b.{c}").alias(c) for c in ("i", "j", "bond_order")])
    kinds = [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sides, n = [], [], 0

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            ends = np.cumsum([0, *map(len, sides)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sides)))], names=["frame_id", "mol", "i", "j", "ids"])

        for part in batches:
            frames, names = part.column("frame_id").to_pylist(), part.column("mol").to_pylist()
            for x, (frame, name) in enumerate(zip(frames, names)):
                i, j, orders = (part.column(c)[x].values for c in ("i", "j", "bond_order"))
                ids, at = np.unique(np.concatenate((i.to_numpy(), j.to_numpy())), return_inverse=True)
                ends = at.reshape(2, -1).tolist()
                mol = M.Molecule([M.Atom(None)] * len(ids), [(*e, o, None) for *e, o in zip(*ends, orders.to_pylist())])
                for k, side in M.sides_of_rotatable(mol):
                    if n and n + len(side) > SIDE_ATOMS:
                        yield batch()
                        rows, sides, n = [], [], 0
                    u, v = mol.bonds[k][:2]
                    rows.append((frame, name, int(ids[u]), int(ids[v])))
                    sides.append(ids[side])
                    n += len(side)
        if rows:
            yield batch()

    return mols.mapInArrow(run, "frame_id bigint, mol bigint, i bigint, j bigint, ids array<bigint>")


def valences() -> str:
    """SQL map of the usual valences by symbol in small letters."""
    return "map(" + ", ".join(f"'{s.lower()}', array({', '.join(map(str, v))})" for s, v in elements.VALENCES.items()) + ")"


def implicit_hydrogens(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """frame_id, id, n_h: hydrogens that the smallest usual valence at or above the bond orders leaves open, plus the formal charge.

    Null without an element or with no usual valence high enough. Bonds without an order count as 1.
    """
    ends = bonds.select("frame_id", F.explode(F.array("i", "j")).alias("id"), F.coalesce("bond_order", F.lit(1.0)).alias("o")).groupBy("frame_id", "id").agg(F.sum("o").alias("total"))
    charge = F.col("formal_charge") if "formal_charge" in atoms.columns else F.lit(0.0)
    a = atoms.select("frame_id", "id", F.try_element_at(F.expr(valences()), F.lower(F.trim("element"))).alias("v"), F.coalesce(charge, F.lit(0.0)).alias("q")).join(ends, ["frame_id", "id"], "left")
    total = F.coalesce("total", F.lit(0.0))
    open_ = F.array_min(F.filter("v", lambda x: x >= total - M.EPS)) - total + F.col("q")
    return a.select("frame_id", "id", F.when(open_ <= 0.5, 0).otherwise(F.floor(open_ + 0.5)).cast("int").alias("n_h"))


def add_hydrogens(atoms: DataFrame, bonds: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds with a hydrogen for each open valence of the heavy atoms; new ids follow the highest of the frame, in the order of their atoms."""
    from orbitlake.operators.skew import numbered

    heavy = implicit_hydrogens(atoms, bonds).join(atoms.where("lower(trim(element)) != 'h'").select("frame_id", "id"), ["frame_id", "id"], "left_semi")
    new = numbered(heavy.where("n_h > 0").select("frame_id", F.col("id").alias("parent"), F.explode(F.sequence(F.lit(1), F.col("n_h"))).alias("k")), "frame_id", ["parent", "k"], "rank", scratch)
    top = atoms.groupBy("frame_id").agg(F.max("id").alias("top"))
    new = scratch.put(new.join(top, "frame_id").select("frame_id", (F.col("top") + F.col("rank") + 1).cast("long").alias("id"), "parent"))
    return atoms.unionByName(new.select("frame_id", "id", F.lit("H").alias("element")), allowMissingColumns=True), bonds.unionByName(new.select("frame_id", F.col("parent").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("bond_order")), allowMissingColumns=True)


def remove_hydrogens(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds without the hydrogens that have exactly one neighbour; hydrogens between atoms stay."""
    ends = bonds.select("frame_id", F.explode(F.array("i", "j")).alias("id")).groupBy("frame_id", "id").agg(F.count("*").alias("n")).where("n = 1")
    gone = atoms.where("lower(trim(element)) = 'h'").select("frame_id", "id").join(ends, ["frame_id", "id"], "left_semi")
    left = bonds
    for e in "ij":
        left = left.join(gone.withColumnRenamed("id", e), ["frame_id", e], "left_anti")
    return atoms.join(gone, ["frame_id", "id"], "left_anti"), left


def neighbours(bonds: DataFrame) -> DataFrame:
    """frame_id, id, other, place: both directions of each bond."""
    two = F.explode(F.array(F.struct(F.col("i").alias("id"), F.col("j").alias("other")), F.struct(F.col("j").alias("id"), F.col("i").alias("other"))))
    return bonds.select("frame_id", "place", two.alias("s")).select("frame_id", "s.id", "s.other", "place")


def chiral_centres(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """frame_id, id, volume, stereo of the atoms with four neighbours, taken in the order of their bonds.

    volume is the triple product of the first three arms; above 1e-9 the centre is CCW, under -1e-9 CW, else Unspecified.
    """
    four = neighbours(bonds).groupBy("frame_id", "id").agg(F.sort_array(F.collect_list(F.struct("place", "other"))).alias("n")).where("size(n) = 4")
    rows = four.join(atoms.select("frame_id", "id", "x", "y", "z"), ["frame_id", "id"])
    for k in range(3):
        at = atoms.select("frame_id", F.col("id").alias(f"n{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
        rows = rows.withColumn(f"n{k}", F.col("n")[k]["other"]).join(at, ["frame_id", f"n{k}"])
    v = [[F.col(f"{c}{k}") - F.col(c) for c in "xyz"] for k in range(3)]
    volume = v[0][0] * (v[1][1] * v[2][2] - v[1][2] * v[2][1]) + v[0][1] * (v[1][2] * v[2][0] - v[1][0] * v[2][2]) + v[0][2] * (v[1][0] * v[2][1] - v[1][1] * v[2][0])
    return rows.select("frame_id", "id", volume.alias("volume")).withColumn("stereo", F.when(F.col("volume") > 1e-9, "CCW").when(F.col("volume") < -1e-9, "CW").otherwise("Unspecified"))


def double_bond_stereo(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """frame_id, i, j, stereo of the bonds whose order is within 0.5 of 2 and both ends of which have another neighbour.

    The heaviest of these at each end decide, the last of several by place: Z if they lie on one side of the bond, E on opposite ones, else Either.
    """
    double = bonds.where(F.abs(F.coalesce("bond_order", F.lit(1.0)) - 2.0) <= 0.5).select("frame_id", "i", "j")
    z = elements.number(F.col("element"))
    near = neighbours(bonds).join(atoms.select("frame_id", F.col("id").alias("other"), F.coalesce(z, F.lit(0)).alias("weight"), "x", "y", "z"), ["frame_id", "other"])
    rows = double
    for e, far in (("i", "j"), ("j", "i")):
        best = double.join(near.withColumnRenamed("id", e), ["frame_id", e]).where(F.col("other") != F.col(far)).groupBy("frame_id", "i", "j").agg(F.max(F.struct("weight", "place", "x", "y", "z")).alias(f"s{e}"))
        rows = rows.join(best, ["frame_id", "i", "j"]).join(atoms.select("frame_id", F.col("id").alias(e), *[F.col(c).alias(f"{c}{e}") for c in "xyz"]), ["frame_id", e])
    ab = [F.col(f"{c}j") - F.col(f"{c}i") for c in "xyz"]
    arm = {e: [F.col(f"s{e}")[c] - F.col(f"{c}{e}") for c in "xyz"] for e in "ij"}
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    rows = rows.select("frame_id", "i", "j", dot(arm["i"], arm["j"]).alias("pq"), dot(arm["i"], ab).alias("pa"), dot(arm["j"], ab).alias("qa"), dot(ab, ab).alias("aa"), dot(arm["i"], arm["i"]).alias("pp"), dot(arm["j"], arm["j"]).alias("qq"))
    side = (F.col("pq") - F.col("pa") * F.col("qa") / F.col("aa")) / (F.sqrt(F.greatest(F.lit(0.0), F.col("pp") - F.col("pa") * F.col("pa") / F.col("aa"))) * F.sqrt(F.greatest(F.lit(0.0), F.col("qq") - F.col("qa") * F.col("qa") / F.col("aa"))) + 1e-15)
    return rows.withColumn("c", F.when(F.col("aa") > 0, side)).select("frame_id", "i", "j", F.when(F.col("c") > 1e-9, "Z").when(F.col("c") < -1e-9, "E").otherwise("Either").alias("stereo"))


def partial_charges(atoms: DataFrame, bonds: DataFrame, rounds: int = 12) -> DataFrame:
    """frame_id, mol, id, charge, h_charge of every heavy atom, by damped equalisation of electronegativities."""
    return each(atoms, bonds, "id bigint, charge double, h_charge double", lambda mol, ids: [(ids[i], q, h) for i, (q, h) in M.partial_charges(mol, rounds).items()])


# Texts of molecules.

ATOMS = "atom int, element string, aromatic boolean, formal_charge double, isotope int, h_count int, stereo string, atom_class int"
BONDS = "atom_i int, atom_j int, bond_order double, mark string"


def _per_text(df: DataFrame, schema: str, rows: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows of a function of each text (column smiles), with the other columns of df kept."""
    names = [p.split()[0] for p in schema.split(", ")]
    kept = [c for c in df.columns if c not in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, memo = [], {}
            for row in batch[kept].itertuples(index=False, name=None):
                text = row[kept.index("smiles")]
                if text not in memo:
                    memo[text] = rows(text)
                out += [(*row, *r) for r in memo[text]]
            yield pd.DataFrame(out, columns=[*kept, *names]).astype(object)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return df.select(*kept).mapInPandas(run, f"{head}, {schema}")


def _mol(text: str | None) -> M.Molecule | None:
    try:
        return smiles.molecule(text) if text else None
    except smiles.NotationError:
        return None


def parse(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The atoms and the bonds of the texts of column smiles, other columns kept. Texts with a fault have no rows; see ``faults``."""
    a = _per_text(df, ATOMS, lambda t: [(k, x.element, x.aromatic, x.charge, x.isotope, x.h_count, x.stereo, x.atom_class) for k, x in enumerate(m.atoms)] if (m := _mol(t)) else [])
    b = _per_text(df, BONDS, lambda t: list(m.bonds) if (m := _mol(t)) else [])
    return a, b


def faults(df: DataFrame) -> DataFrame:
    """df with fault: what is wrong with the text of column smiles, null if nothing is."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(smiles.fault, na_action=None)

    return df.withColumn("fault", read("smiles"))


def matches(df: DataFrame, pattern: str) -> DataFrame:
    """df with one row for each embedding of the pattern in the molecule of column smiles: match (from 0), atoms. Raises NotationError for the pattern at once."""
    smiles.Pattern(pattern)
    return _per_text(df, "match int, atoms array<int>", lambda t: [(k, list(x)) for k, x in enumerate(smiles.pattern(pattern).find(m))] if (m := _mol(t)) else [])


def embed(df: DataFrame, seed: int = 0, quality: str = "medium", hydrogens: bool = True) -> DataFrame:
    """df with a row for each atom of the molecule of column smiles: atom, element, x, y, z, energy (of the whole molecule) and warnings.

    Hydrogens are added first unless asked otherwise. Texts with a fault have no rows; equal texts have equal places.
    """
    from orbitlake.functions.embed import embed as place

    def rows(text: str) -> list[tuple]:
        mol = _mol(text)
        if mol is None:
            return []
        mol = M.hydrogenated(mol) if hydrogens else mol
        x, report = place(mol, seed, quality)
        return [(k, a.element, *map(float, x[k]), report.energies["final"], report.warnings) for k, a in enumerate(mol.atoms)]

    # Few rows mean much work here, so that they are spread over all cores whatever their size.
    spread = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    return _per_text(spread, "atom int, element string, x double, y double, z double, energy double, warnings array<string>", rows)


def backmap(beads: DataFrame, mapping: DataFrame, templates: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds of coarse frames: each bead is replaced by its atoms, placed as its template has them about the place of the bead.

    beads: frame_id, bead, kind, x, y, z; mapping: frame_id, bead, id, slot; templates: kind, slot, element, dx, dy, dz, a small table; bonds: frame_id, i, j of
    the atoms, of which those within one bead come back. A bead without atoms in the mapping, or a slot without a template, raises when it runs.
    """
    keys = ["frame_id", "bead"]
    met = beads.join(mapping, keys, "left").join(F.broadcast(templates), ["kind", "slot"], "left")
    fault = F.when(F.col("id").isNull(), F.raise_error(F.lit("a bead has no atoms"))).when(F.col("dx").isNull(), F.raise_error(F.lit("a slot has no template"))).otherwise(True)
    atoms = met.where(fault).select("frame_id", "id", "element", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in "xyz"], "bead")
    kept = bonds
    for e in "ij":
        kept = kept.join(mapping.select("frame_id", F.col("id").alias(e), F.col("bead").alias(f"bead_{e}")), ["frame_id", e])
    return atoms, kept.where("bead_i = bead_j").select("frame_id", "i", "j")


def check_mapping(mapping: DataFrame, atoms: DataFrame) -> DataFrame:
    """frame_id, id, fault of a mapping of atoms to beads (frame_id, bead, id): atoms that are not there, or are in several beads."""
    gone = mapping.join(atoms.select("frame_id", "id"), ["frame_id", "id"], "left_anti").select("frame_id", "id", F.lit("no such atom").alias("fault")).distinct()
    twice = mapping.groupBy("frame_id", "id").agg(F.count_distinct("bead").alias("n")).where("n > 1").select("frame_id", "id", F.lit("in several beads").alias("fault"))
    return gone.unionByName(twice)
