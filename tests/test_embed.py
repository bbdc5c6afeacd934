import numpy as np
import pytest

from orbitlake.functions import embed as E
from orbitlake.functions import molecule as M
from orbitlake.functions import smiles
from orbitlake.operators import molecules


@pytest.mark.parametrize("text", ["CCO", "c1ccccc1", "CC(=O)O", "C1CCCCC1", "C#CC", "CC(C)(C)CCN"])
def test_bonds_have_their_lengths(text):
    mol = M.hydrogenated(smiles.molecule(text))
    x, report = E.embed(mol, seed=3)
    low, _, known = E.bounds(mol)
    for i, j, _, _ in mol.bonds:
        assert abs(np.linalg.norm(x[i] - x[j]) - known[min(i, j), max(i, j)]) < 0.12
    d = np.linalg.norm(x[:, None] - x[None], axis=-1) + np.eye(len(x)) * 9
    assert d.min() > 0.6 and report.energies["final"] <= report.energies["descent"] + 1e-9 <= report.energies["start"] + 1e-6
    again, _ = E.embed(mol, seed=3)
    assert np.array_equal(x, again) and not np.array_equal(x, E.embed(mol, seed=4)[0])


def test_chiral_centres_and_edges():
    for mark, sign in (("@", 1), ("@@", -1)):
        mol = smiles.molecule(f"N[C{mark}](F)(Cl)Br")
        x, report = E.embed(mol, seed=1)
        a = [v for v, _ in mol.around[1]][:3]
        p, q, s = (x[v] - x[1] for v in a)
        assert sign * (p @ np.cross(q, s)) > 0 and not report.warnings
    assert E.embed(M.Molecule())[0].shape == (0, 3) and E.embed(smiles.molecule("C"))[0].shape == (1, 3)
    mol = smiles.molecule("CCC")
    f = E.Springs(*[E.bounds(mol)[k] for k in (0, 2)], [])
    x = np.random.default_rng(0).normal(size=(3, 3))
    e, g = f(x)
    for k in np.ndindex(3, 3):
        y = x.copy()
        y[k] += 1e-6
        assert (f(y)[0] - e) / 1e-6 == pytest.approx(g[k], abs=1e-4)


def test_tables(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "C("), (3, None), (4, "CCO")], "k long, smiles string")
    rows = molecules.embed(df, quality="fast").collect()
    assert len(rows) == 18 and {r.k for r in rows} == {1, 4}
    one = {k: [(r.x, r.y, r.z) for r in rows if r.k == k] for k in (1, 4)}
    assert one[1] == one[4]
    beads = spark.createDataFrame([(1, 0, "w", 1.0, 0.0, 0.0), (1, 1, "w", 5.0, 0.0, 0.0)], "frame_id long, bead long, kind string, x double, y double, z double")
    mapping = spark.createDataFrame([(1, 0, 10, 0), (1, 0, 11, 1), (1, 1, 12, 0)], "frame_id long, bead long, id long, slot int")
    templates = spark.createDataFrame([("w", 0, "O", 0.0, 0.0, 0.0), ("w", 1, "H", 1.0, 0.0, 0.0)], "kind string, slot int, element string, dx double, dy double, dz double")
    bonds = spark.createDataFrame([(1, 10, 11), (1, 11, 12)], "frame_id long, i long, j long")
    atoms, kept = molecules.backmap(beads, mapping, templates, bonds)
    assert {r.id: (r.element, r.x) for r in atoms.collect()} == {10: ("O", 1.0), 11: ("H", 2.0), 12: ("O", 5.0)} and [tuple(r) for r in kept.collect()] == [(1, 10, 11)]
    with pytest.raises(Exception, match="no atoms"):
        molecules.backmap(beads, mapping.where("bead = 0"), templates, bonds)[0].collect()
    assert {r.fault for r in molecules.check_mapping(mapping.union(mapping.selectExpr("frame_id", "bead + 1", "id", "slot")), atoms.where("id != 12")).collect()} == {"no such atom", "in several beads"}
