import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from orbitlake.functions import elements, smiles
from orbitlake.functions import molecule as M
from orbitlake.operators import molecules
from orbitlake.runtime import Scratch


def count(pattern, text):
    return len(smiles.Pattern(pattern).find(smiles.molecule(text)))


@pytest.mark.parametrize(
    "pattern,text,n",
    [
        ("CC", "CCC", 4), ("c1ccccc1", "c1ccccc1", 12), ("[OX2H]", "CCO", 1), ("[$(C=O)]", "CC(=O)O", 1), ("C.C", "CCC", 6), ("[#6]~[#8]", "c1ccccc1O", 1), ("[R]", "C1CC1C", 3), ("[R0]", "C1CC1C", 1), ("[r3]", "C1CC1C", 3),
        ("[C;!$(C=O)]", "CC(=O)O", 1), ("[NX3;H2,H1]", "CCN", 1), ("C=,#C", "C#CC=C", 4), ("[CH3]", "CC", 2), ("[Na+].[Cl-]", "[Na+].[Cl-]", 1), ("[13C]", "[13CH4]", 1), ("[C:7]", "[CH3:7]C", 1), ("a", "c1ccccc1C", 6), ("A", "c1ccccc1C", 1),
        ("C!-C", "C=CC", 2), ("C@C", "C1CC1C", 6), ("[v4]", "C", 1), ("[D2]", "CCC", 1), ("[X4]", "CC", 2), ("[!#6]", "CCO", 1), ("C~C~C", "C1CC1", 0), ("[C@H]", "[C@H](N)(O)C", 0), ("Cl", "CCl", 1), ("[Cl,Br]", "ClCBr", 2), ("*", "CCO", 3), ("[$([#6]-[OH])]", "CO", 1),
    ],
)
def test_patterns(pattern, text, n):
    assert count(pattern, text) == n


def test_pattern_against_permutations():
    rnd = random.Random(4)
    for text in ("CCOC(C)N", "C1CC1O", "CC(C)(C)O", "OC=CO", "C1CCC1C"):
        mol = smiles.molecule(text)
        for pattern in ("CCO", "CC", "C(C)C", "C1CC1", "C=C", "CO"):
            pat, sub = smiles.Pattern(pattern), smiles.molecule(pattern)
            want = 0
            links = {frozenset(b[:2]): mol.order(k) for k, b in enumerate(mol.bonds)}
            inner = {frozenset(b[:2]): sub.order(k) for k, b in enumerate(sub.bonds)}
            for p in itertools.permutations(range(len(mol.atoms)), len(sub.atoms)):
                ok = all(mol.atoms[p[i]].element == a.element for i, a in enumerate(sub.atoms))
                want += ok and all(links.get(frozenset((p[i], p[j]))) == inner.get(frozenset((i, j))) for i, j in itertools.combinations(range(len(p)), 2))
            assert len(pat.find(mol)) == want, (text, pattern)
    rnd.random()


@pytest.mark.parametrize("text", ["C1CC", "C(", "C)", "[Xx]", "C==C", "C%1C", "", "C..C", "C=1CC-1", "[C", "1CC", "C-", "C(C", "C11", "C()C"])
def test_faults(text):
    assert smiles.fault(text)


@pytest.mark.parametrize("text", ["[C", "[]", "[C;]", "[!]", "C[&C]", "[$(C]", "[#999]", "C~", "[Qq]"])
def test_pattern_faults(text):
    with pytest.raises(smiles.NotationError):
        smiles.Pattern(text)


def test_atoms_of_a_notation():
    m = smiles.molecule("[13CH3:2][N+](=O)/C=C\\c1ccccc1%12.[O-]C%12")
    a = m.atoms
    assert (a[0].isotope, a[0].h_count, a[0].atom_class, a[1].charge, a[5].aromatic) == (13, 3, 2, 1.0, True) and len(m.bonds) == 13
    assert {b[3] for b in m.bonds} == {None, "up", "down"} and smiles.molecule("C1.C1").bonds == [(0, 1, None, None)]


@pytest.mark.parametrize("text,sizes", [("C1CC2CCC1CC2", [6, 6]), ("c1ccc2ccccc2c1", [6, 6]), ("C12C3C4C1C5C2C3C45", [4] * 5), ("CCC", []), ("C1CC1C1CCC1", [3, 4]), ("C1CC12CC2", [3, 3])])
def test_rings(text, sizes):
    assert [len(r) for r in M.rings(smiles.molecule(text))] == sizes


def test_rings_are_independent_and_whole():
    rnd = random.Random(6)
    for _ in range(40):
        n = rnd.randrange(3, 14)
        edges = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(rnd.randrange(2, 22))}
        m = M.Molecule([M.Atom("C") for _ in range(n)], [(i, j, 1.0, None) for i, j in sorted(edges)])
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        parts = n
        for i, j in edges:
            a, b = find(i), find(j)
            parts -= a != b
            root[max(a, b)] = min(a, b)
        got = M.rings(m)
        assert len(got) == len(edges) - n + parts
        assert all(tuple(sorted((r[k], r[k - 1]))) in edges for r in got for k in range(len(r)))


def test_hydrogens_charges_rotors():
    m = smiles.molecule
    assert [M.implicit_hydrogens(m("CC(=O)O"), k) for k in range(4)] == [3, 0, 0, 1] and M.implicit_hydrogens(m("[NH4+]"), 0) == 4 and M.implicit_hydrogens(m("[He]"), 0) is None
    assert len(M.hydrogenated(m("CCO")).atoms) == 9 and M.rotatable(m("CCCC")) == [1] and M.rotatable(m("C1CCC1CC")) == [4] and M.downstream(m("CC(C)CC"), 1, 3) == [3, 4]
    q = M.partial_charges(m("CCO"))
    assert abs(sum(a + b for a, b in q.values())) < 1e-9 and q[2][0] < -0.3 < q[0][0] < 0
    acid = M.partial_charges(m("CC(=O)[O-]"))
    assert abs(sum(a + b for a, b in acid.values()) + 1) < 1e-9 and M.partial_charges(m("[H]")) == {} and M.hybridisation(m("CS(O)O"), 1) == "so2"


def test_sides_of_long_chains():
    n = 3000
    mol = M.Molecule([M.Atom("C")] * n, [(k, k + 1, 1.0, None) for k in range(n - 1)] + [(0, 2, 1.0, None)])
    began = time.process_time()
    sides = dict(M.downstream_of_rotatable(mol))
    assert sorted(sides) == list(range(2, n - 2)) and all(x == list(range(k + 1, n)) for k, x in sides.items())
    assert time.process_time() - began < 5
    two = M.Molecule([M.Atom("C")] * 9, [(1, 0, 1.0, None), (2, 1, None, None), (3, 2, 1.0, None), (5, 4, 1.0, None), (6, 5, 1.0, None), (5, 6, 1.0, None), (7, 6, 1.0, None), (8, 7, 1.0, None), (8, 8, 1.0, None)])
    assert M.downstream_of_rotatable(two) == [(k, M.downstream(two, *two.bonds[k][:2])) for k in (1, 6, 7)] and M.rotatable(two) == [1, 6, 7]


def test_elements():
    assert elements.by_symbol(" aU ") == 79 and elements.MASSES[78] == 197.0 and elements.NAMES[117] == "Oganesson" and elements.by_symbol("") is None and elements.by_symbol(None) is None
    assert len(elements.MASSES) == len(elements.COVALENT) == len(elements.VAN_DER_WAALS) == len(elements.NAMES) == len(elements.SYMBOLS) == 118


def frames(spark, texts):
    """Molecules of texts as atoms and bonds of one frame each, with places on a line."""
    atoms, bonds = [], []
    for f, t in enumerate(texts):
        m = smiles.molecule(t)
        atoms += [(f, 10 * k + 1, a.element, float(k), float(k * k % 7), float(k % 3)) for k, a in enumerate(m.atoms)]
        bonds += [(f, min(10 * i + 1, 10 * j + 1), max(10 * i + 1, 10 * j + 1), k, o) for k, (i, j, o, _) in enumerate(m.bonds)]
    return spark.createDataFrame(atoms, "frame_id long, id long, element string, x double, y double, z double"), spark.createDataFrame(bonds, "frame_id long, i long, j long, place long, bond_order double")


TEXTS = ["C1CC1CCO", "CC.CC", "C1CC2CCC1CC2", "N", "CC(=O)C=CC"]


def test_tables(spark):
    scratch = Scratch(spark, "test")
    atoms, bonds = frames(spark, TEXTS)
    a, b = molecules.split(atoms, bonds, scratch)
    found = molecules.rings(a, b)
    assert sorted((r.frame_id, r.size) for r in found.collect()) == [(0, 3), (2, 6), (2, 6)]
    inside = {(r.frame_id, r.id): (r.n_rings, r.smallest) for r in molecules.ring_membership(found, a).collect()}
    assert inside[0, 1] == (1, 3) and inside[0, 41] == (0, None) and len(inside) == atoms.count()
    assert sorted((r.frame_id, r.i, r.j) for r in molecules.rotatable(a, b, scratch).collect()) == [(0, 21, 31), (0, 31, 41), (4, 11, 31)]
    n = {(r.frame_id, r.id): r.n_h for r in molecules.implicit_hydrogens(atoms, bonds).collect()}
    assert n[3, 1] == 3 and n[0, 1] == 2 and n[4, 11] == 0
    more, links = molecules.add_hydrogens(atoms, bonds, scratch)
    assert more.where("frame_id = 3").count() == 4 and [r.id for r in more.where("frame_id = 3").orderBy("id").collect()] == [1, 2, 3, 4] and links.where("frame_id = 3").count() == 3
    less, kept = molecules.remove_hydrogens(more, links)
    assert less.count() == atoms.count() and kept.count() == bonds.count()
    q = {(r.frame_id, r.id): r.charge for r in molecules.partial_charges(a, b).collect()}
    assert len(q) == atoms.count() and q[0, 51] < -0.3
    assert {r.stereo for r in molecules.double_bond_stereo(atoms, bonds).collect()} <= {"Z", "E", "Either"}
    assert molecules.rings(a.limit(0), b.limit(0)).count() == 0


def test_downstream(spark, monkeypatch):
    scratch, (atoms, bonds) = Scratch(spark, "test"), frames(spark, [*TEXTS, "CCCCC", "CC(C)C(O)CC"])
    a, b = molecules.split(atoms, bonds, scratch)
    old = molecules.each(a, b, "i bigint, j bigint, ids array<bigint>", lambda m, ids: [(ids[m.bonds[k][0]], ids[m.bonds[k][1]], [ids[x] for x in M.downstream(m, *m.bonds[k][:2])]) for k in M.rotatable(m)])
    want = sorted(tuple(r) for r in old.collect())
    monkeypatch.setattr(molecules, "each", None)  # not one call of Python for each molecule
    for most in (1_000_000, 3):
        monkeypatch.setattr(molecules, "SIDE_ATOMS", most)
        assert sorted(tuple(r) for r in molecules.downstream(bonds, scratch).collect()) == want and len(want) > 6
    assert molecules.downstream(bonds.limit(0), scratch).count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, "CCO", 5), (2, "C1C", 6), (3, None, 7), (4, "CCO", 8), (5, "", 9)], "k long, smiles string, atom int")
    a, b = molecules.parse(df)
    assert a.count() == 6 and b.count() == 4 and {r.k for r in a.collect()} == {1, 4}
    assert {r.k for r in molecules.faults(df).where("fault is not null").collect()} == {2, 3, 5}
    assert molecules.matches(df, "CO").count() == 2 and molecules.matches(df.limit(0), "C").count() == 0
    with pytest.raises(smiles.NotationError):
        molecules.matches(df, "[")
    assert molecules.chiral_centres(*frames(spark, ["C(N)(O)(F)Cl"])).where(F.col("stereo") != "Unspecified").count() == 1
