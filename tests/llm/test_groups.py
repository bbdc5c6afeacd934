import random

from orbitlake.llm.groups import atom_groups, seed_tree
from orbitlake.runtime import Scratch

ATOMS = "frame_id long, id int, molecule_id int, scope string"
BONDS = "frame_id long, atom_i int, atom_j int"


def brute(atoms, bonds):
    root = {(f, i): (f, i) for f, i, _, _ in atoms if f is not None and i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    first = {}
    for f, i, m, _ in atoms:
        if (f, i) in root and m and m > 0:
            join(first.setdefault((f, m), (f, i)), (f, i))
    for f, i, j in bonds:
        if (f, i) in root and (f, j) in root:
            join((f, i), (f, j))
    return sorted((f, i, find((f, i))[1]) for f, i in root)


def check(spark, atoms, bonds):
    got = atom_groups(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS), Scratch(spark, "test"))
    assert sorted(tuple(r) for r in got.collect()) == brute(atoms, bonds)


def test_random_graph(spark):
    rnd = random.Random(3)
    atoms = [(f, i, rnd.choice([None, 0, 0, 1, 2, 3]), "x") for f in (1, 2) for i in rnd.sample(range(1, 400), 120)]
    atoms += [(1, atoms[0][1], 3, "y"), (None, 5, 1, "x"), (1, None, 1, "x"), atoms[3]]
    bonds = [(f, rnd.randrange(1, 400), rnd.randrange(1, 400)) for f in (1, 2, 3) for _ in range(150)] + [(1, 5, None), (None, 1, 2), (1, 7, 7)]
    check(spark, atoms, bonds)


def test_chain_and_star(spark):
    check(spark, [(1, i, None, "") for i in range(1, 60)] + [(2, i, 1, "") for i in range(1, 60)], [(1, i, i + 1) for i in range(1, 59)] * 2)


def test_no_links(spark):
    check(spark, [(1, 4, None, ""), (1, 2, 0, "")], [])
    check(spark, [], [])
    assert seed_tree(spark.createDataFrame([], "scope long, u long, v long"), Scratch(spark, "test")).count() == 0


def test_hot_vertices(spark, monkeypatch):
    monkeypatch.setattr("orbitlake.operators.skew.TASK_ROWS", 5)
    check(spark, [(1, i, 1 if i % 3 else None, "") for i in range(1, 90)], [(1, 1, i) for i in range(2, 90)] + [(1, i, i + 3) for i in range(40, 80)] + [(1, 60, 50)] * 40)
    check(spark, [(1, i, None, "") for i in range(1, 70)], [(1, 30, i) for i in range(1, 70)] + [(1, i, i + 1) for i in range(50, 60)])


def test_molecules_joined_by_one_atom(spark):
    check(spark, [(1, 9, 4, ""), (1, 9, 2, ""), (1, 9, 3, ""), (1, 2, 4, ""), (1, 5, 2, ""), (1, 7, 3, ""), (1, 1, 8, "")], [(1, 1, 1), (1, 3, 9)])
