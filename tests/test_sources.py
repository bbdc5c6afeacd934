import pytest

from orbitlake.sources import formats


def test_dump(spark, tmp_path):
    (tmp_path / "a.dump").write_text(
        "ITEM: UNITS\nmetal\nITEM: TIMESTEP\n10\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS ff pp ss\n0 4\n0 5\n0 6\nITEM: ATOMS id type x y z\n1 1 0.5 1 2\n2 1 1.5 1 2\n"
        "ITEM: TIMESTEP\n20\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0 5 1\n0 5 0\n0 6 0\nITEM: ATOMS id x q\n7 1.0 0.1\n"
    )
    rows = formats.read_dump(spark, str(tmp_path / "a.dump")).collect()
    assert sorted((r.step, r.atom["id"]) for r in rows) == [(10, "1"), (10, "2"), (20, "7")]
    last = next(r for r in rows if r.step == 20)
    assert last.box_hi[0] == 4.0 and last.tilt == [1.0, 0.0, 0.0] and last.pbc == [True] * 3 and last.atom["q"] == "0.1"
    assert next(r for r in rows if r.step == 10).pbc == [False, True, False]


def test_xyz():
    rows = formats.parse_xyz('\n2\nLattice="1 0 0 0 1 0 0 0 1" Properties=species:S:1:pos:R:3:v:R:2 ok\nO 0 0 0 1 2\nH 1 0 0 3 4\n1\nplain\nC 1 2 3\n')
    assert [(r[0], r[2], r[3]) for r in rows] == [(0, "O", 0.0), (0, "H", 1.0), (1, "C", 1.0)]
    assert rows[1][6] == {"v_1": "3", "v_2": "4"} and rows[0][7]["ok"] == "true" and rows[2][7] == {}
    with pytest.raises(ValueError, match="ends early"):
        formats.parse_xyz("3\n\nC 1 2 3\n")
    with pytest.raises(ValueError, match="values for"):
        formats.parse_xyz("1\n\nC 1 2\n")


def test_pdb_and_sdf(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("CRYST1\nHETATM    1  CA  MOL A   1       1.000   2.000   3.000\nATOM      2\nHETATM    3  OW  MOL A   1       1.000   2.000   3.500  1.00  0.00           O\nEND\n")
    got = formats.read_pdb(spark, str(tmp_path / "a.pdb")).collect()
    assert [(r.serial, r.element, r.z) for r in got] == [(1, "C", 3.0), (3, "O", 3.5)]
    record = "m1\n  x\n\n  2  1  0  0  0  0            999 V2000\n    0.0000    0.0000    0.0000 C   0  0\n    1.2000    0.0000    0.0000 O   0  0\n  1  2  2  0\nM  END\n$$$$\n"
    (tmp_path / "a.sdf").write_text(record + record.replace("m1", "m2"))
    atoms, bonds = formats.read_sdf(spark, str(tmp_path / "a.sdf"))
    assert sorted((r.title, r.id, r.element, r.x) for r in atoms.collect()) == [("m1", 1, "C", 0.0), ("m1", 2, "O", 1.2), ("m2", 1, "C", 0.0), ("m2", 2, "O", 1.2)]
    assert sorted(tuple(r) for r in bonds.collect()) == [("m1", 0, 1, 2), ("m2", 0, 1, 2)]
