import math

from orbitlake.sources import formats


def test_boxes_elements_and_bonds(spark, tmp_path):
    rows = [(1, k, e, e, float(k), 0.0, 0.0) for k, e in enumerate(["C", "H", "H", "H", "Cl", "O"], 1)] + [(1, 205_000, "Na", "Na", 9.0, 0.0, 0.0), (2, 1, "O", "O", 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "model long, serial long, name string, element string, x double, y double, z double")
    boxes = spark.createDataFrame([(1, 10.0, 11.5, 12.25, 90.0, 90.0, 60.0)], "model long, a double, b double, c double, alpha double, beta double, gamma double")
    bonds = {(1, k) for k in (2, 3, 4, 5, 6)} | {(5, 205_000)}
    path = str(tmp_path / "out.pdb")
    formats.write_pdb(atoms, path, boxes, spark.createDataFrame([(1, *b) for b in bonds], "model long, i long, j long"))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert "CONECT    1    2    3    4    5" in lines and "CONECT    1    6" in lines
    assert {(r.model, r.serial, r.element) for r in formats.read_pdb(spark, path).collect()} == {(m, s, e) for m, s, e, *_ in rows}
    assert {tuple(r) for r in formats.read_pdb_bonds(spark, path).collect()} == {(1, *b) for b in bonds}
    (box,) = formats.read_pdb_boxes(spark, path).collect()
    assert (box.model, box.a, box.b, box.c, box.gamma) == (1, 10.0, 11.5, 12.25, 60.0) and math.isclose(box.box_h[0][1], 5.75) and math.isclose(box.box_h[2][2], 12.25)


def test_records_of_the_whole_file(spark, tmp_path):
    atom = "HETATM%5d  C   MOL A   1       1.000   2.000   3.000\n"
    (tmp_path / "a.pdb").write_text("CRYST1   50.000   60.000   70.000  90.00  90.00  90.00 P 1           1\n" + "".join(f"MODEL        {m}\n" + atom % 1 + atom % 2 + "ENDMDL\n" for m in (1, 2)) + "CONECT    1    2    7\nCONECT    2    1\nEND\n")
    assert {tuple(r) for r in formats.read_pdb_bonds(spark, str(tmp_path)).collect()} == {(1, 1, 2), (2, 1, 2)}
    assert {(r.model, r.a, r.c) for r in formats.read_pdb_boxes(spark, str(tmp_path)).collect()} == {(1, 50.0, 70.0), (2, 50.0, 70.0)}
