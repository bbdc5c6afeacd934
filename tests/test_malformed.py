from orbitlake.operators.malformed import rejects, typed_rows

LINES = [
    (1, "lammps_full", "1 0 ct 0.5 1 2. .3e1 # note", None), (2, "lammps_full", "1 0 ct 0.5 1 2 3 0 -1 +1", None), (3, "lammps_full", "1 0 ct 0.5 1 2", "columns"), (4, "lammps_atomic", "0 1 1 2 3", "value"), (5, "lammps_atomic", "1 1 1 2 NaN", "value"),
    (6, "csv", '1,,"a,""b",,1,2,3', None), (7, "csv", '1,,a"b,,1,2,3', "quoting"), (8, "csv", "1,,ab,,1,2", "columns"), (9, "csv", "2147483648,,ab,,1,2,3", "value"), (10, "csv", '"1" , 7 ,x, -1 ,1,2,3', None),
    (11, "pdb_atom", "ATOM      1  CA  SOL A   1       1.000   2.000   3.000", None), (12, "pdb_atom", "ATOM      1  CA", "columns"), (13, "pdb_atom", "ATOM      0  CA  SOL A   1       1.000   2.000   3.000", "value"),
    (14, "sdf_bond", "  1  2  9", "value"), (15, "sdf_bond", "  1  2  8", None), (16, "sdf_bond", "", 0), (17, "csv", "  # remark", 0), (18, "csv", None, 0), (19, "unknown", "x", "columns"), (20, "lammps_atomic", "1 " + "a" * 50_000 + " 1 2 3", None),
]


def frame(spark, rows):
    return spark.createDataFrame([(a, "f", b, c, "clash") for a, b, c, _ in rows], "line_id long, file_code string, layout string, line string, reason string").drop("reason")


def test_reasons(spark):
    got = {r.line_id: r.reason for r in rejects(frame(spark, LINES)).collect()}
    assert got == {a: r for a, _, _, r in LINES if r}


def test_typed(spark):
    got = {r.line_id: r for r in typed_rows(frame(spark, LINES)).collect()}
    assert set(got) == {a for a, _, _, r in LINES if r is None}
    assert got[6].atom_type == 'a,"b' and got[6].molecule_id is None and got[6].charge is None and got[1].z == 3.0 and got[15].bond_order == 8 and got[11].id == 1


def test_empty(spark):
    assert rejects(frame(spark, LINES[:1]).limit(0)).count() == 0


def test_empty_first_field_counts(spark):
    lines = [(1, "csv", ",28720,,N.am,,1,2,3", "columns"), (2, "csv", ",1,ab,,1,2,3", "value"), (3, "csv", ",,,,,,", "value"), (4, "csv", ",", "columns"), (5, "csv", '1,,ab,,1,2,"3\n"', "value")]
    got = {r.line_id: r.reason for r in rejects(frame(spark, lines)).collect()}
    assert got == {a: r for a, _, _, r in lines}


def test_long_fields(spark):
    long = "y" * 1_000_000
    digits, quotes = "1" * 1_000_000, '""' * 500_000
    lines = [(1, "csv", f'1,,"a{long}{quotes}",,1,2,3', None), (2, "csv", f'1,,"a{quotes},,1,2,3', "quoting"), (3, "csv", f"1,,a,,{digits}x,2,3", "value"), (4, "csv", f"1,,a,,{digits},2,3", None), (5, "csv", "," * 1_000_000, "columns")]
    lines += [(10 + k, name, f"{long} {digits}x", "columns") for k, name in enumerate(("lammps_atomic", "lammps_charge", "lammps_molecular", "lammps_full"))]
    lines += [(20, "lammps_atomic", f"{digits} {long} {digits}x 1 2", "value"), (21, "pdb_atom", "ATOM  " + long, "value"), (22, "sdf_bond", long, "value"), (23, "lammps_atomic", "1 1 1 2 3" + "\r" * 1_000_000 + "x", "value")]
    got = {r.line_id: r.reason for r in rejects(frame(spark, lines)).collect()}
    assert got == {a: r for a, _, _, r in lines if r}


def test_one_value_in_most_rows(spark):
    rows = [(k, "sdf_bond", f"  1  2  {9 if k % 3 else 1}", "value" if k % 3 else None) for k in range(3000)]
    rows += [(5000 + k, "lammps_atomic", f"{k} 1 1 2 3", None if k else "value") for k in range(2500)]
    got = {r.line_id: r.reason for r in rejects(frame(spark, rows)).collect()}
    assert got == {a: r for a, _, _, r in rows if r}
