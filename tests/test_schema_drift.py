import datetime as dt

from orbitlake.operators import schema_drift as D
from orbitlake.runtime import Scratch

FILES = "file_id long, stream_id string, written_at timestamp_ntz, ingested_at timestamp_ntz, n_atoms int"
SPECS = "file_id long, spec_no int, prop_name string, ty string, m int"
LINES = "file_id long, line_no int, line string"


def tables(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    files = [(1, "s", t(0), t(9), 2), (2, "s", t(80), t(1), 2), (3, "s", t(90), t(2), 2), (2, "s", t(80), t(3), 2), (4, "u", t(1), t(1), 1), (5, None, t(1), t(1), 1)]
    specs = [(1, 0, "id", "I", 1), (1, 1, "q", "R", 1), (1, 2, "flag", "L", 1), (2, 1, "charge", "r", 1), (2, 0, "id", "i", 1), (2, 2, "flag", "I", 1), (3, 0, "id", "I", 1), (3, 1, "flag", "I", 2), (3, 2, "new", "S", 1), (3, 2, "new", "S", 1), (4, 0, "id", "I", 1)]
    lines = [(1, 1, "1 0.50 T"), (1, 2, "2 1e1\tfalse"), (2, 1, "2 10.0 0"), (2, 2, "1 5.0e-1 1"), (3, 1, "1 4 5 x"), (3, 2, "7 4 5"), (4, 1, "1")]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(specs, SPECS), spark.createDataFrame(lines, LINES)


def test_changes(spark):
    got = sorted(tuple(r) for r in D.changes(*tables(spark), Scratch(spark, "test")).collect())
    assert got == [(2, "renamed", "q", "charge"), (2, "retyped", "flag", "flag"), (3, "added", "", "new"), (3, "removed", "charge", ""), (3, "resized", "flag", "flag")]


def test_union_and_table(spark):
    _, specs, lines = tables(spark)
    union = {r.name: (r.ty, r.m) for r in D.union_schema(specs).collect()}
    assert union == {"id": ("I", 1), "q": ("R", 1), "charge": ("R", 1), "flag": ("I", 2), "new": ("S", 1)}
    rows = {(r.file_id, r.line_no, r.name): r for r in D.consistent_table(specs, lines, Scratch(spark, "test")).collect()}
    assert rows[1, 1, "flag"].wholes == [1] and rows[3, 1, "new"].texts == ["x"] and rows[3, 2, "new"].texts is None and rows[3, 2, "new"].failed == [None]
    wide = {(r.file_id, r.line_no): r for r in D.wide_table(specs, lines, Scratch(spark, "test")).collect()}
    assert wide[1, 1].flag == [1] and wide[1, 1].q == 0.5 and wide[3, 1].new == "x" and wide[2, 2].charge == 0.5 and wide[4, 1].flag is None


def test_promotion_keeps_what_is_written(spark):
    specs = spark.createDataFrame([(1, 0, "id", "I", 1), (1, 1, "tag", "I", 1), (1, 2, "on", "L", 1), (1, 3, "ID", "R", 1), (2, 0, "id", "I", 1), (2, 1, "tag", "S", 1), (2, 2, "on", "S", 1)], SPECS)
    lines = spark.createDataFrame([(1, 1, "9007199254740993 7 .TRUE. +1.5D0"), (1, 2, "9007199254740992 07 x 1e"), (2, 1, "5 abc yes"), (2, 1, "5 abc yes"), (2, 2, None)], LINES)
    rows = {(r.file_id, r.line_no, r.name): r for r in D.consistent_table(specs, lines, Scratch(spark, "test")).collect()}
    assert rows[1, 1, "tag"].texts == ["7"] and rows[1, 2, "tag"].texts == ["07"] and rows[1, 1, "on"].texts == [".TRUE."] and rows[1, 1, "id"].wholes == [9007199254740993]
    assert rows[1, 1, "ID"].reals == [1.5] and rows[1, 2, "ID"].failed == ["1e"] and len([k for k in rows if k[0] == 2 and k[1] == 1]) == 3
    wide = {(r.file_id, r.line_no): r for r in D.wide_table(specs, lines, Scratch(spark, "test")).collect()}
    assert wide[1, 1].tag == "7" and {"id", "ID"} & set(wide[1, 1].asDict()) and len(wide[1, 1]) == 6


def test_large_numbers_differ_and_spellings_agree(spark):
    files = spark.createDataFrame([(k, "s", dt.datetime(2024, 1, k), None, 1) for k in (1, 2, 3)], FILES)
    specs = spark.createDataFrame([(k, 0, "id", "I", 1) for k in (1, 2, 3)] + [(k, 1, n, "I", 1) for k, n in ((1, "a"), (2, "b"), (3, "c"))], SPECS)
    lines = spark.createDataFrame([(1, 1, "1 9007199254740993"), (2, 1, "1 9007199254740992"), (3, 1, "01 9007199254740992")], LINES)
    got = sorted(tuple(r) for r in D.changes(files, specs, lines, Scratch(spark, "test")).collect())
    assert got == [(2, "added", "", "b"), (2, "removed", "a", ""), (3, "renamed", "b", "c")]


def test_empty(spark):
    files, specs, lines = tables(spark)
    assert D.changes(files.limit(0), specs.limit(0), lines.limit(0), Scratch(spark, "test")).count() == 0
