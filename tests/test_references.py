import datetime as dt

import pytest

from orbitlake.operators.references import orphan_references, orphans


def test_match_semantics(spark):
    refs = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, 9, None), (4, None, None), (5, 9, 9), (5, 9, 9)], "k int, a int, b int")
    there = spark.createDataFrame([(1, 1, 5), (1, 1, 6)], "a int, b int, k int")
    ids = lambda m: sorted(r.k for r in orphans(refs, there, ["a", "b"], m).collect())
    assert ids("simple") == [5, 5]
    assert ids("partial") == [3, 5, 5]
    assert ids("full") == [2, 3, 5, 5]
    with pytest.raises(ValueError):
        orphans(refs, there, ["a", "b"], "other")


def test_empty_targets(spark):
    refs = spark.createDataFrame([(1, 1)], "a int, b int")
    assert orphans(refs, refs.limit(0), ["a", "b"]).count() == 1
    assert orphans(refs.limit(0), refs, ["a", "b"]).count() == 0


def test_periods(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    atoms = spark.createDataFrame([(1, 1, t(2)), (1, 1, t(5)), (1, 2, t(1))], "frame_id long, id int, recorded_at timestamp_ntz")
    drops = spark.createDataFrame([(1, 2, t(4)), (1, 2, t(4)), (1, 8, t(1))], "frame_id long, id int, deleted_at timestamp_ntz")
    bonds = spark.createDataFrame([(10, 1, 1, 2, t(1)), (11, 1, 1, 2, t(4)), (12, 1, 1, None, t(3)), (13, 1, 8, 0, t(3)), (10, 1, 1, 2, t(1))], "bond_id long, frame_id long, atom_i int, atom_j int, recorded_at timestamp_ntz")
    angles = spark.createDataFrame([], "angle_id long, frame_id long, atom_i int, atom_j int, atom_k int, recorded_at timestamp_ntz")
    conect = spark.createDataFrame([(20, 1, [2, 0, None, 9, 9], t(3)), (21, 1, None, t(3))], "conect_id long, frame_id long, bonded array<int>, recorded_at timestamp_ntz")
    got = sorted((r.tab, r.row_id, r.ref_field, r.atom_id, r.orphan_kind, r.rec_month) for r in orphan_references(atoms, drops, bonds, angles, conect).collect())
    assert got == [("bonds", 10, "atom_i", 1, "late", "2024-01"), ("bonds", 11, "atom_j", 2, "deleted", "2024-01"), ("bonds", 13, "atom_i", 8, "missing", "2024-01"), ("conect", 20, "bonded", 9, "missing", "2024-01")]
