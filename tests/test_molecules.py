import math

import pytest

from orbitlake.functions import box as B
from orbitlake.functions.regions import Shell, Sphere
from orbitlake.operators import analysis, blocks, forcefield, neighbors, topology
from orbitlake.runtime import Scratch

BOX = "frame_id long, box_h array<array<double>>, box_origin array<double>, box_pbc array<boolean>"


def cube(spark, size, pbc=True):
    return B.boxes(spark.createDataFrame([(1, [[size, 0.0, 0.0], [0.0, size, 0.0], [0.0, 0.0, size]], [0.0] * 3, [pbc] * 3), (2, None, None, None)], BOX))


def pts(spark, rows, frame=1):
    return spark.createDataFrame([(frame, k, *map(float, r), "C") for k, r in enumerate(rows)], "frame_id long, id long, x double, y double, z double, element string")


def test_periodic_pairs(spark):
    p = neighbors.pairs_self(pts(spark, [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (3.9, 3.8, 3.7)]), cube(spark, 4.0), 0.5)
    assert [(r.i, r.j) for r in p.collect()] == [(0, 1)]


def test_collinear_free(spark):
    assert neighbors.pairs_self(pts(spark, [(1, 5, 5), (2, 5, 5), (4, 5, 5), (3, 5, 5)]), cube(spark, 10.0, False), 2.01).count() == 5


def test_cross_and_own_image(spark):
    ref = pts(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    assert neighbors.pairs_cross(pts(spark, [(0.5, 0, 0)]), ref, cube(spark, 4.0), 0.6).count() == 2
    assert neighbors.pairs_self(ref.limit(0), cube(spark, 4.0), 0.6).count() == 0


def test_clusters(spark):
    p = pts(spark, [(1, 1, 1), (1.5, 1, 1), (19.5, 1, 1), (10, 10, 10), (10.5, 10, 10), (5, 5, 5)])
    got = analysis.clusters(neighbors.pairs_self(p, cube(spark, 20.0), 2.0), p, Scratch(spark, "test"), 2)
    assert {r.id: r.cluster_id for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: -1}


def test_moments(spark):
    p = pts(spark, [(1, 3, 1), (0.9, 2.9, 1)])
    m = analysis.group_moments(analysis.relative(p, ["frame_id"], cube(spark, 20.0)), ["frame_id"]).first()
    assert math.isclose(m.gxx, 0.0025, abs_tol=1e-12) and math.isclose(m.gxy, 0.0025, abs_tol=1e-12)
    assert math.isclose(m.rg**2, (m.ixx + m.iyy + m.izz) / (2 * m.mass), rel_tol=1e-9)


def test_msd(spark):
    t = spark.createDataFrame([(s, p, float(s), 0.0, 0.0) for s in range(4) for p in range(3)], "step int, particle int, x double, y double, z double")
    assert {r.step: r.msd for r in analysis.msd(t)[1].collect()} == {0: 0.0, 1: 1.0, 2: 4.0, 3: 9.0}


def test_topology(spark):
    star = spark.createDataFrame([(1, 0, k) for k in (1, 2, 3, 4)] + [(1, 1, 0), (1, 2, 2), (1, 3, None), (1, 0, 9)], "frame_id long, atom_i int, atom_j int")
    e = topology.edges(star, pts(spark, [(k, 0, 0) for k in range(5)]))
    assert (topology.angles(e).count(), topology.dihedrals(e).count(), topology.impropers(e).count()) == (6, 0, 4)
    ethane = spark.createDataFrame([(1, a, b) for a, b in ((0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (1, 6), (1, 7))], "frame_id long, atom_i int, atom_j int")
    e = topology.edges(ethane, pts(spark, [(k, 0, 0) for k in range(8)]))
    assert (topology.angles(e).count(), topology.dihedrals(e).count()) == (12, 9)


def test_unknown_type_raises(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "type string")
    ff = forcefield.ForceField("t").define("bond", "harmonic", "a", k0=1.0, r0=1.0)
    with pytest.raises(Exception, match="no parameters for type z"):
        forcefield.with_parameters(rows, ff.table(spark, "bond", "harmonic")).collect()
    with pytest.raises(KeyError):
        ff.types("bond", "other")


def test_regions():
    both = Sphere((0, 0, 0), 2.0) & Shell((1, 0, 0), 0.5, 1.0)
    assert both.bounds() == [(0.0, 2.0), (-1.0, 1.0), (-1.0, 1.0)]
    assert (~both).bounds() == both.bounds()


def test_blocks(spark):
    b = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "b")], "atom_idx int, x double, s string")
    assert sorted(tuple(r) for r in blocks.resize(b, 3).collect()) == [(0, 1.0, "a"), (1, 2.0, "b"), (2, 0.0, "")]
    assert blocks.resize(b, 1).count() == 1 and blocks.resize(b, 0).count() == 0
    assert sorted(r.atom_idx for r in blocks.merge(b, b).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        blocks.merge(b, b.drop("s"))
    with pytest.raises(ValueError):
        blocks.rename(b, "x", "s")
