import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake import compute
from orbitlake.frame import Frame, Record
from orbitlake.functions import box as B
from orbitlake.operators import electrostatics, forcefield, neighbors
from orbitlake.runtime import Scratch, shared_folder
from orbitlake.sources import volumes
from orbitlake.streaming import incremental

CUBE = "title\nsecond\n 2 0.0 0.0 0.0\n 2 1.0 0 0\n 1 0 1.0 0\n 3 0 0 1.0\n 8 8.0 0.0 0.0 1.0\n 1 1.0 0.5 0.5 0.5\n 1 2 3\n 4 5 6\n"


def test_cube():
    rows = volumes.cube_rows(CUBE)
    atoms, voxels = [r for r in rows if r[0] == "atom"], [r for r in rows if r[0] == "voxel"]
    assert [a[5] for a in atoms] == ["O", "H"] and math.isclose(atoms[0][8], volumes.BOHR) and [v[10] for v in voxels] == [1, 2, 3, 4, 5, 6] and math.isclose(voxels[0][4][0], 2 * volumes.BOHR)
    orbitals = CUBE.replace(" 2 0.0 0.0 0.0", " -2 0.0 0.0 0.0").replace(" 2 1.0 0 0", " -2 1.0 0 0").replace(" 1 2 3\n 4 5 6\n", " 2 7 9\n" + " ".join(map(str, range(12))))
    rows = [r for r in volumes.cube_rows(orbitals) if r[0] == "voxel"]
    assert [r[10] for r in rows if r[1] == "mo_9"] == [1, 3, 5, 7, 9, 11] and rows[0][4][0] == 2.0
    with pytest.raises(ValueError):
        volumes.cube_rows(CUBE.replace("6\n", "\n"))


CHGCAR = "cell\n 2.0\n 1 0 0\n 0 1 0\n 0 0 1\n O H\n 1 1\nDirect\n 0.5 0.5 0.5\n 0 0 0.25\n\n 2 1 3\n 1 2 3 4 5\n 6\naugmentation occupancies 1 2\n 0.1 0.2\n 2 1 3\n 6 5 4 3 2 1\n"


def test_chgcar():
    rows = volumes.chgcar_rows(CHGCAR)
    total = [r[10] for r in rows if r[1] == "total"]
    assert total == [1, 3, 5, 2, 4, 6] and [r[10] for r in rows if r[1] == "diff"] == [6, 4, 2, 5, 3, 1]
    assert [r[5:9] for r in rows if r[0] == "atom"] == [("O", 1.0, 1.0, 1.0), ("H", 0.0, 0.0, 0.5)]
    assert volumes.chgcar_rows(CHGCAR.replace(" 2.0\n", " -27.0\n", 1))[0][6] == pytest.approx(1.5)
    with pytest.raises(ValueError):
        volumes.chgcar_rows(CHGCAR.split("\n\n")[0] + "\n")


DATA = """a file

 3 atoms
 1 bonds
0 10 xlo xhi
-1 9 ylo yhi
0 5 zlo zhi
1 0 0.5 xy xz yz

Masses

1 1.0

Atom Type Labels

1 H
2 O

Atoms # full

1 1 1 0.4 1 2 3
2 1 2 -0.8 2 2 3 0 0 1
3 0 1 0.4 0 0 0

Bonds

1 1 1 2
"""


def test_data():
    rows = volumes.data_rows(DATA)
    assert rows[0][9] == [0, 10, -1, 9, 0, 5, 1, 0, 0.5] and rows[2][:8] == ("atom", 2, 1, "O", -0.8, 2, 2, 3) and rows[-1][8] == [1, 2]
    with pytest.raises(ValueError):
        volumes.data_rows(DATA.replace("1 1 1 2\n", "1 1 1 9\n"))


def test_files_of_a_folder(spark, tmp_path):
    for k, t in enumerate((CUBE, CUBE.replace("6\n", "7\n"))):
        (tmp_path / f"{k}.cube").write_text(t)
    got = volumes.read_cube(spark, str(tmp_path / "*.cube"))
    assert got.where("kind = 'voxel'").groupBy("path").agg(F.sum("value").alias("s")).orderBy("s").toPandas()["s"].tolist() == [21.0, 22.0]


def test_frame_and_record(spark):
    atoms = spark.createDataFrame([(1, 1, 0.5), (1, 2, 1.5), (2500, 1, 2.5)], "frame_id long, id long, x double")
    bonds = spark.createDataFrame([(1, 1, 2)], "frame_id long, i long, j long")
    f = Frame({"atoms": atoms, "bonds": bonds}, {"title": "t"})
    assert f.get("atoms", "x", "string") is None and f.get("atoms", "x", "double").count() == 3 and f.count_frames() == 2 and Frame().count_frames() == 1
    assert f.rename_column("atoms", "x", "id") is False and f.rename_column("atoms", "x", "y") and f.remove_column("atoms", "y") and not f.remove_column("atoms", "y")
    f.with_column("atoms", "x", atoms.select("frame_id", "id", "x"), ["frame_id", "id"])
    assert f.blocks["atoms"].agg(F.sum("x")).first()[0] == 4.5
    g = Frame(dict(f.blocks), {})
    g.with_column("atoms", "w", atoms.limit(1).select("frame_id", "id", F.col("x").alias("w")), ["frame_id", "id"])
    with pytest.raises(Exception, match="differ in length"):
        g.blocks["atoms"].collect()
    m = f.merge(Frame({"atoms": f.blocks["atoms"], "bonds": bonds}), {"bonds": ["i", "j"]})
    assert sorted(r.id for r in m.blocks["atoms"].where("frame_id = 1").collect()) == [1, 2, 3, 4] and sorted((r.i, r.j) for r in m.blocks["bonds"].collect()) == [(1, 2), (3, 4)]
    less = f.remove_atoms(spark.createDataFrame([(1, 2)], "frame_id long, id long"), {"bonds": ["i", "j"]})
    assert less.blocks["bonds"].count() == 0 and less.blocks["atoms"].count() == 2
    r = Record(f, {"units": "real"})
    r.add_observable("energy", "scalar", spark.createDataFrame([(1, 3.0)], "frame_id long, value double"))
    with pytest.raises(ValueError):
        r.add_observable("e", "scalar", atoms)
    with pytest.raises(ValueError):
        r.add_observable("e", "tensor", atoms)
    path = f"{shared_folder(spark)}/record-test-{spark.sparkContext.startTime}"
    r.write(spark, path)
    back = Record.read(spark, path)
    assert back.meta == {"units": "real"} and back.frame.blocks["atoms"].count() == 3 and back.observables["energy"][1].first().value == 3.0
    one = Record.read(spark, path, 2500).frame.blocks["atoms"]
    assert one.count() == 1 and "frame_part" in one._jdf.queryExecution().executedPlan().toString()
    Record.append(atoms.withColumn("frame_id", F.lit(9000).cast("long")), path, "atoms")
    assert Record.read(spark, path).frame.blocks["atoms"].count() == 6
    with pytest.raises(ValueError):
        Record(f, {"units": "furlongs"}).write(spark, path + "x")
    f.clear()
    assert not f.blocks and f.meta
    f.clear_all()
    assert not f.meta


def test_graph(spark):
    g, calls = compute.Graph(), []
    a = g.input("a")

    def double(df):
        calls.append(1)
        return df.select((F.col("id") * 2).alias("id"))

    two = g.add("two", double, a)
    g.add("x", lambda df: df.agg(F.sum("id").alias("s")), two)
    g.add("y", lambda df: df.agg(F.max("id").alias("s")), two)
    out = g.run(spark, a=spark.range(5))
    assert out["x"].first().s == 20 and out["y"].first().s == 8 and len(calls) == 1 and g.order() == ["two", "x", "y"]
    with pytest.raises(compute.ComputeError, match="no input a"):
        g.run(spark)
    g.add("bad", lambda df: df.select("nothing"), two)
    with pytest.raises(compute.ComputeError, match="node bad"):
        g.run(spark, a=spark.range(5))
    with pytest.raises(ValueError):
        g.add("two", double, a)
    with pytest.raises(ValueError):
        g.add("z", double, compute.Slot("q"))


def ewald(q, x, length, alpha):
    """Brute force: direct sum over images and reciprocal sum over waves."""
    total = -alpha / math.sqrt(math.pi) * (q**2).sum()
    for n in np.ndindex(5, 5, 5):
        shift = (np.array(n) - 2) * length
        for i in range(len(q)):
            for j in range(len(q)):
                r = np.linalg.norm(x[j] - x[i] + shift)
                if r > 1e-9:
                    total += 0.5 * q[i] * q[j] * math.erfc(alpha * r) / r
    for n in np.ndindex(21, 21, 21):
        m = (np.array(n) - 10) / length
        m2 = (m**2).sum()
        if m2 > 0:
            s = (q * np.exp(2j * np.pi * (x @ m))).sum()
            total += math.exp(-((math.pi / alpha) ** 2) * m2) / m2 * abs(s) ** 2 / (2 * math.pi * length**3)
    return electrostatics.COULOMB * total


def test_mesh_against_lattice_sum(spark):
    rnd = np.random.default_rng(3)
    length, alpha, q = 8.0, 0.9, np.array([1.0, -1.0, 0.5, -0.5])
    x = rnd.random((4, 3)) * length
    frames = spark.createDataFrame([(1, [[length, 0.0, 0.0], [0.0, length, 0.0], [0.0, 0.0, length]], [0.0] * 3, [True] * 3)], "frame_id long, box_h array<array<double>>, box_origin array<double>, box_pbc array<boolean>")
    boxes = B.boxes(frames)
    charges = spark.createDataFrame([(1, k, *map(float, x[k]), float(q[k])) for k in range(4)], "frame_id long, id long, x double, y double, z double, q double")
    pairs = neighbors.pairs_self(charges.drop("q"), boxes, 4.0)
    got = electrostatics.pme_energy(charges, boxes, pairs, alpha, order=6).first().energy
    assert got == pytest.approx(ewald(q, x, length, alpha), rel=2e-3)
    first = pairs.orderBy("i", "j").first()
    one = pairs.where((F.col("i") == first.i) & (F.col("j") == first.j))
    out = electrostatics.pme_energy(charges, boxes, pairs, alpha, order=6, excluded=one).first().energy
    assert got - out == pytest.approx(electrostatics.COULOMB * q[first.i] * q[first.j] / math.sqrt(first.dist_sq), rel=1e-3)
    assert electrostatics.spline(4, 0.3).sum() == pytest.approx(1) and electrostatics.spline(2, 0.3).tolist() == [0.3, 0.7]


XML = '<ForceField name="f"><BondStyle name="harmonic"><Type type1="A" type2="B" k0="2" r0="1" note="x"/></BondStyle><AngleStyle name="harmonic"><Type type="q" k0="3" theta0="2"/></AngleStyle></ForceField>'


def test_force_field(spark):
    ff = forcefield.read_xml(XML)
    assert ff.types("bond", "harmonic") == {"A-B": {"k0": 2.0, "r0": 1.0}} and forcefield.from_json(forcefield.to_json(ff)).styles == ff.styles
    pts = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 3.0, 0.0, 0.0), (1, 3, 3.0, 1.0, 0.0)], "frame_id long, id long, x double, y double, z double")
    bonds = spark.createDataFrame([(1, 1, 2, "A-B")], "frame_id long, i long, j long, type string")
    angles = spark.createDataFrame([(1, 1, 2, 3, "q")], "frame_id long, i long, j long, k long, type string")
    terms = {("bond", "harmonic"): bonds, ("angle", "harmonic"): angles}
    assert forcefield.compiled(ff, terms, pts).first().energy == pytest.approx(4.0 + 1.5 * (math.pi / 2 - 2) ** 2)
    with pytest.raises(ValueError):
        forcefield.compiled(ff, {("bond", "harmonic"): bonds}, pts)
    with pytest.raises(KeyError):
        forcefield.compiled(forcefield.ForceField("g", {("bond", "odd"): {"a": {}}}), terms, pts)
    with pytest.raises(Exception, match="no parameters"):
        forcefield.compiled(ff, terms | {("bond", "harmonic"): bonds.withColumn("type", F.lit("C"))}, pts).collect()
    rows = forcefield.placed(angles, pts, ["i", "j", "k"])
    f = {r.id: (r.fx, r.fy, r.fz) for r in forcefield.bend_forces(rows, F.lit(1.0)).collect()}
    assert f[1] == pytest.approx((0.0, 1 / 3, 0.0)) and f[3] == pytest.approx((-1.0, 0.0, 0.0)) and sum(v[0] for v in f.values()) == pytest.approx(0)
    types = [{"alpha": 1.05, "n": 2.49, "a": 3.89, "g": 1.282}, {"alpha": 0.25, "n": 0.8, "a": 4.2, "g": 1.209}]
    table = spark.createDataFrame([(str(k), *[t[c] for c in ("alpha", "n", "a", "g")]) for k, t in enumerate(types)], "type string, alpha double, n double, a double, g double")
    got = {(r.type_i, r.type_j): (r.epsilon, r.r0) for r in forcefield.pair_parameters(table).collect()}
    assert got["0", "1"] == pytest.approx(forcefield.combined(*types)) and got["1", "0"] == pytest.approx(got["0", "1"]) and got["0", "0"][1] == pytest.approx(3.89 * 1.05**0.25)


def test_streams(spark, tmp_path):
    schema = "particle long, step long, x double, y double, z double, dist_sq double"
    folder = f"{shared_folder(spark)}/stream-test-{spark.sparkContext.startTime}"
    for step in range(3):
        spark.createDataFrame([(p, step, float(p + step), 0.0, 0.0, 0.01 + step) for p in range(4)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = incremental.displacements(stream).writeStream.format("memory").queryName("moved").outputMode("append").option("checkpointLocation", f"{folder}-c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.step: r.msd for r in incremental.msd(spark.table("moved")).collect()} == {0: 0.0, 1: 1.0, 2: 4.0}
    q = incremental.rdf_counts(stream, 3, 1.5).writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", f"{folder}-c2").trigger(availableNow=True).start()
    q.awaitTermination()
    counts = spark.table("bins")
    assert {r.bin: r.n_r for r in counts.collect()} == {0: 4, 2: 8}
    sizes = spark.createDataFrame([(3, 12, 300.0)], "n_frames long, sum_n long, sum_volume double")
    g = incremental.rdf(counts, sizes, 3, 1.5).orderBy("bin").collect()
    assert [r.n_r for r in g] == [4, 0, 8] and g[0].g == pytest.approx(2 * 4 / (4 / 100 * 4 / 3 * math.pi * 0.125 * 4 * 3))


def test_scratch_leaves_no_shuffle_setting(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    assert Scratch(spark, "test").put(spark.range(5)).count() == 5 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == before
