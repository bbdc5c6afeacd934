import math

from orbitlake.plans import molecules

ATOMS = "frame_id long, id int, molecule_id int, element string, charge double, x double, y double, z double, recorded_at timestamp, ingested_at timestamp"
FRAMES = "frame_id long, box_h array<array<double>>, box_origin array<double>, box_pbc array<boolean>"


def folder(spark, tmp_path, positions):
    spark.createDataFrame([(1, k, 1, "C", 0.0, *map(float, p), None, None) for k, p in enumerate(positions)], ATOMS).write.parquet(f"{tmp_path}/atoms.parquet")
    spark.createDataFrame([(1, None, None, None)], FRAMES).write.parquet(f"{tmp_path}/frames.parquet")
    return str(tmp_path)


def test_lj_keeps_close_contacts(spark, tmp_path):
    positions = [(0, 0, 0), (0.3, 0, 0), (0.3, 0, 0), (2.0, 0, 0), (9, 9, 9)]
    expected = 0.0
    for i in range(5):
        for j in range(i + 1, 5):
            r2 = sum((a - b) ** 2 for a, b in zip(positions[i], positions[j]))
            if 1e-24 <= r2 <= molecules.CUTOFF**2:
                epsilon, sigma = ((0.1, 1.5), (0.2, 1.2))[(i + j) % 2]
                expected += 4 * epsilon * ((sigma**2 / r2) ** 6 - (sigma**2 / r2) ** 3)
    got = {r.frame_id: r.energy for r in molecules.energy_lj(spark, folder(spark, tmp_path, positions)).collect()}
    assert set(got) == {1} and expected > 1e5 and math.isclose(got[1], expected, rel_tol=1e-9)
