from orbitlake.operators import neighbors
from tests.test_molecules import cube, pts


def test_free_box_narrower_than_the_cutoff(spark):
    at = [0.1, 2.5, -2.8, 3.1, 6.2]
    expected = {(i, j) for i in range(5) for j in range(i + 1, 5) if abs(at[i] - at[j]) <= 3.0}
    p = pts(spark, [(x, 0.5, 0.5) for x in at])
    assert {(r.i, r.j) for r in neighbors.pairs_self(p, cube(spark, 1.0, False), 3.0).collect()} == expected
    assert neighbors.pairs_cross(p, p, cube(spark, 1.0, False), 3.0).count() == 2 * len(expected) + 5
