"""Queries of volumetric and data files, of the remaining force-field terms, and of the compute graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitlake import compute
from orbitlake.functions import geometry
from orbitlake.operators import analysis, electrostatics, forcefield, neighbors, topology
from orbitlake.plans import molecules as base
from orbitlake.runtime import Scratch, table
from orbitlake.sources import volumes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH g AS (SELECT field_id, any_value(shape) s, any_value(grid_values) v FROM gridfields WHERE len(grid_values) = shape[1]*shape[2]*shape[3] AND len(cell) = 9 AND grid_origin IS NOT NULL GROUP BY 1)
SELECT field_id, (unnest(range(len(v))))::BIGINT idx, unnest(v) AS value FROM g WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0""")
def cube_roundtrip(spark, d):
    """Every field without gaps, written as the text of a cube file and read again."""
    whole = (F.size("grid_values") == F.col("shape")[0] * F.col("shape")[1] * F.col("shape")[2]) & (F.size("cell") == 9) & F.col("grid_origin").isNotNull() & ~F.exists("grid_values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fields = table(spark, d, "gridfields").dropDuplicates(["field_id"]).where(whole).select("field_id", F.col("shape").alias("n"), F.col("grid_origin").alias("origin"), "cell", F.col("grid_values").alias("values"))
    none = spark.createDataFrame([], "field_id long, id long, element string, x double, y double, z double")
    back = volumes.parsed(volumes.texts(volumes.cube_lines(fields, none, "field_id"), "field_id"), "field_id", volumes.GRID, volumes.cube_rows)
    return back.where("kind = 'voxel'").select("field_id", "idx", "value")


_BOUNDS = "boxed AS (SELECT DISTINCT frame_id FROM frames WHERE box_h IS NOT NULL)"


@query(f"""WITH {base.POINTS}, {base.BOXES} SELECT p.frame_id, id, coalesce(molecule_id, 0)::BIGINT molecule_id, coalesce(nullif(trim(element), ''), 'X') AS type, CASE WHEN isfinite(charge) THEN charge ELSE 0.0 END charge, x, y, z FROM pts p JOIN boxes USING (frame_id)""")
def lammps_data_roundtrip(spark, d):
    """Atoms of all frames with a box, written as data files of style full with their bonds and read again."""
    boxes = base._boxes(spark, d)
    bounds = F.array(*[v for k in range(3) for v in (F.col(f"o{k + 1}"), F.col(f"o{k + 1}") + F.col(f"h{k + 1}{k + 1}"))], F.col("h12"), F.col("h13"), F.col("h23"))
    boxed = boxes.select("frame_id", bounds.alias("bounds"))
    charge = F.when(F.col("charge").isNotNull() & ~F.isnan("charge") & (F.abs("charge") < float("inf")), F.col("charge"))
    atoms = base._points(spark, d).join(boxed.select("frame_id"), "frame_id", "left_semi").select("frame_id", "id", "molecule_id", F.coalesce(F.nullif(F.trim("element"), F.lit("")), F.lit("X")).alias("type"), charge.alias("charge"), "x", "y", "z")
    e, _ = base._edges(spark, d)
    bonds = e.join(boxed.select("frame_id"), "frame_id", "left_semi").select("frame_id", F.pmod(F.xxhash64("i", "j"), F.lit(1 << 40)).alias("id"), F.lit("single").alias("type"), "i", "j")
    back = volumes.parsed(volumes.texts(volumes.data_lines(atoms, bonds, boxed, "frame_id"), "frame_id"), "frame_id", volumes.DATA, volumes.data_rows)
    return back.where("kind = 'atom'").select("frame_id", "id", "molecule_id", "type", "charge", "x", "y", "z")


_BENT = f"""{base.GRAPH}, t AS (SELECT a.frame_id, a.b i, a.a j, c.b k FROM arcs a JOIN arcs c ON a.frame_id = c.frame_id AND a.a = c.a AND a.b < c.b),
v AS (SELECT t.*, p.x-q.x ax, p.y-q.y ay, p.z-q.z az, r.x-q.x bx, r.y-q.y "by", r.z-q.z bz FROM t JOIN pts p ON p.frame_id=t.frame_id AND p.id=t.i JOIN pts q ON q.frame_id=t.frame_id AND q.id=t.j JOIN pts r ON r.frame_id=t.frame_id AND r.id=t.k),
w AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) r1, sqrt(bx*bx+"by"*"by"+bz*bz) r2, ax*bx+ay*"by"+az*bz c FROM v), x AS (SELECT frame_id, r1, r2, acos(greatest(-1.0, least(1.0, c/(r1*r2)))) th FROM w WHERE r1*r2 > 0)"""


def _bent(spark, d):
    e, pts = base._edges(spark, d)
    rows = forcefield.placed(topology.angles(e), pts, ["i", "j", "k"])
    return rows.withColumn("theta", geometry.angle(*map(geometry.vector, "ijk"))).where("theta is not null")


def _energy(rows, energy, digits: int):
    return forcefield.sum_energy(rows, energy, ["frame_id"]).select("frame_id", (F.round("energy", digits) + F.lit(0.0)).alias("energy"))


@query(f"{_BENT} SELECT frame_id, round(sum(0.5*143.9325*0.8*(th-1.911)*(th-1.911)*(1-0.40107*(th-1.911))), 2)+0.0 energy FROM x GROUP BY 1")
def energy_angle_mmff(spark, d):
    return _energy(_bent(spark, d), forcefield.mmff_angle(F.col("theta"), F.lit(0.8), F.lit(1.911)), 2)


@query(f"{_BENT} SELECT frame_id, round(sum(143.9325*(0.2*(r1-1.1)+0.3*(r2-1.2))*(th-1.911)), 2)+0.0 energy FROM x GROUP BY 1")
def energy_stretch_bend(spark, d):
    rows = _bent(spark, d)
    return _energy(rows, forcefield.mmff_stretch_bend(forcefield.bond_length("j", "i"), forcefield.bond_length("j", "k"), F.col("theta"), F.lit(0.2), F.lit(0.3), F.lit(1.1), F.lit(1.2), F.lit(1.911)), 2)


@query(f"""{base.GRAPH}, t AS (SELECT a.frame_id, a.a o, a.b i, b.b j, c.b k FROM arcs a JOIN arcs b ON b.frame_id=a.frame_id AND b.a=a.a AND a.b < b.b JOIN arcs c ON c.frame_id=a.frame_id AND c.a=a.a AND b.b < c.b),
v AS (SELECT t.frame_id, p.x-o.x ax, p.y-o.y ay, p.z-o.z az, q.x-o.x bx, q.y-o.y "by", q.z-o.z bz, r.x-o.x cx, r.y-o.y cy, r.z-o.z cz FROM t JOIN pts o ON o.frame_id=t.frame_id AND o.id=t.o JOIN pts p ON p.frame_id=t.frame_id AND p.id=t.i JOIN pts q ON q.frame_id=t.frame_id AND q.id=t.j JOIN pts r ON r.frame_id=t.frame_id AND r.id=t.k),
n AS (SELECT *, ay*bz-az*"by" nx, az*bx-ax*bz ny, ax*"by"-ay*bx nz FROM v), s AS (SELECT frame_id, nx*cx+ny*cy+nz*cz d, sqrt(nx*nx+ny*ny+nz*nz)*sqrt(cx*cx+cy*cy+cz*cz) l FROM n),
c AS (SELECT frame_id, asin(greatest(-1.0, least(1.0, d/l))) chi FROM s WHERE l > 0) SELECT frame_id, round(sum(0.5*143.9325*0.05*chi*chi), 3)+0.0 energy FROM c GROUP BY 1""")
def energy_out_of_plane(spark, d):
    e, pts = base._edges(spark, d)
    rows = forcefield.placed(topology.impropers(e).withColumnsRenamed({"a": "i", "b": "j", "c": "k"}), pts, ["centre", "i", "j", "k"])
    chi = forcefield.wilson(*[geometry.vector(c) for c in ("centre", "i", "j", "k")])
    return _energy(rows.withColumn("chi", chi).where("chi is not null and not isnan(chi)"), forcefield.mmff_out_of_plane(F.col("chi"), F.lit(0.05)), 3)


@query(f"""{base.SELF}, two AS (SELECT a.frame_id, a.b i, c.b j FROM arcs a JOIN arcs c ON a.frame_id = c.frame_id AND a.a = c.a AND a.b < c.b),
three AS (SELECT DISTINCT e.frame_id, least(p.b, q.b) i, greatest(p.b, q.b) j FROM edges e JOIN arcs p ON p.frame_id = e.frame_id AND p.a = e.i AND p.b <> e.j JOIN arcs q ON q.frame_id = e.frame_id AND q.a = e.j AND q.b <> e.i AND q.b <> p.b),
nb AS (SELECT frame_id, i, j, dist_sq, (frame_id, i, j) IN (SELECT (frame_id, i, j) FROM three) is_14 FROM pairs WHERE (frame_id, i, j) NOT IN (SELECT (frame_id, i, j) FROM edges UNION ALL SELECT (frame_id, i, j) FROM two))
SELECT p.frame_id, round(sum(CASE WHEN is_14 THEN 0.75 ELSE 1.0 END*332.0716*a.charge*b.charge/(sqrt(dist_sq)+0.05)), 3)+0.0 energy FROM nb p JOIN pts a ON a.frame_id=p.frame_id AND a.id=p.i JOIN pts b ON b.frame_id=p.frame_id AND b.id=p.j WHERE isfinite(a.charge) AND isfinite(b.charge) GROUP BY 1""".replace(base.SELF, f"{base.SELF}, {base.EDGES}"))
def energy_coulomb_nonbonded(spark, d):
    """Buffered electrostatics without pairs one or two bonds apart, and at three quarters three bonds apart."""
    e, pts = base._edges(spark, d)
    pairs = neighbors.pairs_self(pts, base._boxes(spark, d), base.CUTOFF)
    key = ["frame_id", "i", "j"]
    left = topology.nonbonded(pairs, e).join(pairs.select(*key, "dist_sq"), key)
    q = pts.where("charge is not null and not isnan(charge)").select("frame_id", "id", "charge")
    for c in "ij":
        left = left.join(q.select("frame_id", F.col("id").alias(c), F.col("charge").alias(f"q{c}")), ["frame_id", c])
    return _energy(left, forcefield.buffered_coulomb(F.sqrt("dist_sq"), F.col("qi"), F.col("qj"), F.col("is_14")), 3)


@query()
def pme_energy(spark, d):
    """Of frames with a box, bonds excluded."""
    boxes, pts = base._boxes(spark, d), base._points(spark, d)
    charges = pts.where("charge is not null and not isnan(charge)").select("frame_id", "id", "x", "y", "z", F.col("charge").alias("q")).join(boxes.select("frame_id"), "frame_id", "left_semi")
    pairs = Scratch(spark, "mesh").put(neighbors.pairs_self(charges.select("frame_id", "id", "x", "y", "z"), boxes, base.CUTOFF))
    e, _ = base._edges(spark, d)
    return electrostatics.pme_energy(charges, boxes, pairs, 1.0, excluded=pairs.join(e, ["frame_id", "i", "j"], "left_semi"))


@query(base.SQL["center_of_mass"])
def graph_center_of_mass(spark, d):
    """Centres of mass as a graph of two nodes over atoms and boxes."""
    g = compute.Graph()
    atoms, boxes = g.input("atoms"), g.input("boxes")
    keys = ["frame_id", "molecule_id"]
    near = g.add("relative", lambda a, b: analysis.relative(a, keys, b), atoms, boxes)
    g.add("moments", lambda r: analysis.group_moments(r, keys), near)
    out = g.run(spark, atoms=base._points(spark, d).where("molecule_id > 0"), boxes=base._boxes(spark, d))
    return base._rounded(out["moments"], ["mass", "mx", "my", "mz"])
