"""Queries of the molecular operators over the tables of a folder, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.functions import box as B
from orbitlake.functions import elements, geometry
from orbitlake.functions.regions import Shell, Sphere
from orbitlake.operators import analysis, blocks, forcefield, neighbors, topology
from orbitlake.runtime import Scratch, table

CUTOFF = 3.0
BINS = 60
QUERIES: dict = {}
SQL: dict[str, str] = {}

# Shared views in SQL.
POINTS = """pts AS (SELECT frame_id, id::BIGINT id, x, y, z, molecule_id, element, charge FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, id ORDER BY recorded_at, ingested_at NULLS FIRST) rn
 FROM atoms WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(z) AND frame_id IS NOT NULL AND id IS NOT NULL) WHERE rn = 1)"""
BOXES = """raw AS (SELECT DISTINCT frame_id, box_h h, box_origin o, box_pbc p FROM frames WHERE box_h IS NOT NULL),
m AS (SELECT frame_id, h[1][1] h11, h[1][2] h12, h[1][3] h13, h[2][1] h21, h[2][2] h22, h[2][3] h23, h[3][1] h31, h[3][2] h32, h[3][3] h33, coalesce(o[1],0) o1, coalesce(o[2],0) o2, coalesce(o[3],0) o3, coalesce(p[1],false) p1, coalesce(p[2],false) p2, coalesce(p[3],false) p3 FROM raw),
d AS (SELECT *, h11*(h22*h33-h23*h32) - h12*(h21*h33-h23*h31) + h13*(h21*h32-h22*h31) det FROM m),
boxes AS (SELECT *, (h22*h33-h23*h32)/det i11, -(h12*h33-h13*h32)/det i12, (h12*h23-h13*h22)/det i13, -(h21*h33-h23*h31)/det i21, (h11*h33-h13*h31)/det i22, -(h11*h23-h13*h21)/det i23, (h21*h32-h22*h31)/det i31, -(h11*h32-h12*h31)/det i32, (h11*h22-h12*h21)/det i33 FROM d WHERE abs(det) > 1e-12)"""
LOCATED = """located AS (SELECT pts.*, b.* EXCLUDE (frame_id), b.h11 IS NOT NULL boxed, i11*(x-o1)+i12*(y-o2)+i13*(z-o3) f1, i21*(x-o1)+i22*(y-o2)+i23*(z-o3) f2, i31*(x-o1)+i32*(y-o2)+i33*(z-o3) f3 FROM pts LEFT JOIN boxes b USING (frame_id))"""


def _pairs_sql(left: str, right: str, on: str) -> str:
    near = [f"CASE WHEN a.p{k} THEN (b.f{k}-a.f{k}) - round(b.f{k}-a.f{k}) ELSE b.f{k}-a.f{k} END g{k}" for k in (1, 2, 3)]
    return f"""near AS (SELECT a.frame_id, a.id i, b.id j, a.boxed, a.h11,a.h12,a.h13,a.h21,a.h22,a.h23,a.h31,a.h32,a.h33, {", ".join(near)}, b.x-a.x ex, b.y-a.y ey, b.z-a.z ez FROM {left} a JOIN {right} b ON a.frame_id = b.frame_id AND {on}),
apart AS (SELECT frame_id, i, j, CASE WHEN boxed THEN h11*g1+h12*g2+h13*g3 ELSE ex END dx, CASE WHEN boxed THEN h21*g1+h22*g2+h23*g3 ELSE ey END dy, CASE WHEN boxed THEN h31*g1+h32*g2+h33*g3 ELSE ez END dz FROM near),
pairs AS (SELECT *, dx*dx+dy*dy+dz*dz dist_sq FROM apart WHERE dx*dx+dy*dy+dz*dz <= {CUTOFF * CUTOFF})"""


SELF = f"WITH {POINTS}, {BOXES}, {LOCATED}, {_pairs_sql('located', 'located', 'a.id < b.id')}"
BOXED_SELF = f"WITH {POINTS}, {BOXES}, {LOCATED}, inbox AS (SELECT * FROM located WHERE boxed), {_pairs_sql('inbox', 'inbox', 'a.id < b.id')}"
EDGES = """edges AS (SELECT DISTINCT b.frame_id, least(atom_i, atom_j)::BIGINT i, greatest(atom_i, atom_j)::BIGINT j FROM bonds b JOIN pts p ON p.frame_id = b.frame_id AND p.id = b.atom_i JOIN pts q ON q.frame_id = b.frame_id AND q.id = b.atom_j WHERE atom_i <> atom_j),
arcs AS (SELECT frame_id, i a, j b FROM edges UNION ALL SELECT frame_id, j, i FROM edges)"""
GRAPH = f"WITH {POINTS}, {EDGES}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _points(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.points(table(spark, d, "atoms"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return B.boxes(table(spark, d, "frames"))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pts = _points(spark, d)
    return topology.edges(table(spark, d, "bonds"), pts), pts


def _is(symbol: str):
    return F.lower(F.trim("element")) == symbol


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).join(_boxes(spark, d).select("frame_id"), "frame_id", "left_semi")


def _rdf_sql(n_bins: int, r_max: float, r_min: float, volume: str) -> str:
    w = (r_max - r_min) / n_bins
    return f"""{BOXED_SELF}, counts AS (SELECT floor((sqrt(dist_sq)-{r_min})/{w})::INT bin, count(*) n FROM pairs WHERE dist_sq > 0 AND dist_sq >= {r_min * r_min} AND dist_sq < {r_max * r_max} GROUP BY 1),
sizes AS (SELECT frame_id, count(*) n, any_value(abs(det)) v FROM inbox GROUP BY 1), total AS (SELECT avg(n) n, {volume} v, count(*) nf FROM sizes)
SELECT b.bin::INT bin, {r_min} + (b.bin+0.5)*{w} r, coalesce(c.n,0)::BIGINT n_r, round(2*coalesce(c.n,0)/((t.n/t.v)*(4.0/3.0*pi()*(power({r_min}+(b.bin+1)*{w},3)-power({r_min}+b.bin*{w},3)))*t.n*t.nf),6) g
FROM range({n_bins}) b(bin) LEFT JOIN counts c ON c.bin = b.bin CROSS JOIN total t"""


def _rdf(spark: SparkSession, d: str, n_bins: int, r_max: float, r_min: float = 0.0, volume: float | None = None) -> DataFrame:
    pts, boxes = _boxed(spark, d), _boxes(spark, d)
    sizes = pts.groupBy("frame_id").agg(F.count("*").alias("n")).join(boxes.select("frame_id", B.volume().alias("volume")), "frame_id")
    out = analysis.rdf(spark, neighbors.pairs_self(pts, boxes, CUTOFF), sizes, n_bins, r_max, r_min, volume)
    return out.select("bin", F.round("r", 9).alias("r"), "n_r", F.round("g", 6).alias("g"))


@query(_rdf_sql(BINS, CUTOFF, 0.0, "avg(v)").replace("0.0 + (b.bin+0.5)*0.05 r", "round(0.0 + (b.bin+0.5)*0.05, 9)::DOUBLE r"))
def rdf_self(spark, d):
    return _rdf(spark, d, BINS, CUTOFF)


@query(_rdf_sql(30, CUTOFF, 0.9, "avg(v)").replace(f"0.9 + (b.bin+0.5)*{(CUTOFF - 0.9) / 30} r", f"round(0.9 + (b.bin+0.5)*{(CUTOFF - 0.9) / 30}, 9)::DOUBLE r"))
def rdf_rmin(spark, d):
    return _rdf(spark, d, 30, CUTOFF, 0.9)


@query(_rdf_sql(BINS, CUTOFF, 0.0, "20000.0").replace("0.0 + (b.bin+0.5)*0.05 r", "round(0.0 + (b.bin+0.5)*0.05, 9)::DOUBLE r"))
def rdf_fixed_volume(spark, d):
    return _rdf(spark, d, BINS, CUTOFF, volume=20000.0)


@query(f"""WITH {POINTS}, {BOXES}, {LOCATED}, inbox AS (SELECT * FROM located WHERE boxed), qa AS (SELECT * FROM inbox WHERE lower(trim(element)) = 'o'), qb AS (SELECT * FROM inbox WHERE lower(trim(element)) = 'h'), {_pairs_sql('qa', 'qb', 'true')},
counts AS (SELECT floor(sqrt(dist_sq)/0.05)::INT bin, count(*) n FROM pairs WHERE dist_sq > 0 AND dist_sq < {CUTOFF * CUTOFF} GROUP BY 1)
SELECT b.bin::INT bin, coalesce(n,0)::BIGINT n_r FROM range({BINS}) b(bin) LEFT JOIN counts c ON c.bin = b.bin""")
def rdf_cross(spark, d):
    pts, boxes = _boxed(spark, d), _boxes(spark, d)
    pairs = neighbors.pairs_cross(pts.where(_is("o")), pts.where(_is("h")), boxes, CUTOFF)
    return analysis.rdf_counts(spark, pairs, BINS, CUTOFF)


@query(f"{SELF} SELECT frame_id, i, j, round(dist_sq, 6) dist_sq FROM pairs")
def neighbor_pairs_self(spark, d):
    return neighbors.pairs_self(_points(spark, d), _boxes(spark, d), CUTOFF).select("frame_id", "i", "j", F.round("dist_sq", 6).alias("dist_sq"))


@query(f"WITH {POINTS}, {BOXES}, {LOCATED}, qa AS (SELECT * FROM located WHERE lower(trim(element)) = 'o'), qb AS (SELECT * FROM located WHERE lower(trim(element)) = 'c'), {_pairs_sql('qa', 'qb', 'true')} SELECT frame_id, i, j, round(dist_sq, 6) dist_sq FROM pairs")
def neighbor_pairs_cross(spark, d):
    pts = _points(spark, d)
    return neighbors.pairs_cross(pts.where(_is("o")), pts.where(_is("c")), _boxes(spark, d), CUTOFF).select("frame_id", "i", "j", F.round("dist_sq", 6).alias("dist_sq"))


@query(f"WITH {POINTS} SELECT a.frame_id, a.id i, b.id j, round((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z), 6) dist_sq FROM pts a JOIN pts b ON a.frame_id = b.frame_id AND a.id < b.id WHERE (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) <= {CUTOFF * CUTOFF}")
def neighbor_pairs_free(spark, d):
    """All frames without periodic boundaries."""
    return neighbors.pairs_self(_points(spark, d), _boxes(spark, d).limit(0), CUTOFF).select("frame_id", "i", "j", F.round("dist_sq", 6).alias("dist_sq"))


@query(f"{SELF}, ends AS (SELECT frame_id, i id FROM pairs UNION ALL SELECT frame_id, j FROM pairs), c AS (SELECT frame_id, id, count(*) n FROM ends GROUP BY 1, 2) SELECT p.frame_id, p.id, coalesce(n, 0)::BIGINT n_neighbors FROM pts p LEFT JOIN c USING (frame_id, id)")
def coordination_number(spark, d):
    pts = _points(spark, d)
    return neighbors.coordination(neighbors.pairs_self(pts, _boxes(spark, d), CUTOFF), pts)


def _near_pairs(spark, d, cutoff: float = 1.2):
    pts = _points(spark, d)
    return neighbors.pairs_self(pts, _boxes(spark, d), cutoff), pts


@query()
def clusters_distance(spark, d):
    return analysis.clusters(*_near_pairs(spark, d), Scratch(spark, "clusters"))


@query()
def cluster_sizes_filtered(spark, d):
    found = analysis.clusters(*_near_pairs(spark, d), Scratch(spark, "clusters"), min_size=3)
    return found.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("size"))


TRAJECTORY = f"""WITH {POINTS}, f AS (SELECT frame_id, any_value(source_code) source_code, any_value(md_step) md_step FROM frames WHERE source_code IS NOT NULL AND md_step IS NOT NULL GROUP BY 1),
o AS (SELECT *, first_value(frame_id) OVER (PARTITION BY source_code ORDER BY md_step, frame_id) f0 FROM f),
sq AS (SELECT o.source_code, o.frame_id, o.md_step, a.id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) sq FROM o JOIN pts a ON a.frame_id = o.frame_id JOIN pts b ON b.frame_id = o.f0 AND b.id = a.id)"""


def _trajectory(spark, d):
    """The frames of each source in the order of their steps, with the atoms that the first frame of the source holds too."""
    f = table(spark, d, "frames").where("source_code is not null and md_step is not null").groupBy("frame_id").agg(F.min("source_code").alias("source_code"), F.min("md_step").alias("md_step"))
    first = f.groupBy("source_code").agg(F.min(F.struct("md_step", "frame_id"))["frame_id"].alias("f0"))
    f = f.join(first, "source_code")
    pts = _points(spark, d).select("frame_id", "id", "x", "y", "z")
    start = pts.join(first.withColumnRenamed("f0", "frame_id"), "frame_id").select("source_code", "id", *[F.col(c).alias(f"{c}0") for c in "xyz"])
    return pts.join(f, "frame_id").join(start, ["source_code", "id"])


@query(f"{TRAJECTORY} SELECT source_code, frame_id, md_step, count(*) n, round(avg(sq), 5)+0.0 msd FROM sq GROUP BY 1, 2, 3")
def msd_series(spark, d):
    return analysis.squares(_trajectory(spark, d)).groupBy("source_code", "frame_id", "md_step").agg(F.count("*").alias("n"), (F.round(F.avg("sq"), 5) + F.lit(0.0)).alias("msd"))


@query(f"{TRAJECTORY} SELECT frame_id, id, round(sq, 6)+0.0 sq FROM sq")
def msd_per_particle(spark, d):
    return analysis.squares(_trajectory(spark, d)).select("frame_id", "id", (F.round("sq", 6) + F.lit(0.0)).alias("sq"))


MOMENTS = f"""WITH {POINTS}, {BOXES}, mol AS (SELECT * FROM pts WHERE molecule_id > 0), heads AS (SELECT frame_id, molecule_id, arg_min(x, id) x0, arg_min(y, id) y0, arg_min(z, id) z0 FROM mol GROUP BY 1, 2),
e AS (SELECT l.frame_id, l.molecule_id, l.id, x0, y0, z0, {elements.mass_sql('element')} m, b.h11 IS NOT NULL boxed, b.* EXCLUDE (frame_id), x-x0 ex, y-y0 ey, z-z0 ez FROM mol l JOIN heads USING (frame_id, molecule_id) LEFT JOIN boxes b ON b.frame_id = l.frame_id),
f AS (SELECT *, i11*ex+i12*ey+i13*ez q1, i21*ex+i22*ey+i23*ez q2, i31*ex+i32*ey+i33*ez q3 FROM e),
g AS (SELECT *, CASE WHEN p1 THEN q1-round(q1) ELSE q1 END g1, CASE WHEN p2 THEN q2-round(q2) ELSE q2 END g2, CASE WHEN p3 THEN q3-round(q3) ELSE q3 END g3 FROM f),
u AS (SELECT frame_id, molecule_id, id, x0, y0, z0, m, CASE WHEN boxed THEN h11*g1+h12*g2+h13*g3 ELSE ex END ux, CASE WHEN boxed THEN h21*g1+h22*g2+h23*g3 ELSE ey END uy, CASE WHEN boxed THEN h31*g1+h32*g2+h33*g3 ELSE ez END uz FROM g),
c AS (SELECT frame_id, molecule_id, count(*) n, sum(m) mass, avg(ux) ax, avg(uy) ay, avg(uz) az, sum(m*ux)/sum(m) wx, sum(m*uy)/sum(m) wy, sum(m*uz)/sum(m) wz FROM u GROUP BY 1, 2),
s AS (SELECT u.*, c.n, c.mass, ax, ay, az, wx, wy, wz, ux-ax sx, uy-ay sy, uz-az sz, ux-wx tx, uy-wy ty, uz-wz tz FROM u JOIN c USING (frame_id, molecule_id))"""


def _moments(spark, d):
    mol = _points(spark, d).where("molecule_id > 0")
    return analysis.group_moments(analysis.relative(mol, ["frame_id", "molecule_id"], _boxes(spark, d)), ["frame_id", "molecule_id"])


def _rounded(df: DataFrame, cols: list[str], digits: int = 5) -> DataFrame:
    """Rounded, with negative zeros made positive."""
    return df.select("frame_id", "molecule_id", *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in cols])


@query(f"{MOMENTS} SELECT frame_id, molecule_id, round(any_value(x0+ax), 8)+0.0 cx, round(any_value(y0+ay), 8)+0.0 cy, round(any_value(z0+az), 8)+0.0 cz FROM s GROUP BY 1, 2")
def cluster_centers(spark, d):
    return _rounded(_moments(spark, d), ["cx", "cy", "cz"], 8)


@query(f"{MOMENTS} SELECT frame_id, molecule_id, round(any_value(mass), 5)+0.0 mass, round(any_value(x0+wx), 5)+0.0 mx, round(any_value(y0+wy), 5)+0.0 my, round(any_value(z0+wz), 5)+0.0 mz FROM s GROUP BY 1, 2")
def center_of_mass(spark, d):
    return _rounded(_moments(spark, d), ["mass", "mx", "my", "mz"])


@query(f"{MOMENTS} SELECT frame_id, molecule_id, round(sqrt(sum(m*(tx*tx+ty*ty+tz*tz))/any_value(mass)), 4)+0.0 rg FROM s GROUP BY 1, 2")
def radius_of_gyration(spark, d):
    return _rounded(_moments(spark, d), ["rg"], 4)


@query(f"{MOMENTS} SELECT frame_id, molecule_id, " + ", ".join(f"round(sum(s{a}*s{b})/any_value(n), 4)+0.0 g{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM s GROUP BY 1, 2")
def gyration_tensor(spark, d):
    return _rounded(_moments(spark, d), ["gxx", "gyy", "gzz", "gxy", "gxz", "gyz"], 4)


@query(f"{MOMENTS} SELECT frame_id, molecule_id, round(sum(m*(ty*ty+tz*tz)), 3)+0.0 ixx, round(sum(m*(tx*tx+tz*tz)), 3)+0.0 iyy, round(sum(m*(tx*tx+ty*ty)), 3)+0.0 izz, round(-sum(m*tx*ty), 3)+0.0 ixy, round(-sum(m*tx*tz), 3)+0.0 ixz, round(-sum(m*ty*tz), 3)+0.0 iyz FROM s GROUP BY 1, 2")
def inertia_tensor(spark, d):
    return _rounded(_moments(spark, d), ["ixx", "iyy", "izz", "ixy", "ixz", "iyz"], 3)


@query(f"WITH {POINTS}, {BOXES}, {LOCATED} SELECT frame_id, id, round(f1, 9)+0.0 f1, round(f2, 9)+0.0 f2, round(f3, 9)+0.0 f3, f1 >= 0 AND f1 < 1 AND f2 >= 0 AND f2 < 1 AND f3 >= 0 AND f3 < 1 inside FROM located WHERE boxed")
def box_fractional(spark, d):
    at = _points(spark, d).join(_boxes(spark, d), "frame_id")
    f = B.fractional(F.col("x"), F.col("y"), F.col("z"))
    return at.select("frame_id", "id", *[(F.round(v, 9) + F.lit(0.0)).alias(f"f{k + 1}") for k, v in enumerate(f)], B.inside(f).alias("inside"))


@query(f"""WITH {POINTS}, {BOXES}, {LOCATED}, w AS (SELECT *, CASE WHEN p1 THEN f1-floor(f1) ELSE f1 END w1, CASE WHEN p2 THEN f2-floor(f2) ELSE f2 END w2, CASE WHEN p3 THEN f3-floor(f3) ELSE f3 END w3 FROM located WHERE boxed)
SELECT frame_id, id, round(o1+h11*w1+h12*w2+h13*w3, 6)+0.0 x, round(o2+h21*w1+h22*w2+h23*w3, 6)+0.0 y, round(o3+h31*w1+h32*w2+h33*w3, 6)+0.0 z FROM w""")
def box_wrap(spark, d):
    at = _points(spark, d).join(_boxes(spark, d), "frame_id")
    w = B.cartesian(B.wrapped(B.fractional(F.col("x"), F.col("y"), F.col("z"))))
    return at.select("frame_id", "id", *[(F.round(v, 6) + F.lit(0.0)).alias(c) for v, c in zip(w, "xyz")])


@query(f"WITH {BOXES} SELECT frame_id, round(abs(det), 5) volume, round(sqrt(h11*h11+h21*h21+h31*h31), 6) len1, round(sqrt(h12*h12+h22*h22+h32*h32), 6) len2, round(sqrt(h13*h13+h23*h23+h33*h33), 6) len3, round(1/sqrt(i11*i11+i12*i12+i13*i13), 6) plane1, round(1/sqrt(i21*i21+i22*i22+i23*i23), 6) plane2, round(1/sqrt(i31*i31+i32*i32+i33*i33), 6) plane3 FROM boxes")
def box_extents(spark, d):
    return _boxes(spark, d).select("frame_id", F.round(B.volume(), 5).alias("volume"), *[F.round(v, 6).alias(f"len{k + 1}") for k, v in enumerate(B.lengths())], *[F.round(v, 6).alias(f"plane{k + 1}") for k, v in enumerate(B.plane_distances())])


_D = "((x-10.0)*(x-10.0)+(y-10.0)*(y-10.0)+(z-10.0)*(z-10.0))"
_E = "((x-5.0)*(x-5.0)+(y-5.0)*(y-5.0)+(z-5.0)*(z-5.0))"


@query(f"WITH {POINTS} SELECT frame_id, id FROM pts WHERE {_D} <= 36.0")
def region_sphere(spark, d):
    return _points(spark, d).where(Sphere((10, 10, 10), 6.0).contains(F.col("x"), F.col("y"), F.col("z"))).select("frame_id", "id")


@query(f"WITH {POINTS} SELECT frame_id, id FROM pts WHERE {_D} > 16.0 AND {_D} <= 64.0")
def region_shell(spark, d):
    return _points(spark, d).where(Shell((10, 10, 10), 4.0, 8.0).contains(F.col("x"), F.col("y"), F.col("z"))).select("frame_id", "id")


@query(f"WITH {POINTS} SELECT frame_id, id FROM pts WHERE ({_D} <= 36.0 OR ({_E} > 4.0 AND {_E} <= 49.0)) AND NOT ({_E} <= 16.0)")
def region_boolean(spark, d):
    region = (Sphere((10, 10, 10), 6.0) | Shell((5, 5, 5), 2.0, 7.0)) & ~Sphere((5, 5, 5), 4.0)
    return _points(spark, d).where(region.contains(F.col("x"), F.col("y"), F.col("z"))).select("frame_id", "id")


@query(f"{GRAPH} SELECT a.frame_id, a.b i, a.a j, c.b k FROM arcs a JOIN arcs c ON a.frame_id = c.frame_id AND a.a = c.a AND a.b < c.b")
def topology_angles(spark, d):
    return topology.angles(_edges(spark, d)[0])


@query(f"{GRAPH} SELECT e.frame_id, p.b i, e.i j, e.j k, q.b l FROM edges e JOIN arcs p ON p.frame_id = e.frame_id AND p.a = e.i AND p.b <> e.j JOIN arcs q ON q.frame_id = e.frame_id AND q.a = e.j AND q.b <> e.i AND q.b <> p.b")
def topology_dihedrals(spark, d):
    return topology.dihedrals(_edges(spark, d)[0])


@query(f"{GRAPH} SELECT x.frame_id, x.a centre, x.b a, y.b b, z.b c FROM arcs x JOIN arcs y ON x.frame_id = y.frame_id AND x.a = y.a AND x.b < y.b JOIN arcs z ON x.frame_id = z.frame_id AND x.a = z.a AND y.b < z.b")
def topology_impropers(spark, d):
    return topology.impropers(_edges(spark, d)[0])


@query(f"{GRAPH}, n AS (SELECT frame_id, a id, count(*) n FROM arcs GROUP BY 1, 2) SELECT p.frame_id, p.id, coalesce(n, 0)::BIGINT degree FROM pts p LEFT JOIN n USING (frame_id, id)")
def atom_degree(spark, d):
    return topology.degree(*_edges(spark, d))


@query(f"""WITH RECURSIVE {POINTS}, {EDGES}, cc(f, id, g) USING KEY (f, id) AS (SELECT frame_id, id, id FROM pts UNION SELECT l.frame_id, l.b, min(c.g) FROM cc c JOIN arcs l ON l.frame_id = c.f AND l.a = c.id JOIN recurring.cc r ON r.f = l.frame_id AND r.id = l.b WHERE c.g < r.g GROUP BY l.frame_id, l.b)
SELECT f frame_id, id, (dense_rank() OVER (PARTITION BY f ORDER BY g) - 1)::INT cluster_id FROM cc""")
def bond_components(spark, d):
    """Components of the bonds alone, numbered from 0 in each frame."""
    e, pts = _edges(spark, d)
    return analysis.clusters(e, pts, Scratch(spark, "bonded"))


@query(f"""{SELF}, {EDGES}, two AS (SELECT a.frame_id, a.b i, c.b j FROM arcs a JOIN arcs c ON a.frame_id = c.frame_id AND a.a = c.a AND a.b < c.b),
three AS (SELECT DISTINCT e.frame_id, least(p.b, q.b) i, greatest(p.b, q.b) j FROM edges e JOIN arcs p ON p.frame_id = e.frame_id AND p.a = e.i AND p.b <> e.j JOIN arcs q ON q.frame_id = e.frame_id AND q.a = e.j AND q.b <> e.i AND q.b <> p.b)
SELECT frame_id, i, j, (frame_id, i, j) IN (SELECT (frame_id, i, j) FROM three) is_14 FROM pairs WHERE (frame_id, i, j) NOT IN (SELECT (frame_id, i, j) FROM edges UNION ALL SELECT (frame_id, i, j) FROM two)""")
def nonbonded_pairs(spark, d):
    e, pts = _edges(spark, d)
    return topology.nonbonded(neighbors.pairs_self(pts, _boxes(spark, d), CUTOFF), e)


@query(f"WITH {POINTS} SELECT DISTINCT bond_id, field, id::BIGINT id FROM (SELECT bond_id, frame_id, 'atom_i' field, atom_i id FROM bonds UNION ALL SELECT bond_id, frame_id, 'atom_j', atom_j FROM bonds) e WHERE id IS NOT NULL AND frame_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pts p WHERE p.frame_id = e.frame_id AND p.id = e.id)")
def frame_validate(spark, d):
    return topology.invalid_bonds(table(spark, d, "bonds"), _points(spark, d))


@query(f"{GRAPH} SELECT frame_id, i, j FROM edges WHERE (frame_id, i) NOT IN (SELECT (frame_id, id) FROM atomdrops) AND (frame_id, j) NOT IN (SELECT (frame_id, id) FROM atomdrops)")
def remove_atoms_cascade(spark, d):
    e, pts = _edges(spark, d)
    return topology.remove_atoms(pts, e, table(spark, d, "atomdrops").select("frame_id", F.col("id").cast("long").alias("id")))[1]


PLACED = "p AS (SELECT e.frame_id, e.i, e.j, a.x ix, a.y iy, a.z iz, b.x jx, b.y jy, b.z jz, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) r FROM edges e JOIN pts a ON a.frame_id = e.frame_id AND a.id = e.i JOIN pts b ON b.frame_id = e.frame_id AND b.id = e.j)"
HARMONIC = forcefield.ForceField("demo").define("bond", "harmonic", "even", k0=300.0, r0=1.1).define("bond", "harmonic", "odd", k0=450.0, r0=1.4).define("angle", "harmonic", "even", k0=50.0, theta0=1.911).define("angle", "harmonic", "odd", k0=60.0, theta0=2.094).define("pair", "lj/cut", "even", epsilon=0.1, sigma=1.5).define("pair", "lj/cut", "odd", epsilon=0.2, sigma=1.2)


def _typed(rows: DataFrame, *ends: str) -> DataFrame:
    return rows.withColumn("type", F.when(sum(F.col(e) for e in ends) % 2 == 0, "even").otherwise("odd"))


def _bonded(spark, d):
    e, pts = _edges(spark, d)
    return forcefield.with_parameters(_typed(forcefield.placed(e, pts, ["i", "j"]), "i", "j"), HARMONIC.table(spark, "bond", "harmonic"))


_K, _R = "CASE WHEN (i+j)%2=0 THEN 300.0::DOUBLE ELSE 450.0::DOUBLE END", "CASE WHEN (i+j)%2=0 THEN 1.1::DOUBLE ELSE 1.4::DOUBLE END"


@query(f"{GRAPH}, {PLACED} SELECT frame_id, round(sum(0.5*({_K})*(r-({_R}))*(r-({_R}))), 2) energy FROM p GROUP BY 1")
def energy_bond_harmonic(spark, d):
    return forcefield.sum_energy(_bonded(spark, d), forcefield.harmonic(forcefield.bond_length(), F.col("k0"), F.col("r0")), ["frame_id"]).select("frame_id", F.round("energy", 2).alias("energy"))


@query(f"{GRAPH}, {PLACED} SELECT frame_id, round(sum(0.5*143.9325*2.0*(r-({_R}))*(r-({_R}))*(1-2*(r-({_R}))+7.0/3.0*(r-({_R}))*(r-({_R})))), 1) energy FROM p GROUP BY 1")
def energy_bond_mmff(spark, d):
    return forcefield.sum_energy(_bonded(spark, d), forcefield.mmff_bond(forcefield.bond_length(), F.lit(2.0), F.col("r0")), ["frame_id"]).select("frame_id", F.round("energy", 1).alias("energy"))


@query(f"""{GRAPH}, {PLACED}, f AS (SELECT frame_id, i, j, ({_K})*(r-({_R}))*(jx-ix)/r fx, ({_K})*(r-({_R}))*(jy-iy)/r fy, ({_K})*(r-({_R}))*(jz-iz)/r fz FROM p WHERE r > 0), s AS (SELECT frame_id, i id, fx, fy, fz FROM f UNION ALL SELECT frame_id, j, -fx, -fy, -fz FROM f)
SELECT frame_id, id, round(sum(fx), 4)+0.0 fx, round(sum(fy), 4)+0.0 fy, round(sum(fz), 4)+0.0 fz FROM s GROUP BY 1, 2""")
def forces_bond_harmonic(spark, d):
    rows = _bonded(spark, d).where(forcefield.bond_length() > 0)
    f = forcefield.pair_forces(rows, F.col("k0") * (forcefield.bond_length() - F.col("r0")))
    return f.select("frame_id", "id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("fx", "fy", "fz")])


@query(f"""{GRAPH}, t AS (SELECT a.frame_id, a.b i, a.a j, c.b k FROM arcs a JOIN arcs c ON a.frame_id = c.frame_id AND a.a = c.a AND a.b < c.b),
v AS (SELECT t.*, p.x-q.x ax, p.y-q.y ay, p.z-q.z az, r.x-q.x bx, r.y-q.y "by", r.z-q.z bz FROM t JOIN pts p ON p.frame_id=t.frame_id AND p.id=t.i JOIN pts q ON q.frame_id=t.frame_id AND q.id=t.j JOIN pts r ON r.frame_id=t.frame_id AND r.id=t.k),
w AS (SELECT *, sqrt(ax*ax+ay*ay+az*az)*sqrt(bx*bx+"by"*"by"+bz*bz) s, ax*bx+ay*"by"+az*bz c FROM v),
x AS (SELECT frame_id, CASE WHEN (i+j+k)%2=0 THEN 50.0::DOUBLE ELSE 60.0::DOUBLE END k0, CASE WHEN (i+j+k)%2=0 THEN 1.911::DOUBLE ELSE 2.094::DOUBLE END t0, acos(greatest(-1.0, least(1.0, c/s))) th FROM w WHERE s > 0)
SELECT frame_id, round(sum(0.5*k0*(th-t0)*(th-t0)), 3) energy FROM x GROUP BY 1""")
def energy_angle_harmonic(spark, d):
    e, pts = _edges(spark, d)
    rows = forcefield.with_parameters(_typed(forcefield.placed(topology.angles(e), pts, ["i", "j", "k"]), "i", "j", "k"), HARMONIC.table(spark, "angle", "harmonic"))
    theta = geometry.angle(geometry.vector("i"), geometry.vector("j"), geometry.vector("k"))
    rows = rows.withColumn("theta", theta).where("theta is not null")
    return forcefield.sum_energy(rows, forcefield.harmonic(F.col("theta"), F.col("k0"), F.col("theta0")), ["frame_id"]).select("frame_id", F.round("energy", 3).alias("energy"))


@query(f"""{SELF}, e AS (SELECT frame_id, CASE WHEN (i+j)%2=0 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END eps, CASE WHEN (i+j)%2=0 THEN 2.25::DOUBLE ELSE 1.44::DOUBLE END s2, dist_sq FROM pairs WHERE dist_sq >= 1e-24),
t AS (SELECT frame_id, sum(4*eps*(power(s2/dist_sq, 6)-power(s2/dist_sq, 3))) energy FROM e GROUP BY 1), x AS (SELECT frame_id, energy, floor(log10(abs(energy)))::INT exponent FROM t WHERE energy <> 0) SELECT frame_id, printf('%.9fe%d', energy / power(10.0, exponent), exponent)::DOUBLE energy FROM x""")
def energy_lj(spark, d):
    """Of all pairs within the cutoff but coincident ones. Close contacts make sums of any size, so that they are rounded to ten digits."""
    pairs = neighbors.pairs_self(_points(spark, d), _boxes(spark, d), CUTOFF).where("dist_sq >= 1e-24")
    rows = forcefield.with_parameters(_typed(pairs, "i", "j"), HARMONIC.table(spark, "pair", "lj/cut"))
    total = forcefield.sum_energy(rows, forcefield.lennard_jones(F.sqrt("dist_sq"), F.col("epsilon"), F.col("sigma")), ["frame_id"]).where("energy != 0")
    return total.withColumn("exponent", F.floor(F.log10(F.abs("energy"))).cast("int")).select("frame_id", F.format_string("%.9fe%d", F.col("energy") / F.pow(F.lit(10.0), F.col("exponent").cast("double")), "exponent").cast("double").alias("energy"))


@query(f"""{SELF}, e AS (SELECT frame_id, sqrt(dist_sq)/3.2 q FROM pairs) SELECT frame_id, round(sum(0.05*power(1.07/(q+0.07), 7)*(1.12/(power(q, 7)+0.12)-2.0)), 3) energy FROM e GROUP BY 1""")
def energy_mmff_vdw(spark, d):
    pairs = neighbors.pairs_self(_points(spark, d), _boxes(spark, d), CUTOFF)
    return forcefield.sum_energy(pairs, forcefield.buffered_14_7(F.sqrt("dist_sq"), F.lit(0.05), F.lit(3.2)), ["frame_id"]).select("frame_id", F.round("energy", 3).alias("energy"))


@query(f"""{SELF} SELECT p.frame_id, round(sum(332.0716*a.charge*b.charge/(sqrt(dist_sq)+0.05)), 3)+0.0 energy FROM pairs p JOIN pts a ON a.frame_id=p.frame_id AND a.id=p.i JOIN pts b ON b.frame_id=p.frame_id AND b.id=p.j WHERE isfinite(a.charge) AND isfinite(b.charge) GROUP BY 1""")
def energy_coulomb_buffered(spark, d):
    pts = _points(spark, d)
    q = pts.where("charge is not null and not isnan(charge)").select("frame_id", "id", "charge")
    pairs = neighbors.pairs_self(pts, _boxes(spark, d), CUTOFF).join(q.select("frame_id", F.col("id").alias("i"), F.col("charge").alias("qi")), ["frame_id", "i"]).join(q.select("frame_id", F.col("id").alias("j"), F.col("charge").alias("qj")), ["frame_id", "j"])
    return forcefield.sum_energy(pairs, forcefield.buffered_coulomb(F.sqrt("dist_sq"), F.col("qi"), F.col("qj"), F.lit(False)), ["frame_id"]).select("frame_id", (F.round("energy", 3) + F.lit(0.0)).alias("energy"))


@query(f"""{GRAPH}, t AS (SELECT e.frame_id, p.b i, e.i j, e.j k, q.b l FROM edges e JOIN arcs p ON p.frame_id = e.frame_id AND p.a = e.i AND p.b <> e.j JOIN arcs q ON q.frame_id = e.frame_id AND q.a = e.j AND q.b <> e.i AND q.b <> p.b),
v AS (SELECT t.frame_id, b.x-a.x px, b.y-a.y py, b.z-a.z pz, c.x-b.x qx, c.y-b.y qy, c.z-b.z qz, e.x-c.x rx, e.y-c.y ry, e.z-c.z rz FROM t JOIN pts a ON a.frame_id=t.frame_id AND a.id=t.i JOIN pts b ON b.frame_id=t.frame_id AND b.id=t.j JOIN pts c ON c.frame_id=t.frame_id AND c.id=t.k JOIN pts e ON e.frame_id=t.frame_id AND e.id=t.l),
w AS (SELECT frame_id, px, py, pz, sqrt(qx*qx+qy*qy+qz*qz) qn, py*qz-pz*qy m1, pz*qx-px*qz m2, px*qy-py*qx m3, qy*rz-qz*ry n1, qz*rx-qx*rz n2, qx*ry-qy*rx n3 FROM v),
f AS (SELECT frame_id, atan2(qn*(px*n1+py*n2+pz*n3), m1*n1+m2*n2+m3*n3) phi FROM w)
SELECT frame_id, round(sum(0.5*(0.4*(1+cos(phi))+0.3*(1-cos(2*phi))+0.2*(1+cos(3*phi)))), 4) energy FROM f GROUP BY 1""")
def energy_torsion(spark, d):
    e, pts = _edges(spark, d)
    rows = forcefield.placed(topology.dihedrals(e), pts, ["i", "j", "k", "l"])
    phi = geometry.dihedral(*[geometry.vector(c) for c in "ijkl"])
    return forcefield.sum_energy(rows.withColumn("phi", phi), forcefield.mmff_torsion(F.col("phi"), F.lit(0.4), F.lit(0.3), F.lit(0.2)), ["frame_id"]).select("frame_id", F.round("energy", 4).alias("energy"))


@query(f"{GRAPH}, bead AS (SELECT frame_id, id, id // 4 bead FROM pts) SELECT DISTINCT e.frame_id, least(a.bead, b.bead) bead_i, greatest(a.bead, b.bead) bead_j FROM edges e JOIN bead a ON a.frame_id=e.frame_id AND a.id=e.i JOIN bead b ON b.frame_id=e.frame_id AND b.id=e.j WHERE a.bead <> b.bead")
def cg_bonds(spark, d):
    e, pts = _edges(spark, d)
    return topology.coarse_bonds(e, pts.select("frame_id", "id", F.floor(F.col("id") / 4).alias("bead")))


@query(f"WITH {POINTS}, w AS (SELECT frame_id, id // 4 bead, {elements.mass_sql('element')} m, x, y, z FROM pts) SELECT frame_id, bead, count(*) n, round(sum(m*x)/sum(m), 5)+0.0 x, round(sum(m*y)/sum(m), 5)+0.0 y, round(sum(m*z)/sum(m), 5)+0.0 z FROM w GROUP BY 1, 2")
def cg_coarsen(spark, d):
    w = _points(spark, d).select("frame_id", F.floor(F.col("id") / 4).alias("bead"), elements.mass(F.col("element")).alias("m"), "x", "y", "z")
    return w.groupBy("frame_id", "bead").agg(F.count("*").alias("n"), *[(F.round(F.sum(F.col("m") * F.col(c)) / F.sum("m"), 5) + F.lit(0.0)).alias(c) for c in "xyz"])


@query("""WITH g AS (SELECT field_id, any_value(shape) s, any_value(grid_origin) o, any_value(cell) c, any_value(grid_values) v FROM gridfields GROUP BY 1), e AS (SELECT *, unnest(range(len(v))) idx FROM g WHERE len(v) = s[1]*s[2]*s[3] AND len(c) = 9),
w AS (SELECT field_id, idx, v[idx+1] value, (idx // (s[2]*s[3]))::DOUBLE/s[1] a, ((idx // s[3]) % s[2])::DOUBLE/s[2] b, (idx % s[3])::DOUBLE/s[3] d, o, c FROM e)
SELECT field_id, idx::INT idx, round(o[1]+a*c[1]+b*c[4]+d*c[7], 6)+0.0 x, round(o[2]+a*c[2]+b*c[5]+d*c[8], 6)+0.0 y, round(o[3]+a*c[3]+b*c[6]+d*c[9], 6)+0.0 z, value, 'He' element FROM w WHERE abs(value) >= 0.5 AND idx % 2 = 0""")
def field_point_cloud(spark, d):
    one = table(spark, d, "gridfields").dropDuplicates(["field_id"])
    return blocks.point_cloud(blocks.voxels(one), 0.5, 2).select("field_id", "idx", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xyz"], "value", "element")


@query(f"WITH {POINTS}, n AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY id) - 1 atom_idx, x FROM pts), f AS (SELECT DISTINCT frame_id FROM pts) SELECT f.frame_id, k.k::INT atom_idx, coalesce(n.x, 0.0) x FROM f CROSS JOIN range(300) k(k) LEFT JOIN n ON n.frame_id = f.frame_id AND n.atom_idx = k.k")
def block_resize(spark, d):
    n = _points(spark, d).select("frame_id", (F.row_number().over(Window.partitionBy("frame_id").orderBy("id")) - 1).alias("atom_idx"), "x")
    return blocks.resize(n, 300, key="frame_id")


@query("SELECT (p_partkey - 1)::BIGINT atom_idx, p_retailprice x FROM part UNION ALL SELECT (s_suppkey - 1 + (SELECT max(p_partkey) FROM part))::BIGINT, s_acctbal FROM supplier")
def block_merge(spark, d):
    a = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("atom_idx"), F.col("p_retailprice").alias("x"))
    return blocks.merge(a, table(spark, d, "supplier").select((F.col("s_suppkey") - 1).alias("atom_idx"), F.col("s_acctbal").alias("x")))


@query()
def pca_2(spark, d):
    return analysis.pca(table(spark, d, "embeddings"), "embedding", "vec_id")


def _components(spark, d):
    """The two principal components, which k-means clusters."""
    return Scratch(spark, "components").put(analysis.pca(table(spark, d, "embeddings"), "embedding", "vec_id"))


@query()
def kmeans_assign(spark, d):
    return analysis.assign(_components(spark, d), "vec_id", ["pc1", "pc2"], [[0.0, 0.0], [1.0, 1.0], [-1.0, 1.0]])


@query()
def kmeans_fixed_init(spark, d):
    return analysis.kmeans(_components(spark, d), "vec_id", ["pc1", "pc2"], [[0.0, 0.0], [1.0, 1.0], [-1.0, 1.0]])[0]


@query()
def kmeans_seeded(spark, d):
    """Eight clusters from k-means++ starts."""
    rows = _components(spark, d)
    return analysis.kmeans(rows, "vec_id", ["pc1", "pc2"], analysis.spread_starts(rows, "vec_id", ["pc1", "pc2"], 8, seed=7))[0]
