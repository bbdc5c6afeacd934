"""Queries of the molecule operators: over the bond graphs of frames, and over the line notations in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions import elements, geometry
from orbitlake.operators import molecules
from orbitlake.plans import molecules as base
from orbitlake.runtime import Scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

GRAPH = f"""WITH {base.POINTS}, b0 AS (SELECT frame_id, least(atom_i, atom_j)::BIGINT i, greatest(atom_i, atom_j)::BIGINT j, bond_id, bond_order FROM bonds WHERE atom_i <> atom_j),
b AS (SELECT frame_id, i, j, min({{'p': bond_id, 'o': bond_order}}) m FROM b0 GROUP BY 1, 2, 3),
g AS (SELECT b.frame_id, i, j, m.p place, m.o bond_order FROM b JOIN pts p ON p.frame_id = b.frame_id AND p.id = i JOIN pts q ON q.frame_id = b.frame_id AND q.id = j),
ends AS (SELECT frame_id, i id, j other, place, bond_order FROM g UNION ALL SELECT frame_id, j, i, place, bond_order FROM g)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Atoms (earliest rows with finite places) and bonds (each once, with the order of its first row) of all frames."""
    pts = base._points(spark, d)
    clean = table(spark, d, "bonds").where("atom_i is not null and atom_j is not null and atom_i != atom_j").select("frame_id", F.least("atom_i", "atom_j").cast("long").alias("i"), F.greatest("atom_i", "atom_j").cast("long").alias("j"), F.struct("bond_id", "bond_order").alias("m"))
    one = clean.groupBy("frame_id", "i", "j").agg(F.min("m").alias("m")).select("frame_id", "i", "j", F.col("m.bond_id").alias("place"), "m.bond_order")
    ids = pts.select("frame_id", "id")
    for e in "ij":
        one = one.join(ids.withColumnRenamed("id", e), ["frame_id", e], "left_semi")
    return pts.select("frame_id", "id", "element", "x", "y", "z"), one.select("frame_id", "i", "j", "place", "bond_order")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Scratch]:
    scratch = Scratch(spark, "molecules")
    return *molecules.split(*graph(spark, d), scratch), scratch


@query(f"""{GRAPH}, cc AS ({base.SQL["bond_components"]}), n AS (SELECT frame_id, count(*) n_a, count(DISTINCT cluster_id) n_c FROM cc GROUP BY 1), e AS (SELECT frame_id, count(*) n_b FROM g GROUP BY 1)
SELECT frame_id, n_b - n_a + n_c n_rings FROM n JOIN e USING (frame_id) WHERE n_b - n_a + n_c > 0""")
def ring_count(spark, d):
    """Independent rings of each frame that has one."""
    atoms, bonds, _ = _split(spark, d)
    return molecules.rings(atoms, bonds).groupBy("frame_id").agg(F.count("*").alias("n_rings"))


@query()
def ring_set(spark, d):
    atoms, bonds, _ = _split(spark, d)
    return molecules.rings(atoms, bonds)


@query()
def ring_membership(spark, d):
    atoms, bonds, scratch = _split(spark, d)
    return molecules.ring_membership(scratch.put(molecules.rings(atoms, bonds)), atoms)


@query()
def rotatable_bonds(spark, d):
    atoms, bonds, scratch = _split(spark, d)
    return molecules.rotatable(atoms, bonds, scratch)


@query()
def downstream_atoms(spark, d):
    return molecules.downstream(graph(spark, d)[1], Scratch(spark, "molecules"))


_TARGET = "CASE lower(trim(element)) " + " ".join(f"WHEN '{s.lower()}' THEN [{', '.join(map(str, v))}]" for s, v in elements.VALENCES.items()) + " END"
_OPEN = f"""{GRAPH}, t AS (SELECT frame_id, id, sum(coalesce(bond_order, 1.0)) total FROM ends GROUP BY 1, 2), v AS (SELECT p.frame_id, p.id, p.element, coalesce(total, 0.0) total, {_TARGET} v FROM pts p LEFT JOIN t USING (frame_id, id)),
o AS (SELECT frame_id, id, element, list_min(list_filter(v, lambda x: x >= total - 1e-6)) - total o FROM v), h AS (SELECT frame_id, id, element, CASE WHEN o <= 0.5 THEN 0 ELSE floor(o + 0.5) END::INT n_h FROM o)"""


@query(f"{_OPEN} SELECT frame_id, id, n_h FROM h")
def hydrogens_implicit(spark, d):
    return molecules.implicit_hydrogens(*graph(spark, d))


@query(f"""{_OPEN}, top AS (SELECT frame_id, max(id) m FROM pts GROUP BY 1), n AS (SELECT h.frame_id, h.id parent, unnest(range(1, n_h + 1)) k FROM h WHERE n_h > 0 AND lower(trim(element)) <> 'h')
SELECT n.frame_id, m + row_number() OVER (PARTITION BY n.frame_id ORDER BY parent, k) id, parent FROM n JOIN top USING (frame_id)""")
def hydrogens_added(spark, d):
    """The hydrogens that each frame gets, and the atoms they hang on."""
    atoms, bonds = graph(spark, d)
    more, links = molecules.add_hydrogens(atoms, bonds, Scratch(spark, "hydrogens"))
    return more.where("x is null").select("frame_id", "id").join(links.where("place is null").select("frame_id", F.col("j").alias("id"), F.col("i").alias("parent")), ["frame_id", "id"])


@query(f"""{GRAPH}, gone AS (SELECT frame_id, id FROM ends JOIN pts USING (frame_id, id) WHERE lower(trim(element)) = 'h' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT frame_id, count(*) n_atoms, (SELECT count(*) FROM g WHERE g.frame_id = p.frame_id AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.frame_id = g.frame_id AND gone.id IN (g.i, g.j))) n_bonds FROM pts p ANTI JOIN gone USING (frame_id, id) GROUP BY 1""")
def hydrogens_removed(spark, d):
    """Atoms and bonds of each frame that are left without terminal hydrogens."""
    atoms, bonds = molecules.remove_hydrogens(*graph(spark, d))
    return atoms.groupBy("frame_id").agg(F.count("*").alias("n_atoms")).join(bonds.groupBy("frame_id").agg(F.count("*").alias("n_bonds")), "frame_id", "left").fillna(0)


@query(f"""{GRAPH}, four AS (SELECT frame_id, id, list(other ORDER BY place, other) n FROM ends GROUP BY 1, 2 HAVING count(*) = 4),
v AS (SELECT f.frame_id, f.id, a.x-c.x ax, a.y-c.y ay, a.z-c.z az, b.x-c.x bx, b.y-c.y "by", b.z-c.z bz, e.x-c.x ex, e.y-c.y ey, e.z-c.z ez FROM four f JOIN pts c ON c.frame_id=f.frame_id AND c.id=f.id JOIN pts a ON a.frame_id=f.frame_id AND a.id=n[1] JOIN pts b ON b.frame_id=f.frame_id AND b.id=n[2] JOIN pts e ON e.frame_id=f.frame_id AND e.id=n[3]),
w AS (SELECT frame_id, id, ax*("by"*ez-bz*ey) + ay*(bz*ex-bx*ez) + az*(bx*ey-"by"*ex) volume FROM v) SELECT frame_id, id, round(volume, 4)+0.0 volume, CASE WHEN volume > 1e-9 THEN 'CCW' WHEN volume < -1e-9 THEN 'CW' ELSE 'Unspecified' END stereo FROM w""")
def chiral_centers(spark, d):
    return molecules.chiral_centres(*graph(spark, d)).select("frame_id", "id", (F.round("volume", 4) + F.lit(0.0)).alias("volume"), "stereo")


_Z = "coalesce(CASE lower(trim(element)) " + " ".join(f"WHEN '{s.lower()}' THEN {z}" for z, s in enumerate(elements.SYMBOLS, 1)) + " END, 0)"


@query(f"""{GRAPH}, d AS (SELECT frame_id, i, j FROM g WHERE abs(coalesce(bond_order, 1.0) - 2.0) <= 0.5), n AS (SELECT e.frame_id, e.id, e.other, {{'w': {_Z}, 'p': place, 'x': p.x, 'y': p.y, 'z': p.z}} s FROM ends e JOIN pts p ON p.frame_id = e.frame_id AND p.id = e.other),
si AS (SELECT d.frame_id, d.i, d.j, max(s) s FROM d JOIN n ON n.frame_id = d.frame_id AND n.id = d.i AND n.other <> d.j GROUP BY 1, 2, 3), sj AS (SELECT d.frame_id, d.i, d.j, max(s) s FROM d JOIN n ON n.frame_id = d.frame_id AND n.id = d.j AND n.other <> d.i GROUP BY 1, 2, 3),
v AS (SELECT d.frame_id, d.i, d.j, si.s.x-a.x px, si.s.y-a.y py, si.s.z-a.z pz, sj.s.x-b.x qx, sj.s.y-b.y qy, sj.s.z-b.z qz, b.x-a.x ax, b.y-a.y ay, b.z-a.z az FROM d JOIN si USING (frame_id, i, j) JOIN sj USING (frame_id, i, j) JOIN pts a ON a.frame_id=d.frame_id AND a.id=d.i JOIN pts b ON b.frame_id=d.frame_id AND b.id=d.j),
w AS (SELECT *, px*qx+py*qy+pz*qz pq, px*ax+py*ay+pz*az pa, qx*ax+qy*ay+qz*az qa, ax*ax+ay*ay+az*az aa, px*px+py*py+pz*pz pp, qx*qx+qy*qy+qz*qz qq FROM v),
c AS (SELECT frame_id, i, j, CASE WHEN aa > 0 THEN (pq - pa*qa/aa) / (sqrt(greatest(0.0, pp-pa*pa/aa))*sqrt(greatest(0.0, qq-qa*qa/aa)) + 1e-15) END c FROM w) SELECT frame_id, i, j, CASE WHEN c > 1e-9 THEN 'Z' WHEN c < -1e-9 THEN 'E' ELSE 'Either' END stereo FROM c""")
def bond_stereo(spark, d):
    return molecules.double_bond_stereo(*graph(spark, d))


@query()
def gasteiger_charges(spark, d):
    atoms, bonds, _ = _split(spark, d)
    return molecules.partial_charges(atoms, bonds).select("frame_id", "id", F.round("charge", 6).alias("charge"), F.round("h_charge", 6).alias("h_charge"))


@query("SELECT DISTINCT element, " + _Z.replace("coalesce(", "", 1).removesuffix(", 0)") + " z, " + elements.mass_sql("element") + " mass FROM atoms WHERE element IS NOT NULL")
def element_lookup(spark, d):
    e = table(spark, d, "atoms").where("element is not null").select("element").distinct()
    return e.select("element", elements.number(F.col("element")).alias("z"), elements.mass(F.col("element")).alias("mass"))


_S, _C = 0.49999999999999994, 0.8660254037844387


@query(f"WITH {base.POINTS}, t AS (SELECT frame_id, id, x - 1.0 x, y + 2.0 y, z - 0.5 z FROM pts) SELECT frame_id, id, round({_C}*x - {_S}*y, 6)+0.0 x, round({_S}*x + {_C}*y, 6)+0.0 y, round(z, 6)+0.0 z FROM t")
def translate_rotate(spark, d):
    """All atoms moved by (-1, 2, -0.5) and then turned by 30 degrees about the z axis."""
    moved = [F.col("x") - 1.0, F.col("y") + 2.0, F.col("z") - 0.5]
    turned = geometry.rotate(moved, (0.0, 0.0, 2.0), 0.5235987755982988)
    return base._points(spark, d).select("frame_id", "id", *[(F.round(v, 6) + F.lit(0.0)).alias(c) for v, c in zip(turned, "xyz")])


# Line notations: the words of texts that are made of nothing but atoms, bonds, branches and ring numbers.

_WORDS = """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n\\t,;.]+')) smiles FROM documents), s AS (SELECT DISTINCT smiles FROM w WHERE regexp_full_match(smiles, '[CNOScno][CNOScno0-9()=]{3,}') AND regexp_matches(smiles, '[Cc]'))"""


def notations(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").where("text is not null").select(F.explode(F.split("text", r"[ \n\t,;.]+")).alias("smiles"))
    return words.where(F.col("smiles").rlike(r"^[CNOScno][CNOScno0-9()=]{3,}\z") & F.col("smiles").rlike("[Cc]")).distinct()


_COUNT = "length(regexp_replace(smiles, '{0}', '', 'g'))"


@query(f"{_WORDS} SELECT smiles, {_COUNT.format('[^CNOScno]')}::BIGINT n_atoms, ({_COUNT.format('[^CNOScno]')} - 1 + {_COUNT.format('[^0-9]')} // 2)::BIGINT n_bonds, {_COUNT.format('[^cno]')}::BIGINT n_aromatic FROM s")
def smiles_graph(spark, d):
    a, b = molecules.parse(notations(spark, d))
    atoms = a.groupBy("smiles").agg(F.count("*").alias("n_atoms"), F.count_if("aromatic").alias("n_aromatic"))
    return atoms.join(b.groupBy("smiles").agg(F.count("*").alias("n_bonds")), "smiles")


@query()
def smiles_atoms(spark, d):
    return molecules.parse(notations(spark, d))[0]


@query()
def smiles_faults(spark, d):
    return molecules.faults(notations(spark, d)).where("fault is not null")


@query(f"""{_WORDS}, m AS (SELECT smiles, 'C=O' pattern, (length(smiles) - length(replace(smiles, '=O', ''))) // 2 n FROM s UNION ALL SELECT smiles, 'c1ccccc1', 2 * {_COUNT.format('[^c]')} FROM s UNION ALL SELECT smiles, '[#7]', {_COUNT.format('[^Nn]')} FROM s)
SELECT smiles, pattern, n::BIGINT n_matches FROM m WHERE n > 0""")
def smarts_matches(spark, d):
    mols = notations(spark, d)
    each = [molecules.matches(mols, p).groupBy("smiles").agg(F.count("*").alias("n_matches")).select("smiles", F.lit(p).alias("pattern"), "n_matches") for p in ("C=O", "c1ccccc1", "[#7]")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query()
def smarts_hydroxyl(spark, d):
    """Every hydroxyl group on a carbon that is not that of an acid."""
    return molecules.matches(notations(spark, d), "[OX2;H1][#6;!$(C=O)]")


@query()
def embed_3d(spark, d):
    """Places in space of every molecule that the texts name, with hydrogens."""
    got = molecules.embed(notations(spark, d), quality="fast")
    return got.select("smiles", "atom", "element", *[F.round(c, 3).alias(c) for c in "xyz"])
