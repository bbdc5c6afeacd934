"""Force-field terms: parameters joined to the topology, energies as expressions, forces summed by atom.

Parameter tables come from a force-field definition (styles of a category, types of a style, parameters of a type); a type
that has no parameters is an error, found by an anti-join.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions import geometry as G

# Fixed values of the molecular-mechanics terms, in kcal/mol, angstrom and elementary charges.
MDYNE = 143.9325
CUBIC_BEND = -0.40107
COULOMB = 332.0716
BUFFER = 0.05
SCALE_14 = 0.75


@dataclass
class ForceField:
    """Styles by (category, name); each type holds its parameters. Categories: atom, bond, angle, dihedral, improper, pair, kspace."""

    name: str
    styles: dict[tuple[str, str], dict[str, dict[str, float]]] = field(default_factory=dict)

    def define(self, category: str, style: str, type_: str, **parameters: float) -> ForceField:
        self.styles.setdefault((category, style), {})[type_] = parameters
        return self

    def types(self, category: str, style: str) -> dict[str, dict[str, float]]:
        if (category, style) not in self.styles:
            raise KeyError(f"no style {style} of {category}")
        return self.styles[category, style]

    def pair(self, style: str, a: str, b: str) -> dict[str, float] | None:
        """Parameters of a pair of types in either order."""
        types = self.types("pair", style)
        return types.get(f"{a}-{b}") or types.get(f"{b}-{a}")

    def table(self, spark: SparkSession, category: str, style: str) -> DataFrame:
        types = self.types(category, style)
        names = sorted({p for v in types.values() for p in v})
        return spark.createDataFrame([(t, *[float(v[p]) if p in v else None for p in names]) for t, v in sorted(types.items())], "type string" + "".join(f", {p} double" for p in names))


def with_parameters(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows joined to the parameters of their type; raises, when it runs, for a type that the table lacks."""
    out = rows.join(table.withColumn("_known", F.lit(True)).hint("broadcast"), "type", "left")
    return out.where(F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("no parameters for type "), F.coalesce("type", F.lit("null")))))).drop("_known")


def placed(rows: DataFrame, pts: DataFrame, ends: list[str]) -> DataFrame:
    """Rows with the coordinates of each of their atoms: column i gives ix, iy, iz."""
    for e in ends:
        at = pts.select("frame_id", F.col("id").alias(e), *[F.col(c).alias(f"{e}{c}") for c in "xyz"])
        rows = rows.join(at, ["frame_id", e])
    return rows


def bond_length(i: str = "i", j: str = "j") -> Column:
    return G.norm(G.minus(G.vector(j), G.vector(i)))


def harmonic(value: Column, k: Column, zero: Column) -> Column:
    return F.lit(0.5) * k * (value - zero) * (value - zero)


def lennard_jones(r: Column, epsilon: Column, sigma: Column) -> Column:
    s2 = sigma * sigma / (r * r)
    s6 = s2 * s2 * s2
    return F.lit(4.0) * epsilon * (s6 * s6 - s6)


def mmff_bond(r: Column, kb: Column, r0: Column) -> Column:
    d = r - r0
    return F.lit(0.5 * MDYNE) * kb * d * d * (F.lit(1.0) - F.lit(2.0) * d + F.lit(7.0 / 3.0) * d * d)


def mmff_angle(theta: Column, ka: Column, theta0: Column) -> Column:
    d = theta - theta0
    return F.lit(0.5 * MDYNE) * ka * d * d * (F.lit(1.0) + F.lit(CUBIC_BEND) * d)


def mmff_stretch_bend(r1: Column, r2: Column, theta: Column, k1: Column, k2: Column, r10: Column, r20: Column, theta0: Column) -> Column:
    return F.lit(MDYNE) * (k1 * (r1 - r10) + k2 * (r2 - r20)) * (theta - theta0)


def mmff_torsion(phi: Column, v1: Column, v2: Column, v3: Column) -> Column:
    return F.lit(0.5) * (v1 * (1 + F.cos(phi)) + v2 * (1 - F.cos(2 * phi)) + v3 * (1 + F.cos(3 * phi)))


def mmff_out_of_plane(chi: Column, k: Column) -> Column:
    return F.lit(0.5 * MDYNE) * k * chi * chi


def wilson(centre: G.Vector, a: G.Vector, b: G.Vector, c: G.Vector) -> Column:
    """Angle between the bond centre-c and the plane of a, centre and b."""
    n = G.cross(G.minus(a, centre), G.minus(b, centre))
    v = G.minus(c, centre)
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), G.dot(n, v) / (G.norm(n) * G.norm(v)))))


def buffered_14_7(r: Column, epsilon: Column, r0: Column) -> Column:
    q = r / r0
    a = F.lit(1.07) / (q + 0.07)
    a2 = a * a
    q2 = q * q
    q7 = q2 * q2 * q2 * q
    return epsilon * a2 * a2 * a2 * a * (F.lit(1.12) / (q7 + 0.12) - 2.0)


def buffered_coulomb(r: Column, qi: Column, qj: Column, is_14: Column, dielectric: float = 1.0) -> Column:
    return F.when(is_14, SCALE_14).otherwise(1.0) * F.lit(COULOMB) * qi * qj / (F.lit(dielectric) * (r + BUFFER))


def sum_energy(rows: DataFrame, energy: Column, by: list[str]) -> DataFrame:
    return rows.withColumn("_e", energy).groupBy(*by).agg(F.sum("_e").alias("energy"))


def pair_forces(rows: DataFrame, slope: Column) -> DataFrame:
    """frame_id, id, fx, fy, fz, summed by atom from central forces, slope being dE/dr of each row (i, j and their coordinates)."""
    d = G.minus(G.vector("j"), G.vector("i"))
    r = G.norm(d)
    f = [slope * c / r for c in d]
    two = F.explode(F.array(F.struct(F.col("i").alias("id"), *[c.alias(f"f{n}") for c, n in zip(f, "xyz")]), F.struct(F.col("j").alias("id"), *[(-c).alias(f"f{n}") for c, n in zip(f, "xyz")])))
    return rows.select("frame_id", two.alias("s")).select("frame_id", "s.*").groupBy("frame_id", "id").agg(*[F.sum(f"f{n}").alias(f"f{n}") for n in "xyz"])


def lennard_jones_slope(r: Column, epsilon: Column, sigma: Column) -> Column:
    s2 = sigma * sigma / (r * r)
    s6 = s2 * s2 * s2
    return F.lit(24.0) * epsilon * (s6 - F.lit(2.0) * s6 * s6) / r


def combined(a: dict[str, float], b: dict[str, float]) -> tuple[float, float]:
    """(epsilon, r0) of a pair of buffered 14-7 types with alpha, n, a, g each: the cubic-mean rule with the Slater-Kirkwood depth."""
    ri, rj = a["a"] * a["alpha"] ** 0.25, b["a"] * b["alpha"] ** 0.25
    gamma = (ri - rj) / (ri + rj)
    r0 = 0.5 * (ri + rj) * (1 + 0.2 * (1 - math.exp(-12 * gamma * gamma)))
    depth = 181.16 * a["g"] * b["g"] * a["alpha"] * b["alpha"] / ((a["alpha"] / a["n"]) ** 0.5 + (b["alpha"] / b["n"]) ** 0.5) / r0**6
    return depth, r0


def pair_parameters(types: DataFrame) -> DataFrame:
    """type_i, type_j, epsilon, r0 of all ordered pairs of a small table of types: type, alpha, n, a, g. The same rule as ``combined``."""
    i, j = (types.select(*[F.col(c).alias(f"{c}_{e}") for c in ("type", "alpha", "n", "a", "g")]) for e in "ij")
    rows = F.broadcast(i).crossJoin(F.broadcast(j))
    ri, rj = (F.col(f"a_{e}") * F.pow(F.col(f"alpha_{e}"), F.lit(0.25)) for e in "ij")
    gamma = (ri - rj) / (ri + rj)
    r0 = F.lit(0.5) * (ri + rj) * (1 + F.lit(0.2) * (1 - F.exp(F.lit(-12.0) * gamma * gamma)))
    rows = rows.withColumn("r0", r0)
    depth = F.lit(181.16) * F.col("g_i") * F.col("g_j") * F.col("alpha_i") * F.col("alpha_j") / (F.sqrt(F.col("alpha_i") / F.col("n_i")) + F.sqrt(F.col("alpha_j") / F.col("n_j"))) / F.pow(F.col("r0"), F.lit(6.0))
    return rows.select("type_i", "type_j", depth.alias("epsilon"), "r0")


def bond_class(sbmb_i: Column, sbmb_j: Column, order: Column, aromatic: Column) -> Column:
    """Class of a bond: 1 for a single bond outside aromatic rings between atoms that both may form single and multiple bonds, else 0."""
    return F.when((F.abs(order - 1.0) < 0.01) & ~aromatic & sbmb_i & sbmb_j, 1).otherwise(0)


def angle_class(bond_a: Column, bond_b: Column, ring: Column) -> Column:
    """Class of an angle from the classes of its bonds and the size of the ring it is in (3, 4 or another)."""
    both = bond_a + bond_b
    return F.when(ring == 3, F.when(both == 0, 3).when(both == 1, 5).otherwise(6)).when(ring == 4, F.when(both == 0, 4).when(both == 1, 7).otherwise(8)).otherwise(both)


def torsion_class(left: Column, middle: Column, right: Column) -> Column:
    """Class of a torsion from the classes of its bonds: 1 if the middle one is 1, else 2 if an outer one is 1, else 0."""
    return F.when(middle == 1, 1).when((left == 1) | (right == 1), 2).otherwise(0)


def read_xml(text: str) -> ForceField:
    """A force field from XML: elements <...Style name> within the root, one element for each type with the attribute type, or type1, type2, .., and numbers.

    The category is the start of the style's tag: BondStyle, AngleStyle, and so on. Attributes that are no numbers are left out.
    """
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    out = ForceField(root.get("name") or "")
    for style in root:
        if not style.tag.endswith("Style"):
            continue
        category, name = style.tag[: -len("Style")].lower(), style.get("name")
        if not name:
            raise ValueError(f"a style of {category} has no name")
        out.styles.setdefault((category, name), {})
        for t in style:
            ends = [t.get(k) for k in sorted(k for k in t.keys() if re.fullmatch(r"type\d*", k))]
            if not ends:
                raise ValueError(f"a type of {category} {name} is not named")
            values = {}
            for k, v in t.items():
                if not k.startswith("type"):
                    try:
                        values[k] = float(v)
                    except ValueError:
                        continue
            out.define(category, name, "-".join(ends), **values)
    return out


def to_json(ff: ForceField) -> str:
    """The styles as JSON, for the metadata of a record; ``from_json`` reads it again."""
    return json.dumps({"name": ff.name, "styles": [{"category": c, "name": n, "types": t} for (c, n), t in sorted(ff.styles.items())]})


def from_json(text: str) -> ForceField:
    got = json.loads(text)
    return ForceField(got["name"], {(s["category"], s["name"]): s["types"] for s in got["styles"]})


#: Energy of a row by (category, style): the row holds the coordinates of its atoms (ix .. lz) and the parameters of its type.
REGISTRY = {
    ("bond", "harmonic"): lambda: harmonic(bond_length(), F.col("k0"), F.col("r0")),
    ("bond", "mmff"): lambda: mmff_bond(bond_length(), F.col("kb"), F.col("r0")),
    ("angle", "harmonic"): lambda: harmonic(G.angle(*map(G.vector, "ijk")), F.col("k0"), F.col("theta0")),
    ("angle", "mmff"): lambda: mmff_angle(G.angle(*map(G.vector, "ijk")), F.col("ka"), F.col("theta0")),
    ("angle", "mmff_stbn"): lambda: mmff_stretch_bend(bond_length("j", "i"), bond_length("j", "k"), G.angle(*map(G.vector, "ijk")), F.col("k1"), F.col("k2"), F.col("r10"), F.col("r20"), F.col("theta0")),
    ("dihedral", "mmff"): lambda: mmff_torsion(G.dihedral(*map(G.vector, "ijkl")), F.col("v1"), F.col("v2"), F.col("v3")),
    ("improper", "mmff_oop"): lambda: mmff_out_of_plane(wilson(*map(G.vector, "ijkl")), F.col("koop")),
    ("pair", "lj/cut"): lambda: lennard_jones(bond_length(), F.col("epsilon"), F.col("sigma")),
    ("pair", "mmff_vdw"): lambda: buffered_14_7(bond_length(), F.col("epsilon"), F.col("r0")),
    ("pair", "mmff_ele"): lambda: buffered_coulomb(bond_length(), F.col("qi"), F.col("qj"), F.col("is_14")),
}
ENDS = {"bond": "ij", "angle": "ijk", "dihedral": "ijkl", "improper": "ijkl", "pair": "ij"}


def compiled(ff: ForceField, terms: dict[tuple[str, str], DataFrame], pts: DataFrame) -> DataFrame:
    """frame_id, energy: the sum of all styles of a force field. terms: rows of each style (frame_id, ends, type).

    A style that is not registered, has no types, or has no terms raises at once; a type without parameters raises when it runs.
    """
    spark, total = pts.sparkSession, None
    for key, types in ff.styles.items():
        if key[0] == "atom":
            continue
        if key not in REGISTRY:
            raise KeyError(f"no energy for style {key[1]} of {key[0]}")
        if not types:
            raise ValueError(f"style {key[1]} of {key[0]} has no types")
        if key not in terms:
            raise ValueError(f"no terms for style {key[1]} of {key[0]}")
        rows = placed(with_parameters(terms[key], ff.table(spark, *key)), pts, list(ENDS[key[0]]))
        part = sum_energy(rows, REGISTRY[key](), ["frame_id"])
        total = part if total is None else total.unionByName(part)
    if total is None:
        raise ValueError("the force field has no styles")
    return total.groupBy("frame_id").agg(F.sum("energy").alias("energy"))


def bend_forces(rows: DataFrame, slope: Column) -> DataFrame:
    """frame_id, id, fx, fy, fz of angles (i, j, k and their coordinates), slope being dE/dtheta of each row; rows without an angle count nothing."""
    u, v = G.minus(G.vector("i"), G.vector("j")), G.minus(G.vector("k"), G.vector("j"))
    lu, lv = G.norm(u), G.norm(v)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), G.dot(u, v) / (lu * lv)))
    sin = F.sqrt(F.greatest(F.lit(1e-12), 1 - cos * cos))
    fi = [slope / (lu * sin) * (b / lv - cos * a / lu) for a, b in zip(u, v)]
    fk = [slope / (lv * sin) * (a / lu - cos * b / lv) for a, b in zip(u, v)]
    ends = [("i", fi), ("j", [-(a + b) for a, b in zip(fi, fk)]), ("k", fk)]
    three = F.explode(F.array(*[F.struct(F.col(e).alias("id"), *[c.alias(f"f{n}") for c, n in zip(f, "xyz")]) for e, f in ends]))
    return rows.where((lu > 0) & (lv > 0)).select("frame_id", three.alias("s")).select("frame_id", "s.*").groupBy("frame_id", "id").agg(*[F.sum(f"f{n}").alias(f"f{n}") for n in "xyz"])
