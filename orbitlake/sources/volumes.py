"""Volumetric files and data files with sections: cube, CHGCAR, and LAMMPS data.

Their sections depend on counts in a header, so that a file is read as one text and taken apart in one call; files are read in
parallel, and values come out as one row for each atom, bond or voxel. Writers make lines with an order.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions import elements

#: Fixed value: angstrom in a bohr.
BOHR = 0.529177210903


def _files(spark: SparkSession, path: str, schema: str, read: Callable[[str], list[tuple]]) -> DataFrame:
    """path and the rows of each file. A file with a fault raises."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["path"], batch["value"]):
                yield pd.DataFrame([(name, *r) for r in read(text)], columns=["path", *names]).astype(object)

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, f"path string, {schema}")


GRID = "kind string, name string, n array<int>, origin array<double>, cell array<double>, element string, x double, y double, z double, idx bigint, value double"


def _grid_rows(name: str, n: list[int], origin: list[float], cell: list[float], values: list[float]) -> list[tuple]:
    return [("voxel", name, n, origin, cell, None, None, None, None, k, v) for k, v in enumerate(values)]


def cube_rows(text: str) -> list[tuple]:
    """Atoms and voxels of a cube file, as rows of GRID.

    A negative number of atoms says that orbitals follow, whose values alternate; they come as fields mo_<number>. A negative first number of
    voxels says that lengths are in angstrom, else they are in bohr and converted. cell holds the whole edges, voxel edge times number. Values stay as they are.
    """
    lines = text.splitlines()
    if len(lines) < 6:
        raise ValueError("a cube file has a header of six lines at least")
    head = lines[2].split()
    n_atoms, origin = int(head[0]), [float(v) for v in head[1:4]]
    axes = [(int(w[0]), [float(v) for v in w[1:4]]) for w in (line.split() for line in lines[3:6])]
    scale = 1.0 if axes[0][0] < 0 else BOHR
    n = [abs(k) for k, _ in axes]
    cell = [v * abs(k) * scale for k, a in axes for v in a]
    origin = [v * scale for v in origin]
    atoms = [line.split() for line in lines[6 : 6 + abs(n_atoms)]]
    rows: list[tuple] = [("atom", None, n, origin, cell, elements.SYMBOLS[int(a[0]) - 1] if 0 < int(a[0]) <= len(elements.SYMBOLS) else "X", *[float(v) * scale for v in a[2:5]], k, float(a[1])) for k, a in enumerate(atoms)]
    words = " ".join(lines[6 + abs(n_atoms) :]).split()
    names = ["density"]
    if n_atoms < 0:
        many = int(words[0])
        names, words = [f"mo_{w}" for w in words[1 : many + 1]], words[many + 1 :]
    total = n[0] * n[1] * n[2]
    if len(words) < total * len(names):
        raise ValueError(f"{total * len(names)} values are needed, {len(words)} are there")
    values = [float(w) for w in words[: total * len(names)]]
    for k, name in enumerate(names):
        rows += _grid_rows(name, n, origin, cell, values[k :: len(names)])
    return rows


def chgcar_rows(text: str) -> list[tuple]:
    """Atoms and voxels of a CHGCAR file, as rows of GRID: fields total and, if a second grid follows, diff.

    Places are given in parts of the cell or, after a line that starts with C or K, in angstrom; a negative scale is the volume.
    Values are charge times volume as in the file, put in the order of x, y, z with z fastest.
    """
    lines = text.splitlines()
    scale = float(lines[1].split()[0])
    h = [[float(v) for v in lines[k].split()[:3]] for k in (2, 3, 4)]
    if scale < 0:
        det = sum(h[0][a] * (h[1][(a + 1) % 3] * h[2][(a + 2) % 3] - h[1][(a + 2) % 3] * h[2][(a + 1) % 3]) for a in range(3))
        scale = (-scale / abs(det)) ** (1 / 3)
    h = [[v * scale for v in row] for row in h]
    at = 5
    names = lines[at].split()
    if names and not names[0][0].isdigit():
        at += 1
    else:
        names = []
    counts = [int(w) for w in lines[at].split()]
    names = names or ["X"] * len(counts)
    at += 1
    if lines[at].strip()[:1] in "Ss":
        at += 1
    cartesian = lines[at].strip()[:1] in "CcKk"
    at += 1
    total = sum(counts)
    cell = [v for row in h for v in row]
    symbols = list(itertools.chain.from_iterable([s] * c for s, c in zip(names, counts)))
    atoms = []
    for k in range(total):
        p = [float(v) for v in lines[at + k].split()[:3]]
        atoms.append([v * scale for v in p] if cartesian else [sum(p[a] * h[a][c] for a in range(3)) for c in range(3)])
    at += total
    rows: list[tuple] = []
    fields = iter(("total", "diff"))
    n = None
    while at < len(lines):
        words = lines[at].split()
        if len(words) != 3 or not all(w.isdigit() for w in words) or n is not None and [int(w) for w in words] != n:
            at += 1
            continue
        name = next(fields, None)
        if name is None:
            break
        n = [int(w) for w in words]
        size, values = n[0] * n[1] * n[2], []
        at += 1
        while at < len(lines) and len(values) < size:
            values += [float(w) for w in lines[at].split()]
            at += 1
        if len(values) < size:
            raise ValueError(f"{size} values are needed, {len(values)} are there")
        nx, ny, nz = n
        ordered = [values[x + nx * (y + ny * z)] for x in range(nx) for y in range(ny) for z in range(nz)]
        rows += _grid_rows(name, n, [0.0, 0.0, 0.0], cell, ordered)
    if n is None:
        raise ValueError("no grid follows the atoms")
    return [("atom", None, n, [0.0, 0.0, 0.0], cell, s, *p, k, None) for k, (s, p) in enumerate(zip(symbols, atoms))] + rows


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """path and the rows of GRID of each cube file."""
    return _files(spark, path, GRID, cube_rows)


def read_chgcar(spark: SparkSession, path: str) -> DataFrame:
    """path and the rows of GRID of each CHGCAR file."""
    return _files(spark, path, GRID, chgcar_rows)


def cube_lines(fields: DataFrame, atoms: DataFrame, key: str) -> DataFrame:
    """key, part, no, line: the text of a cube file in angstrom for each field, in the order of part and no.

    fields: key, n, origin, cell (nine numbers), values (row-major); atoms: key, id, element, x, y, z. Six values go on a line.
    """
    num = lambda v: F.format_string("%.6f", v)
    number = elements.number(F.col("element"))
    counts = atoms.groupBy(key).agg(F.count("*").alias("n_atoms"))
    head = fields.select(key, "n", "origin", "cell").join(counts, key, "left")
    axis = [F.concat_ws(" ", F.when(F.lit(k) == 0, -F.col("n")[k]).otherwise(F.col("n")[k]).cast("string"), *[num(F.col("cell")[3 * k + c] / F.col("n")[k]) for c in range(3)]) for k in range(3)]
    top = F.array(F.lit("field"), F.lit("lengths in angstrom"), F.concat_ws(" ", F.coalesce("n_atoms", F.lit(0)).cast("string"), *[num(F.col("origin")[c]) for c in range(3)]), *axis)
    header = head.select(key, F.lit(0).alias("part"), F.posexplode(top).alias("no", "line"))
    body = atoms.select(key, F.lit(1).alias("part"), F.col("id").cast("int").alias("no"), F.concat_ws(" ", F.coalesce(number, F.lit(0)).cast("string"), num(F.lit(0.0)), *[num(F.col(c)) for c in "xyz"]).alias("line"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("values") - 1) / 6).cast("int")), lambda k: F.array_join(F.transform(F.slice("values", k * 6 + 1, F.lit(6)), lambda v: F.format_string("%.17g", v)), " "))
    return header.unionByName(body).unionByName(fields.where("size(values) > 0").select(key, F.lit(2).alias("part"), F.posexplode(chunks).alias("no", "line")))


DATA = "kind string, id bigint, molecule_id bigint, type string, charge double, x double, y double, z double, ends array<bigint>, bounds array<double>"
_SECTIONS = {"Bonds": ("bond", 2), "Angles": ("angle", 3), "Dihedrals": ("dihedral", 4), "Impropers": ("improper", 4)}
_LABELS = {"Atom Type Labels": "atom", "Bond Type Labels": "bond", "Angle Type Labels": "angle", "Dihedral Type Labels": "dihedral", "Improper Type Labels": "improper"}


def data_rows(text: str) -> list[tuple]:
    """Box, atoms and links of a LAMMPS data file, as rows of DATA; what else it holds is skipped.

    The row of the box has bounds xlo, xhi, ylo, yhi, zlo, zhi, xy, xz, yz. The columns of atoms follow the style named after the section (atomic, charge,
    molecular, full), or their number. Numbers of labelled types come as their labels. A link to an atom that is not there raises.
    """
    lines = [line.split("#", 1) for line in text.splitlines()]
    bounds, tilt = {}, [0.0, 0.0, 0.0]
    labels: dict[str, dict[str, str]] = {}
    rows, ids, section, style = [], set(), None, ""
    for parts in lines[1:]:
        body = parts[0].strip()
        if not body:
            continue
        words = body.split()
        if body[0].isalpha():
            section, style = body, parts[1].strip() if len(parts) > 1 else ""
            continue
        if section is None:
            if m := re.search(r"([xyz])lo [xyz]hi", body):
                bounds[m.group(1)] = [float(v) for v in words[:2]]
            elif body.endswith("xy xz yz"):
                tilt = [float(v) for v in words[:3]]
        elif section in _LABELS:
            labels.setdefault(_LABELS[section], {})[words[0]] = words[1]
        elif section == "Atoms":
            kind = style.split()[0] if style else {5: "atomic", 8: "atomic", 6: "molecular", 9: "molecular", 7: "full", 10: "full"}.get(len(words), "full")
            at = 1
            mol = q = None
            if kind in ("molecular", "full"):
                mol, at = int(words[1]), 2
            type_, at = words[at], at + 1
            if kind in ("charge", "full"):
                q, at = float(words[at]), at + 1
            ids.add(int(words[0]))
            rows.append(("atom", int(words[0]), mol, labels.get("atom", {}).get(type_, type_), q, *[float(v) for v in words[at : at + 3]], None, None))
        elif section in _SECTIONS:
            kind, n = _SECTIONS[section]
            rows.append((kind, int(words[0]), None, labels.get(kind, {}).get(words[1], words[1]), None, None, None, None, [int(v) for v in words[2 : 2 + n]], None))
    for r in rows:
        if r[8] and not ids.issuperset(r[8]):
            raise ValueError(f"{r[0]} {r[1]} names an atom that is not there")
    box = [v for c in "xyz" for v in bounds.get(c, [0.0, 0.0])] + tilt
    return [("box", None, None, None, None, None, None, None, None, box), *rows]


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """path and the rows of DATA of each LAMMPS data file."""
    return _files(spark, path, DATA, data_rows)


def data_lines(atoms: DataFrame, bonds: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """key, part, no, line: the text of a data file of style full for each frame, in the order of part and no.

    atoms: key, id, molecule_id, type, charge, x, y, z; bonds: key, id, type, i, j; boxes: key, bounds (nine numbers). Types become numbers in the order of their labels, which the file states.
    """

    def types(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_set(F.col("type").cast("string"))).alias("labels"))

    a, b = types(atoms), types(bonds).withColumnRenamed("labels", "bond_labels")
    counts = atoms.groupBy(key).agg(F.count("*").alias("n_a")).join(bonds.groupBy(key).agg(F.count("*").alias("n_b")), key, "left").join(boxes, key).join(a, key).join(b, key, "left")
    n_b, labels_b = F.coalesce("n_b", F.lit(0)), F.coalesce("bond_labels", F.array().cast("array<string>"))
    line = F.concat_ws
    num = lambda v: F.format_string("%.17g", v)
    box = [line(" ", num(F.col("bounds")[2 * k]), num(F.col("bounds")[2 * k + 1]), F.lit(f"{c}lo {c}hi")) for k, c in enumerate("xyz")]
    listed = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.array(F.lit(""), F.lit(title), F.lit("")), F.transform(xs, lambda x, k: line(" ", (k + 1).cast("string"), x)))).otherwise(F.array().cast("array<string>"))
    top = F.concat(
        F.array(F.lit("data file"), F.lit(""), line(" ", F.col("n_a").cast("string"), F.lit("atoms")), line(" ", n_b.cast("string"), F.lit("bonds")), line(" ", F.size("labels").cast("string"), F.lit("atom types")), line(" ", F.size(labels_b).cast("string"), F.lit("bond types")), *box, line(" ", *[num(F.col("bounds")[k]) for k in (6, 7, 8)], F.lit("xy xz yz"))),
        listed("Atom Type Labels", F.col("labels")), listed("Bond Type Labels", labels_b), F.array(F.lit(""), F.lit("Atoms # full"), F.lit("")),
    )
    header = counts.select(key, F.lit(0).alias("part"), F.posexplode(top).alias("no", "line")).withColumn("no", F.col("no").cast("long"))
    place = lambda xs: F.array_position(xs, F.col("type").cast("string")).cast("string")
    rows = atoms.join(a, key).select(key, F.lit(1).alias("part"), F.col("id").cast("long").alias("no"), line(" ", F.col("id").cast("string"), F.coalesce("molecule_id", F.lit(0)).cast("string"), place(F.col("labels")), num(F.coalesce("charge", F.lit(0.0))), *[num(F.col(c)) for c in "xyz"]).alias("line"))
    mid = bonds.select(key).distinct().select(key, F.lit(2).alias("part"), F.posexplode(F.array(F.lit(""), F.lit("Bonds"), F.lit(""))).alias("no", "line")).withColumn("no", F.col("no").cast("long"))
    links = bonds.join(b, key).select(key, F.lit(3).alias("part"), F.col("id").cast("long").alias("no"), line(" ", F.col("id").cast("string"), place(F.col("bond_labels")), F.col("i").cast("string"), F.col("j").cast("string")).alias("line"))
    return header.unionByName(rows).unionByName(mid).unionByName(links)


def write_lines(lines: DataFrame, key: str, path: str) -> None:
    """One folder of text for each key, its lines in the order of part and no. The lines of a key are cut into ranges, so that no task takes a whole one."""
    lines.repartitionByRange(key, "part", "no").sortWithinPartitions(key, "part", "no").select(key, F.col("line").alias("value")).write.partitionBy(key).text(path)


def texts(lines: DataFrame, key: str) -> DataFrame:
    """key, text: the lines of each key as one text. A text is as large as its file, which readers of these formats hold as a whole too."""
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "line"))), lambda r: r["line"]), "\n").alias("text"))


def parsed(df: DataFrame, key: str, schema: str, read: Callable[[str], list[tuple]]) -> DataFrame:
    """key and the rows of each text of column text."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in zip(batch[key], batch["text"]):
                yield pd.DataFrame([(k, *r) for r in read(text)], columns=[key, *names]).astype(object)

    return df.select(key, "text").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")
