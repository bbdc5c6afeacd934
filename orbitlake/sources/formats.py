"""Readers and writers of molecular text formats.

Formats whose frames end with a mark (dump, PDB models, SDF) are read by that mark as the line separator of Spark's text
source, so that large files are split; each frame is then taken apart with built-in expressions. XYZ has no such mark, and
is parsed file by file. Writers make lines with an order, and sort them within ranges of frames.
"""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r", ""), "\n")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """step, n_atoms, box_lo, box_hi, tilt, pbc, and one row for each atom with its values by column name (``atom``: map of text).

    Sections before the first time step are skipped. The bounds of a tilted box are those of the box itself, without the overhang.
    pbc is true where the flag starts with p.
    """
    raw = spark.read.option("lineSep", "ITEM: TIMESTEP").text(path).where(F.col("value").contains("ITEM: ATOMS"))
    one = raw.withColumn("l", _lines("value")).select(
        F.trim(F.col("l")[1]).try_cast("long").alias("step"), F.trim(F.col("l")[3]).try_cast("long").alias("n_atoms"), F.col("l")[4].alias("flags"),
        F.transform(F.slice("l", 6, 3), lambda x: F.transform(_words(x), lambda w: w.try_cast("double"))).alias("b"), _words(F.regexp_replace(F.col("l")[8], "^ITEM: ATOMS", "")).alias("names"),
        F.slice("l", F.lit(10), F.greatest(F.trim(F.col("l")[3]).try_cast("int"), F.lit(0))).alias("rows"),
    )
    t = [F.coalesce(F.try_element_at(F.col("b")[k], F.lit(3)), F.lit(0.0)) for k in range(3)]
    lo = [F.col("b")[k][0] for k in range(3)]
    hi = [F.col("b")[k][1] for k in range(3)]
    zero = F.lit(0.0)
    lo[0], hi[0] = lo[0] - F.least(zero, t[0], t[1], t[0] + t[1]), hi[0] - F.greatest(zero, t[0], t[1], t[0] + t[1])
    lo[1], hi[1] = lo[1] - F.least(zero, t[2]), hi[1] - F.greatest(zero, t[2])
    pbc = F.transform(F.slice(F.reverse(_words("flags")), 1, 3), lambda x: x.startswith("p"))
    return one.select("step", "n_atoms", F.array(*lo).alias("box_lo"), F.array(*hi).alias("box_hi"), F.array(*t).alias("tilt"), F.reverse(pbc).alias("pbc"), "names", F.explode("rows").alias("row")).select(
        "step", "n_atoms", "box_lo", "box_hi", "tilt", "pbc", F.map_from_arrays("names", F.slice(_words("row"), F.lit(1), F.size("names"))).alias("atom")
    )


def write_dump(frames: DataFrame, atoms: DataFrame, path: str) -> None:
    """frames: frame_id, step, lo and hi (arrays of 3), pbc; atoms: frame_id, id, type, x, y, z. A frame stays in one file."""
    n = atoms.groupBy("frame_id").agg(F.count("*").alias("n"))
    flags = F.concat_ws(" ", F.transform("pbc", lambda p: F.when(p, "pp").otherwise("ff")))
    bound = [F.format_string("%.6f %.6f", F.col("lo")[k], F.col("hi")[k]) for k in range(3)]
    head = F.array(F.lit("ITEM: TIMESTEP"), F.col("step").cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("n").cast("string"), F.concat(F.lit("ITEM: BOX BOUNDS "), flags), *bound, F.lit("ITEM: ATOMS id type x y z"))
    heads = frames.join(n, "frame_id").select("frame_id", F.lit(0).alias("part"), F.posexplode(head).alias("no", "line")).select("frame_id", "part", F.col("no").cast("long").alias("no"), "line")
    rows = atoms.select("frame_id", F.lit(1).alias("part"), F.col("id").cast("long").alias("no"), F.format_string("%d %s %.6f %.6f %.6f", "id", "type", "x", "y", "z").alias("line"))
    heads.unionByName(rows).repartitionByRange("frame_id").sortWithinPartitions("frame_id", "part", "no").select("line").write.text(path)


#: Serials have five columns: those from 100000 on are written in base 36 from A0000 on (hybrid-36), up to ZZZZZ.
SERIALS, BASE_36, MOST = 100_000, 10 * 36**4, 100_000 + 26 * 36**4


def _serial(n: Column) -> Column:
    wide = F.when(n < MOST, F.conv((n + (BASE_36 - SERIALS)).cast("string"), 10, 36)).otherwise(F.raise_error(F.lit("serials from 43770016 on have no place in PDB")))
    return F.lpad(F.when(n < SERIALS, n.cast("string")).otherwise(wide), 5, " ")


def _number(s: Column) -> Column:
    return F.when(s.rlike("^[A-Z][0-9A-Z]{4}$"), F.conv(s, 36, 10).try_cast("long") - (BASE_36 - SERIALS)).otherwise(s.try_cast("long")).cast("int")


def _part(a: int, n: int) -> Column:
    return F.btrim(F.substring("s", a, n))


def _models(spark: SparkSession, path: str) -> DataFrame:
    """path, model, value and atoms (whether it has any) of each piece of text that ENDMDL ends, or the file."""
    raw = spark.read.option("lineSep", "ENDMDL").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    model = F.coalesce(F.regexp_extract("value", r"(?m)^MODEL\s+(\d+)", 1).try_cast("int"), F.lit(1))
    return raw.select("path", model.alias("model"), "value", F.col("value").rlike("(?m)^(ATOM|HETATM)").alias("atoms"))


def _atoms(spark: SparkSession, path: str) -> DataFrame:
    return _models(spark, path).where("atoms").select("path", "model", F.explode(_lines("value")).alias("s")).where(F.col("s").rlike("^(ATOM|HETATM)") & (F.length("s") >= 54))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """model, and the fields of each ATOM or HETATM record: serial, name, res_name, chain, res_seq, x, y, z, element.

    Lines of under 54 characters are no records; a blank element is taken from the name, X if that has no letter. model is
    the number of its MODEL record, 1 without one.
    """
    element = F.coalesce(F.nullif(_part(77, 2), F.lit("")), F.nullif(F.initcap(F.regexp_extract(_part(13, 2), "([A-Za-z]+)", 1)), F.lit("")), F.lit("X"))
    return _atoms(spark, path).select(
        "model", _number(_part(7, 5)).alias("serial"), _part(13, 4).alias("name"), _part(18, 3).alias("res_name"), _part(22, 1).alias("chain"), _part(23, 4).try_cast("int").alias("res_seq"),
        *[_part(a, 8).try_cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))], element.alias("element"),
    )


def read_pdb_boxes(spark: SparkSession, path: str) -> DataFrame:
    """model, a, b, c, alpha, beta, gamma (degrees, 90 where blank) and box_h (a along x, b in the plane of x and y) of each model with a CRYST1 record.

    The only CRYST1 that stands before a MODEL record in a file holds for all its models without one. Lengths must be positive.
    """
    last = lambda text: F.try_element_at(F.filter(_lines(text), lambda s: s.startswith("CRYST1") & (F.length(s) >= 54)), F.lit(-1))
    all_ = _models(spark, path)
    heads = all_.where(F.col("value").rlike(r"(?m)^MODEL\s")).select("path", last(F.split("value", r"(?m)^MODEL\s", 2)[0]).alias("head")).groupBy("path").agg(F.min("head").alias("head"), F.max("head").alias("other")).where("head = other").select("path", "head")
    lines = all_.where("atoms").select("path", "model", last(F.col("value")).alias("own")).join(heads, "path", "left").select("model", F.coalesce("own", "head").alias("s"))
    one = lines.select("model", *[_part(p, 9).try_cast("double").alias(c) for p, c in ((7, "a"), (16, "b"), (25, "c"))], *[F.coalesce(_part(p, 7).try_cast("double"), F.lit(90.0)).alias(c) for p, c in ((34, "alpha"), (41, "beta"), (48, "gamma"))]).where("a > 0 and b > 0 and c > 0")
    ca, cb, cg = [F.cos(F.radians(c)) for c in ("alpha", "beta", "gamma")]
    sg, zero = F.sin(F.radians("gamma")), F.lit(0.0)
    up = (ca - cb * cg) / sg
    h = [[F.col("a"), F.col("b") * cg, F.col("c") * cb], [zero, F.col("b") * sg, F.col("c") * up], [zero, zero, F.col("c") * F.sqrt(1 - cb * cb - up * up)]]
    return one.withColumn("box_h", F.array(*[F.array(*r) for r in h]))


def read_pdb_bonds(spark: SparkSession, path: str) -> DataFrame:
    """model, i, j (serials, i < j): each bond of the CONECT records once, if both ends are atoms of the model. Records after the last model hold for all models of the file."""
    all_ = _models(spark, path)
    lines = all_.select("path", F.when(F.col("atoms"), F.col("model")).alias("own"), F.explode(_lines("value")).alias("s")).where(F.col("s").startswith("CONECT"))
    pairs = lines.select("path", "own", _number(_part(7, 5)).alias("u"), F.explode(F.array(*[_number(_part(p, 5)) for p in (12, 17, 22, 27)])).alias("v")).where("v > 0 and u != v").select("path", "own", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")).distinct()
    everywhere = pairs.where("own is null").drop("own").join(all_.where("atoms").select("path", "model").distinct(), "path")
    bonds = pairs.where("own is not null").select("path", F.col("own").alias("model"), "i", "j").unionByName(everywhere.select("path", "model", "i", "j"))
    ids = _atoms(spark, path).select("path", "model", _number(_part(7, 5)).alias("id"))
    for c in ("i", "j"):
        bonds = bonds.join(ids.withColumnRenamed("id", c), ["path", "model", c], "left_semi")
    return bonds.select("path", "model", "i", "j").distinct().select("model", "i", "j")


def write_pdb(atoms: DataFrame, path: str, boxes: DataFrame | None = None, bonds: DataFrame | None = None) -> None:
    """atoms: model, serial, name, element, x, y, z; boxes: model, a, b, c, alpha, beta, gamma; bonds: model, i, j (serials of its atoms).

    Each model stays in one file: MODEL, CRYST1, atoms, CONECT (both directions, sorted, four a line), ENDMDL. CRYST1 has
    lengths and angles, but no origin, orientation or periodic flags.
    """
    row = lambda df, part, no, sub, line: df.select("model", F.lit(part).alias("part"), no.cast("long").alias("no"), sub.cast("int").alias("sub"), line.alias("line"))
    zero = F.lit(0)
    ends = atoms.select("model").distinct()
    out = row(ends, 0, zero, zero, F.format_string("MODEL %8d", "model")).unionByName(row(ends, 4, zero, zero, F.lit("ENDMDL")))
    out = out.unionByName(row(atoms, 2, F.col("serial"), zero, F.format_string("HETATM%s %-4s MOL A   1    %8.3f%8.3f%8.3f  1.00  0.00          %2s", _serial(F.col("serial")), "name", "x", "y", "z", "element")))
    if boxes is not None:
        out = out.unionByName(row(boxes.join(ends, "model", "left_semi"), 1, zero, zero, F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 1           1", "a", "b", "c", "alpha", "beta", "gamma")))
    if bonds is not None:
        two = F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v")))).alias("e")
        near = bonds.select("model", two).select("model", "e.*").groupBy("model", "u").agg(F.array_sort(F.collect_set("v")).alias("v"))
        fours = near.select("model", "u", "v", F.explode(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 4).cast("int"))).alias("k"))
        out = out.unionByName(row(fours, 3, F.col("u"), F.col("k"), F.concat(F.lit("CONECT"), _serial(F.col("u")), F.array_join(F.transform(F.slice("v", F.col("k") * 4 + 1, F.lit(4)), _serial), ""))))
    out.repartitionByRange("model").sortWithinPartitions("model", "part", "no", "sub").select("line").write.text(path)


def read_sdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Atoms (title, id from 1, x, y, z, element) and bonds (title, i, j from 0, order) of V2000 records; V3000 records are an error when read."""
    raw = spark.read.option("lineSep", "$$$$").text(path).withColumn("l", _lines(F.regexp_replace("value", r"\A\r?\n", ""))).where(F.size("l") > 3)
    counts = F.col("l")[3]
    checked = raw.where(F.when(counts.contains("V3000"), F.raise_error(F.lit("V3000 records are not read"))).otherwise(True))
    one = checked.select(F.trim(F.col("l")[0]).alias("title"), F.btrim(F.substring(counts, 1, 3)).try_cast("int").alias("na"), F.btrim(F.substring(counts, 4, 3)).try_cast("int").alias("nb"), "l")
    number = lambda s, a, n, t: F.btrim(F.substring(s, a, n)).try_cast(t)
    atoms = one.select("title", F.posexplode(F.slice("l", F.lit(5), F.col("na"))).alias("k", "s"))
    bonds = one.select("title", F.explode(F.slice("l", F.col("na") + 5, F.col("nb"))).alias("s"))
    return (
        atoms.select("title", (F.col("k") + 1).alias("id"), *[number("s", a, 10, "double").alias(c) for a, c in ((1, "x"), (11, "y"), (21, "z"))], F.btrim(F.substring("s", 32, 3)).alias("element")),
        bonds.select("title", (number("s", 1, 3, "int") - 1).alias("i"), (number("s", 4, 3, "int") - 1).alias("j"), number("s", 7, 3, "int").alias("order")),
    )


def comment_values(comment: str) -> dict[str, str]:
    """Keys and values of an extended XYZ comment; a key alone is true. Without any = there are none."""
    if "=" not in comment:
        return {}
    try:
        words = shlex.split(comment)
    except ValueError:
        words = comment.split()
    return {k: v if eq else "true" for k, eq, v in (w.partition("=") for w in words)}


def property_columns(values: dict[str, str]) -> list[tuple[str, str]]:
    """(name, type) of each token of an atom line; pos becomes x, y, z, other properties of several tokens get numbers."""
    spec = values.get("Properties")
    if not spec:
        return [("element", "S"), ("x", "R"), ("y", "R"), ("z", "R")]
    parts, out = spec.split(":"), []
    for name, ty, m in zip(parts[::3], parts[1::3], parts[2::3]):
        n = int(m)
        if name in ("species", "element") and n == 1:
            out.append(("element", "S"))
        elif name == "pos" and n == 3:
            out += [("x", "R"), ("y", "R"), ("z", "R")]
        else:
            out += [(name if n == 1 else f"{name}_{k + 1}", ty.upper()) for k in range(n)]
    return out


XYZ = "path string, frame int, atom_idx int, element string, x double, y double, z double, more map<string,string>, meta map<string,string>"


def parse_xyz(text: str) -> list[tuple]:
    """(frame, atom_idx, element, x, y, z, more, meta) of all atoms; a frame with too few lines is an error."""
    lines, at, frame, out = text.split("\n"), 0, 0, []
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        n = int(lines[at])
        if at + 2 + n > len(lines):
            raise ValueError(f"frame {frame} ends early")
        meta = comment_values(lines[at + 1])
        columns = property_columns(meta)
        for k in range(n):
            words = lines[at + 2 + k].split()
            if len(words) < len(columns):
                raise ValueError(f"frame {frame}, atom {k}: {len(words)} values for {len(columns)} columns")
            row = {c: w for (c, _), w in zip(columns, words)}
            out.append((frame, k, row.pop("element", None), float(row.pop("x")), float(row.pop("y")), float(row.pop("z")), row, meta))
        at, frame = at + 2 + n, frame + 1
    return out


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """One row for each atom of all frames of the (extended) XYZ files; gzip by extension."""

    def run(batches):
        for b in batches:
            rows = [(p, *r) for p, t in zip(b["path"], b["value"]) for r in parse_xyz(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", XYZ)])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, XYZ)


def xyz_lines(atoms: DataFrame) -> DataFrame:
    """frame_id, part, no, line of an XYZ trajectory; atoms: frame_id, id, element, x, y, z. One order of columns in head and rows."""
    n = atoms.groupBy("frame_id").agg(F.count("*").alias("n"))
    head = F.posexplode(F.array(F.col("n").cast("string"), F.concat(F.lit("Properties=species:S:1:pos:R:3:id:I:1 frame="), F.col("frame_id")))).alias("no", "line")
    heads = n.select("frame_id", F.lit(0).alias("part"), head).select("frame_id", "part", F.col("no").cast("long").alias("no"), "line")
    rows = atoms.select("frame_id", F.lit(1).alias("part"), F.col("id").cast("long").alias("no"), F.format_string("%s %.6f %.6f %.6f %d", F.coalesce(F.nullif(F.trim("element"), F.lit("")), F.lit("X")), "x", "y", "z", "id").alias("line"))
    return heads.unionByName(rows)


def write_xyz(atoms: DataFrame, path: str) -> None:
    xyz_lines(atoms).repartitionByRange("frame_id").sortWithinPartitions("frame_id", "part", "no").select("line").write.text(path)
