"""Problem 3: references to records that do not exist.

A reference is a composite key whose columns may be null. References are grouped by their null mask; each mask is
checked on its non-null columns, under the declared match semantics of SQL foreign keys.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", target_info: list[str] | None = None) -> DataFrame:
    """The rows of refs whose key isn't among targets, with ``null_mask`` (1 where a key column is null).

    match: ``simple`` - a key with any null is no reference; ``partial`` - only its non-null columns must be found,
    and an all-null key is no reference; ``full`` - nulls in some but not all columns are a violation in themselves.
    With ``target_info``, targets must have unique keys; the rows that are found come out too, with these columns, and
    the orphans have nulls there and ``is_orphan`` true (columns of refs with these names are replaced): one pass for checks that need the target's data.
    Repeated rows of refs stay; repeated targets count once; empty targets make every reference an orphan. Other
    columns of targets are ignored, so that equal names don't clash.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    mask = F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])
    marked = refs.drop("is_orphan", *(target_info or [])).withColumn("null_mask", mask)
    whole, none = "0" * len(keys), "1" * len(keys)
    parts = []
    info = target_info or []
    here = marked.where(F.col("null_mask") == whole) if match != "simple" else marked.where(F.coalesce(*[F.when(F.col(k).isNull(), F.lit(True)) for k in keys], F.lit(False)) == F.lit(False))
    there = targets.select(*keys, *info).where(" and ".join(f"`{k}` is not null" for k in keys))
    if info:
        found = there.withColumn("_there", F.lit(True))
        parts.append(here.join(found, keys, "left").withColumn("is_orphan", F.col("_there").isNull()).drop("_there").select(*marked.columns, *info, "is_orphan"))
    else:
        parts.append(here.join(there.distinct(), keys, "left_anti").select(*marked.columns))
    for bits in product("01", repeat=len(keys)):
        m = "".join(bits)
        if match == "simple" or m in (whole, none):
            continue
        some = marked.where(F.col("null_mask") == m)
        if match == "partial":
            held = [k for k, b in zip(keys, bits) if b == "0"]
            some = some.join(targets.select(*held).where(" and ".join(f"`{k}` is not null" for k in held)).distinct(), held, "left_anti").select(*marked.columns)
        if info:
            types = dict(targets.dtypes)
            some = some.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in info], F.lit(True).alias("is_orphan"))
        parts.append(some)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def atom_references(bonds: DataFrame, angles: DataFrame, conect: DataFrame) -> DataFrame:
    """tab, row_id, ref_field, frame_id, id, t: one row for every reference; 0 is turned into null, which is no reference."""

    def some(df: DataFrame, tab: str, row: str, fields: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).cast("long").alias("id")) for f in fields]))
        return df.select(F.lit(tab).alias("tab"), F.col(row).alias("row_id"), each.alias("r"), "frame_id", F.col("recorded_at").alias("t"))

    out = some(bonds, "bonds", "bond_id", ["atom_i", "atom_j"]).unionAll(some(angles, "angles", "angle_id", ["atom_i", "atom_j", "atom_k"]))
    entries = F.explode(F.transform("bonded", lambda x: F.struct(F.lit("bonded").alias("ref_field"), x.cast("long").alias("id"))))
    out = out.unionAll(conect.select(F.lit("conect").alias("tab"), F.col("conect_id").alias("row_id"), entries.alias("r"), "frame_id", F.col("recorded_at").alias("t")))
    return out.select("tab", "row_id", "r.ref_field", "frame_id", F.nullif(F.col("r.id"), F.lit(0)).alias("id"), "t")


def atom_lifetimes(atoms: DataFrame, drops: DataFrame) -> DataFrame:
    """frame_id, id, born (earliest recorded_at), died (earliest deleted_at or null): one row for each atom that has an atoms row."""
    seen = atoms.select("frame_id", F.col("id").cast("long").alias("id"), F.col("recorded_at").alias("born"), F.lit(None).cast("timestamp_ntz").alias("died"), F.lit(1).alias("n"))
    gone = drops.select("frame_id", F.col("id").cast("long").alias("id"), F.lit(None).cast("timestamp_ntz").alias("born"), F.col("deleted_at").alias("died"), F.lit(0).alias("n"))
    return seen.unionAll(gone).groupBy("frame_id", "id").agg(F.min("born").alias("born"), F.min("died").alias("died"), F.max("n").alias("n")).where("n = 1").drop("n")


def orphan_references(atoms: DataFrame, drops: DataFrame, bonds: DataFrame, angles: DataFrame, conect: DataFrame) -> DataFrame:
    """References to atoms that are missing, late or deleted at the time of the referring row, each once."""
    refs = atom_references(bonds, angles, conect)
    checked = orphans(refs, atom_lifetimes(atoms, drops), ["frame_id", "id"], "simple", ["born", "died"])
    kind = F.when(F.col("is_orphan"), "missing").when(F.col("t") < F.col("born"), "late").when(F.col("died") <= F.col("t"), "deleted")
    out = checked.select("tab", "row_id", "ref_field", F.col("id").alias("atom_id"), kind.alias("orphan_kind"), F.date_format("t", "yyyy-MM").alias("rec_month"))
    return out.where("orphan_kind is not null").distinct()


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Number of orphan references per table, field, kind and month."""
    return found.groupBy("tab", "ref_field", "orphan_kind", "rec_month").agg(F.count("*").alias("n_refs"), F.countDistinct("row_id").alias("n_rows"))
