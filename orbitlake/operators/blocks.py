"""Blocks of columns: insert, rename, resize, merge; grids of samples as voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def default(kind: T.DataType):
    """What a missing value of a type becomes: 0, false or an empty text."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.lit("")
    return F.lit(0).cast(kind)


def rename(block: DataFrame, old: str, new: str) -> DataFrame:
    """Renames a column; raises if it isn't there or the new name is taken."""
    if old not in block.columns or new in block.columns:
        raise ValueError(f"can't rename {old} to {new}")
    return block.withColumnRenamed(old, new)


def resize(block: DataFrame, rows: int, index: str = "atom_idx", key: str | None = None) -> DataFrame:
    """Exactly ``rows`` rows, numbered from 0: cut off, or filled with defaults; with a key, for each of its values."""
    kept = block.where(F.col(index) < rows)
    fields = {f.name: f.dataType for f in block.schema.fields}
    if rows == 0:
        return kept
    numbers = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    all_ = (block.select(key).distinct() if key else block.sparkSession.range(1)).select(*([key] if key else []), numbers.alias(index)).withColumn(index, F.col(index).cast(fields[index]))
    on = [key, index] if key else [index]
    lost = all_.join(kept.select(*on), on, "left_anti")
    return kept.unionByName(lost.select(*[F.col(c) if c in on else default(t).alias(c) for c, t in fields.items()]))


def merge(a: DataFrame, b: DataFrame, index: str = "atom_idx") -> DataFrame:
    """Rows of a and then of b, whose numbers go on after those of a; both must have the same columns and types."""
    if {f.name: f.dataType for f in a.schema.fields} != {f.name: f.dataType for f in b.schema.fields}:
        raise ValueError("blocks differ in their columns or types")
    offset = a.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("_offset"))
    moved = b.join(F.broadcast(offset)).withColumn(index, (F.col(index) + F.col("_offset")).cast(dict(b.dtypes)[index])).drop("_offset")
    return a.unionByName(moved)


def voxels(fields: DataFrame) -> DataFrame:
    """field_id, idx, ix, iy, iz, x, y, z, value: the samples of row-major grids; position = origin + sum of (i / n) cell_i.

    cell holds three vectors after each other. Null samples stay; grids whose sample number isn't the product of their shape have none.
    """
    n = [F.col("shape")[k] for k in range(3)]
    good = fields.where((F.size("shape") == 3) & (F.size("grid_values") == n[0] * n[1] * n[2]) & (F.size("cell") == 9))
    one = good.select("field_id", "shape", "grid_origin", "cell", F.posexplode("grid_values").alias("idx", "value"))
    i = [F.floor(F.col("idx") / (n[1] * n[2])).cast("int"), (F.floor(F.col("idx") / n[2]) % n[1]).cast("int"), (F.col("idx") % n[2]).cast("int")]
    part = [i[k].cast("double") / n[k] for k in range(3)]
    at = [F.col("grid_origin")[c] + part[0] * F.col("cell")[c] + part[1] * F.col("cell")[3 + c] + part[2] * F.col("cell")[6 + c] for c in range(3)]
    return one.select("field_id", "idx", *[v.alias(f"i{c}") for v, c in zip(i, "xyz")], *[v.alias(c) for v, c in zip(at, "xyz")], "value")


def point_cloud(vox: DataFrame, threshold: float, stride: int = 1) -> DataFrame:
    """Voxels with |value| >= threshold, of each grid every ``stride``-th index, as helium atoms."""
    return vox.where((F.abs("value") >= threshold) & (F.col("idx") % stride == 0)).withColumn("element", F.lit("He"))
