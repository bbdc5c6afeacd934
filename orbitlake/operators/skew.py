"""Hot keys: keys with so many rows that one task must not take them all.

They are found by counting all rows in buckets of a hash, which takes next to no shuffle, and then the keys of the few
buckets that are too full. There can be at most 1 / HOT_SHARE hot keys, so that tables of one row for each are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.runtime import HOT_SHARE, Scratch

BUCKETS = 4096
#: Rows that any task can take. A key with fewer is never hot.
TASK_ROWS = 100_000


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def hot_keys(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame | None, int]:
    """The hot keys of rows, at most 1 / HOT_SHARE of them, or None; and the number of rows."""
    counts = {r[0]: r[1] for r in rows.groupBy(_bucket(keys).alias("b")).count().collect()}
    total = sum(counts.values())
    limit = max(TASK_ROWS, total * HOT_SHARE)
    full = [b for b, n in counts.items() if n > limit]
    if not full:
        return None, total
    found = scratch.put(rows.where(_bucket(keys).isin(full)).groupBy(*keys).count().where(F.col("count") > limit).select(*keys))
    return (found if found.limit(1).count() else None), total


def split(rows: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys, and the others."""
    small = F.broadcast(hot)
    return rows.join(small, keys, "left_semi"), rows.join(small, keys, "left_anti")


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "left") -> DataFrame:
    """Joins values, which have one row for each key, to rows, the hot keys of which are known."""
    if hot is None:
        return rows.join(values, keys, how)
    warm, cold = split(rows, hot, keys)
    few = F.broadcast(values.join(F.broadcast(hot), keys, "left_semi"))
    return warm.join(few, keys, how).unionByName(cold.join(values, keys, how))


def numbered(rows: DataFrame, group: str, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Adds name: the place of a row in its group by order, from 0. No task takes a whole group.

    Rows are cut into ranges of (group, order); places inside a range are counted apart, and shifted by the sizes of the ranges before it.
    """
    cut = scratch.put(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    inner = cut.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1)
    sizes = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(group, "_part", "_start")
    return inner.join(starts, [group, "_part"]).withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")
