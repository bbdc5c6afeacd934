"""Session helpers: tables, and written intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Share of all rows from which on a key counts as hot. At most 1 / HOT_SHARE keys can be hot, which bounds their broadcast.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master without it a folder made here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orbitlake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, which cut the lineage and survive the loss of any executor.

    They are compressed and columnar. ``drop`` deletes one as soon as nothing reads it; the rest goes when the session ends.
    A table is written by one query and then read from its files, so that its shuffle files go as soon as it stands.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self._number = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The table as written; by is a column whose values become folders, so that a reader of one value skips the others."""
        self._number += 1
        path = f"{self.root}/{self._number}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path), True)
