"""Frames and records as named tables: the public surface for users who think in frames, blocks and columns.

A ``Frame`` is a set of named blocks, each a DataFrame keyed by ``frame_id``, so that one object holds a single frame or a whole
trajectory. Nothing is computed until a table is asked for. A ``Record`` adds metadata, observables and a store of Parquet files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units of the usual unit systems.
UNIT_SYSTEMS = {
    "real": {"mass": "g/mol", "length": "angstrom", "time": "fs", "energy": "kcal/mol", "charge": "e"},
    "metal": {"mass": "g/mol", "length": "angstrom", "time": "ps", "energy": "eV", "charge": "e"},
    "gromacs": {"mass": "u", "length": "nm", "time": "ps", "energy": "kJ/mol", "charge": "e"},
    "atomic": {"mass": "m_e", "length": "bohr", "time": "hbar/hartree", "energy": "hartree", "charge": "e"},
}
FORMAT, VERSION = "orbitlake-record", 2


@dataclass
class Frame:
    blocks: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)

    def get(self, block: str, column: str, dtype: str | None = None) -> DataFrame | None:
        """frame_id and one column of a block; None if it is not there or, where dtype is given, of another type."""
        df = self.blocks.get(block)
        kinds = dict(df.dtypes) if df is not None else {}
        if column not in kinds or dtype is not None and kinds[column] != dtype:
            return None
        return df.select(*dict.fromkeys(("frame_id", column)))

    def insert(self, block: str, df: DataFrame) -> None:
        """Adds or replaces a block."""
        if "frame_id" not in df.columns:
            raise ValueError("a block needs frame_id")
        self.blocks[block] = df

    def with_column(self, block: str, column: str, values: DataFrame, key: list[str]) -> None:
        """Adds or replaces a column from a table with one row for each key of the block; a key without a value, or with two, raises when it runs."""
        df = self.blocks[block].drop(column)
        one = values.groupBy(*key).agg(F.count("*").alias("_n"), F.min(column).alias(column))
        self.blocks[block] = df.join(one, key, "left").where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"{column} and {block} differ in length")))).drop("_n")

    def remove_column(self, block: str, column: str) -> bool:
        if block not in self.blocks or column not in self.blocks[block].columns:
            return False
        self.blocks[block] = self.blocks[block].drop(column)
        return True

    def rename_column(self, block: str, old: str, new: str) -> bool:
        """False if there is no such column, or one of the new name already."""
        cols = self.blocks[block].columns if block in self.blocks else []
        if old not in cols or new in cols:
            return False
        self.blocks[block] = self.blocks[block].withColumnRenamed(old, new)
        return True

    def remove_block(self, block: str) -> DataFrame | None:
        return self.blocks.pop(block, None)

    def rename_block(self, old: str, new: str) -> bool:
        if old not in self.blocks or new in self.blocks:
            return False
        self.blocks[new] = self.blocks.pop(old)
        return True

    def clear(self) -> None:
        """Removes the blocks, and keeps meta."""
        self.blocks.clear()

    def clear_all(self) -> None:
        self.blocks.clear()
        self.meta.clear()

    def frame_at(self, frame_id: int) -> Frame:
        """The blocks of one frame; tables stored by frame_id are read of that frame only."""
        return Frame({k: v.where(F.col("frame_id") == frame_id) for k, v in self.blocks.items()}, dict(self.meta))

    def count_frames(self) -> int:
        """Different frames of all blocks, 1 at least."""
        ids = None
        for df in self.blocks.values():
            one = df.select("frame_id")
            ids = one if ids is None else ids.unionAll(one)
        return max(1, ids.distinct().count()) if ids is not None else 1

    def merge(self, other: Frame, ends: dict[str, list[str]]) -> Frame:
        """Both as one frame each: the atoms of other get the ids above those here, and so do the columns that ends names for each block of links.

        Blocks of one name must have the same columns. Frames of other that are not here stay as they are.
        """
        top = self.blocks["atoms"].groupBy("frame_id").agg(F.max("id").alias("_top"))

        def moved(df: DataFrame, cols: list[str]) -> DataFrame:
            return df.join(top, "frame_id", "left").withColumns({c: F.col(c) + F.coalesce("_top", F.lit(0)) for c in cols}).select(*df.columns)

        out = Frame(dict(self.blocks), self.meta | other.meta)
        for name, df in other.blocks.items():
            df = moved(df, ["id"] if name == "atoms" else ends.get(name, []))
            if name in out.blocks and sorted(out.blocks[name].dtypes) != sorted(df.dtypes):
                raise ValueError(f"columns of {name} differ")
            out.blocks[name] = out.blocks[name].unionByName(df) if name in out.blocks else df
        return out

    def remove_atoms(self, gone: DataFrame, ends: dict[str, list[str]]) -> Frame:
        """Without the atoms of gone (frame_id, id), and without every link at one of them."""
        g = gone.select("frame_id", "id").distinct()
        out = Frame(dict(self.blocks), dict(self.meta))
        out.blocks["atoms"] = self.blocks["atoms"].join(g, ["frame_id", "id"], "left_anti")
        for name, cols in ends.items():
            for c in cols:
                if name in out.blocks:
                    out.blocks[name] = out.blocks[name].join(g.withColumnRenamed("id", c), ["frame_id", c], "left_anti").select(*out.blocks[name].columns)
        return out


@dataclass
class Record:
    """A frame or trajectory with its metadata and observables (name to a table with frame_id, and a kind: scalar, vector or grid)."""

    frame: Frame
    meta: dict = field(default_factory=dict)
    observables: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)

    KINDS = {"scalar": "value", "vector": "values", "grid": "grid_values"}

    def add_observable(self, name: str, kind: str, df: DataFrame) -> None:
        """Raises for a kind that is not known, or a table without the column of its kind."""
        if kind not in self.KINDS:
            raise ValueError(f"no kind {kind}")
        if self.KINDS[kind] not in df.columns or "frame_id" not in df.columns:
            raise ValueError(f"{name} needs frame_id and {self.KINDS[kind]}")
        self.observables[name] = (kind, df)

    def remove_observable(self, name: str) -> bool:
        return self.observables.pop(name, None) is not None

    def write(self, spark: SparkSession, path: str, files_of: int = 1000) -> None:
        """A folder of Parquet tables, in folders of ``files_of`` frames each so that one frame is read without the others, and record.json, written last.

        The blocks keep their order by frame_id inside the files, so that row groups are skipped too. A unit system that is not known raises.
        """
        if self.meta.get("units") not in {None, *UNIT_SYSTEMS}:
            raise ValueError(f"no unit system {self.meta['units']}")
        tables = {f"blocks/{k}": v for k, v in self.frame.blocks.items()} | {f"observables/{k}": v for k, (_, v) in self.observables.items()}
        for name, df in tables.items():
            df.withColumn("frame_part", F.floor(F.col("frame_id") / files_of).cast("long")).repartitionByRange("frame_part", "frame_id").sortWithinPartitions("frame_part", "frame_id").write.partitionBy("frame_part").parquet(f"{path}/{name}")
        head = {"format": FORMAT, "version": VERSION, "meta": self.meta, "frame_meta": self.frame.meta, "blocks": sorted(self.frame.blocks), "observables": {k: kind for k, (kind, _) in self.observables.items()}, "files_of": files_of, "id": uuid.uuid4().hex}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/record.json")

    @staticmethod
    def read(spark: SparkSession, path: str, frame_id: int | None = None) -> Record:
        """The record, or one frame of it, for which only its folder is read. A folder of another format or version raises."""
        head = json.loads(spark.read.text(f"{path}/record.json").first()[0])
        if (head["format"], head["version"]) != (FORMAT, VERSION):
            raise ValueError(f"{path} holds {head['format']} {head['version']}")

        def load(name: str) -> DataFrame:
            df = spark.read.parquet(f"{path}/{name}")
            if frame_id is not None:
                df = df.where((F.col("frame_part") == frame_id // head["files_of"]) & (F.col("frame_id") == frame_id))
            return df.drop("frame_part")

        return Record(Frame({b: load(f"blocks/{b}") for b in head["blocks"]}, head["frame_meta"]), head["meta"], {k: (kind, load(f"observables/{k}")) for k, kind in head["observables"].items()})

    @staticmethod
    def append(df: DataFrame, path: str, block: str, files_of: int = 1000) -> None:
        """Adds rows of new frames to a block of a record."""
        df.withColumn("frame_part", F.floor(F.col("frame_id") / files_of).cast("long")).write.mode("append").partitionBy("frame_part").parquet(f"{path}/blocks/{block}")
