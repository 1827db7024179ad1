"""Shared-folder files and tables of one operator call."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barweave.session import stage_folder


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` so that a lost executor never costs a plan.

    ``keep`` writes a frame and reads it back; ``drop`` deletes a table that later steps no
    longer read.  What a returned frame still reads stays until the application's folder goes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept = 0

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.kept += 1
        path = self.path(f"{self.kept:03d}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(p, True)


def open_fs(uri: str):
    """(filesystem, path) for files that tasks read and write in the shared folder."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def is_local(filesystem) -> bool:
    from pyarrow import fs
    return isinstance(filesystem, fs.LocalFileSystem)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash with names an operator adds (case-insensitive)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
