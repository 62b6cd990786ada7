"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of this machine only where none is configured (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Cuts:
    """Tables written to the shared folder to cut lineage; drop() removes those no longer needed.

    A written table outlives a lost executor, which a local checkpoint does not.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, list[str]]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, [path]  # holds the frame, so that its id stays its own
        return out

    def together(self, *frames: DataFrame) -> DataFrame:
        """Tables of this object, of equal columns, read as one, which takes them over: a table that grows is not written again."""
        paths = [p for df in frames for p in self.paths.pop(id(df))[1]]
        out = self.spark.read.schema(frames[0].schema).parquet(*paths)
        self.paths[id(out)] = out, paths
        return out

    def settle(self, df: DataFrame) -> DataFrame:
        """Write a result and remove all the tables that led to it."""
        out = self.cut(df)
        self.drop(*[x for x, _ in self.paths.values() if x is not out])
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if entry := self.paths.pop(id(df), None):
                for path in entry[1]:
                    remove(self.spark, path)
