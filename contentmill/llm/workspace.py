"""Intermediate tables in the folder that every executor can reach."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """The session names no folder for intermediate tables."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session on one machine may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/contentmill"


class Workspace:
    """Writes tables below the shared folder and reads them back.

    A written table cuts the lineage and survives a lost executor. ``finish`` writes the
    result and removes all others; ``drop`` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: list[str] = []
        self.held: list[DataFrame] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        try:
            df.write.mode("overwrite").parquet(path)
        except BaseException:
            self.free(*self.held)
            self._delete(self.root)
            raise
        self.kept.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def table_of(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def keep(self, df: DataFrame) -> DataFrame:
        """Persists small rows that are read more than once and needed for a short time
        only, which takes less than a table's files. ``free`` or ``finish`` lets them go.
        Only rows derived from tables: plans of kept rows upon kept rows fill the driver."""
        self.held.append(df.persist())
        return df

    def free(self, *frames: DataFrame) -> None:
        for df in frames:
            if any(df is x for x in self.held):
                df.unpersist()
                self.held = [x for x in self.held if x is not df]

    def finish(self, df: DataFrame) -> DataFrame:
        out = self.table(df, "result")
        self.free(*self.held)
        self.drop(*[name for name in self.kept if name != "result"])
        return out

    def release(self) -> None:
        """Lets the cleaner remove shuffle files of finished steps, which it does once the
        driver's handles to them are collected. For steps with large shuffles."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
            if name in self.kept:
                self.kept.remove(name)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
