"""Shared scratch space: lineage cuts and tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named, one of our own, in local mode only (as in tests).

    Executors on other machines would not see a folder of the driver's, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cataloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, and its files go when nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession):
    """Inside, shuffle files of a finished action are removed at once instead of at some later collection."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables that live as long as a ``with`` block. Written and read back, they have the size that they really have.

    A checkpoint inherits the planner's estimate, and estimates of joins multiply: after tens of joins one
    after the other they are numbers of millions of digits. A table that was read starts afresh, and small ones get broadcast.
    """

    def __init__(self, spark: SparkSession):
        self.store, self.n = Store(spark, "scratch"), 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return self.store.write(df, f"t{self.n}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.store.drop("")


class Store:
    """A folder of Parquet tables below the shared folder, for results that must exist as files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
