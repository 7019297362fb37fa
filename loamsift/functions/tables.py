"""Intermediate tables in the shared folder: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``.

    Where the session names none, a folder of this machine is used on a local master, as in tests; on a cluster that is an error, since
    each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="scratch-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows of ``df`` as a table in the shared folder."""
    path = f"{scratch_dir(df.sparkSession)}/{name}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one call, so that they can be deleted once their readers are done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, scratch_dir(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for n in names:
            remove(self.spark, f"{self.path}/{n}")

    def drop_all(self) -> None:
        remove(self.spark, self.path)
