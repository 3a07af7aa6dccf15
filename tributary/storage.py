"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_uri(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the session's JVM ends. The setting is
    the cluster's; only where none is set, on one machine, a folder of our own is used."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", root)
    fs, path = file_system(spark, f"{root.rstrip('/')}/tributary-{uuid.uuid4().hex}")
    path = fs.makeQualified(path)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def file_system(spark: SparkSession, uri: str) -> tuple:
    """The file system of a URI, and its path there, as the JVM has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def spread(df: DataFrame, *keys: str, mb: int = 8) -> DataFrame:
    """``df`` in partitions by keys: as many as shuffles have, and one for each ``mb`` that Spark expects
    of it, so that a task's rows don't grow with the table and aren't put together again."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(min(10_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))), *keys)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written and read back: its lineage ends there, and a lost executor loses none of it."""
    uri = scratch_uri(df.sparkSession) + "/t"
    df.write.parquet(uri)
    return df.sparkSession.read.parquet(uri)
