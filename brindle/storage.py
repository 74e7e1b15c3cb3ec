"""Shared-folder helpers: lineage is cut by written tables that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for an unset local session."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_ = tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(set_)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return set_.rstrip("/")


def scratch(spark: SparkSession, kind: str = "cut") -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/brindle-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: recomputation after a lost executor starts here.

    Returns the table and its path, for :func:`drop` once nothing reads it any more.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`cut` wrote."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
