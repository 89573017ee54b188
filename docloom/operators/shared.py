"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or in our own where none is set and the session is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "/tmp/checkpoints"
    return f"{top.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, name: str) -> str:
    """A path as `folder` gives, deleted when the session's JVM ends."""
    path = folder(spark, name)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written to a temporary path and read again: the lineage is cut and a lost executor costs its tasks only."""
    path = temporary(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
