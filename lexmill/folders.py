"""The folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or one in the warehouse, which is shared as well; checkpoints go there."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
