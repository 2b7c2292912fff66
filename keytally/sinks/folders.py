"""Listing and removing folders on any file system that Spark itself can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies directly in a folder; none where there is no such folder."""
    system, where = _system(spark, path)
    if not system.exists(where):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(where))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder with all that is in it; nothing happens where there is none."""
    system, where = _system(spark, path)
    system.delete(where, True)
