"""Key streams kept as text files of decimal numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_key_stream_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated integers, any number per line; other words are dropped."""
    words = F.explode(F.split(F.trim(F.col("value")), r"\s+")).alias("word")
    return (
        spark.read.text(path)
        .select(words)
        .select(F.expr("try_cast(word AS BIGINT)").alias("key"), F.lit(1).cast("long").alias("weight"))
        .where(F.col("key").isNotNull())
    )


def write_key_stream_text(
    stream: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    """One key per line, a folder per combination of ``partition_by`` values."""
    writer = stream.select(F.col("key").cast("string").alias("value"), *partition_by).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.text(path)
