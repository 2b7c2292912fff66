"""Key streams: a ``key`` column and a ``weight`` column, drawn from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD_BREAK = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_stream(
    df: DataFrame, key: Column | str, weight: Column | str | int = 1, extra: tuple[str, ...] = ()
) -> DataFrame:
    """(key, weight, extra columns) without null keys; only these columns are scanned."""
    key = F.col(key) if isinstance(key, str) else key
    if isinstance(weight, int):
        weight = F.lit(weight)
    elif isinstance(weight, str):
        weight = F.col(weight)
    return df.select(
        key.alias("key"), weight.cast("long").alias("weight"), *extra
    ).where(F.col("key").isNotNull())


def key_stream(
    spark: SparkSession,
    folder: str,
    name: str,
    key: Column | str,
    weight: Column | str | int = 1,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One column of a parquet table as a stream."""
    return as_stream(table(spark, folder, name), key, weight, extra)


def words_of(documents: DataFrame, text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Every word of every text, lower-cased."""
    words = F.explode(F.split(F.lower(F.col(text)), WORD_BREAK)).alias("key")
    return (
        documents.select(words, *extra)
        .where(F.col("key") != "")
        .select("key", F.lit(1).cast("long").alias("weight"), *extra)
    )


def token_stream(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The words of the ``documents`` table: a stream with natural skew."""
    return words_of(table(spark, folder, "documents"), extra=extra)


def live_key_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    key: Column | str,
    weight: Column | str | int = 1,
    extra: tuple[str, ...] = (),
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files arriving under ``path`` as a streaming key stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return as_stream(reader.parquet(path), key, weight, extra)
