"""Result files of measurement runs as typed tables.

Every reader gives the file's name along, which tells the run's parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"([-+0-9.eE]+|nan)"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))


def _field(pattern: str, group: int = 1, kind: str = "double") -> Column:
    return F.regexp_extract("value", pattern, group).cast(kind)


# Fixed value: the run's parameters as they follow each other in a file's name.
RUN_NAME = r"_(\d+)_([0-9.]+)_([0-9.]+)_(\d+)_(\d+)_(\d+)_(\d+)_"
RUN_PARAMETERS = {
    "threads": "int",
    "skew": "double",
    "phi": "double",
    "filter_sum": "bigint",
    "filter_keys": "bigint",
    "n": "bigint",
    "query_rate": "int",
}


def with_run_parameters(log: DataFrame) -> DataFrame:
    """The run's parameters, read from the column ``file``; null where a name has none."""
    found = [
        F.regexp_extract("file", RUN_NAME, i).try_cast(kind).alias(name)
        for i, (name, kind) in enumerate(RUN_PARAMETERS.items(), start=1)
    ]
    return log.select("*", *found)


def read_throughput(spark: SparkSession, path: str) -> DataFrame:
    """(file, mops) of lines ``Total processing throughput <f> ...``."""
    pattern = rf"^Total processing throughput {NUMBER}"
    return _lines(spark, path).where(F.col("value").rlike(pattern)).select(
        "file", _field(pattern).alias("mops")
    )


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    """(file, latency_us) of lines ``Average latency: <f> ...``."""
    pattern = rf"^Average latency: {NUMBER}"
    return _lines(spark, path).where(F.col("value").rlike(pattern)).select(
        "file", _field(pattern).alias("latency_us")
    )


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """(file, precision, recall, are) of lines ``Precision:<f>, Recall:<f>, Average...:<f>``."""
    pattern = rf"^Precision:{NUMBER}, Recall:{NUMBER}, AverageRelativeError:{NUMBER}"
    return _lines(spark, path).where(F.col("value").rlike(pattern)).select(
        "file",
        _field(pattern, 1).alias("precision"),
        _field(pattern, 2).alias("recall"),
        _field(pattern, 3).alias("are"),
    )


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, counters) of lines ``<bytes> <counters>``."""
    pattern = r"^(\d+) (\d+)\s*$"
    return _lines(spark, path).where(F.col("value").rlike(pattern)).select(
        "file",
        _field(pattern, 1, "bigint").alias("bytes"),
        _field(pattern, 2, "bigint").alias("counters"),
    )


RANK_LINE = r"^(\d+) (\S+) (\d+) (\S+) (\d+) ([01])\s*$"
RANK_HEADER = rf"^(\d+) (\d+) {NUMBER}\s*$"
# How a missing reported key is written.
NO_KEY = ("4294967295", "-1")


def read_rank_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, rank, true_key, true_cnt, est_key, est_cnt, equal); a missing key is null."""
    found = F.regexp_extract("value", RANK_LINE, 4)
    return _lines(spark, path).where(F.col("value").rlike(RANK_LINE)).select(
        "file",
        _field(RANK_LINE, 1, "int").alias("rank"),
        _field(RANK_LINE, 2, "bigint").alias("true_key"),
        _field(RANK_LINE, 3, "bigint").alias("true_cnt"),
        F.when(~found.isin(*NO_KEY), found).cast("bigint").alias("est_key"),
        _field(RANK_LINE, 5, "bigint").alias("est_cnt"),
        (_field(RANK_LINE, 6, "int") == 1).alias("equal"),
    )


def read_rank_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, k, phi) of the files' first lines."""
    return _lines(spark, path).where(F.col("value").rlike(RANK_HEADER)).select(
        "file",
        _field(RANK_HEADER, 1, "bigint").alias("n"),
        _field(RANK_HEADER, 2, "bigint").alias("k"),
        _field(RANK_HEADER, 3).alias("phi"),
    )


def write_log_lines(lines: DataFrame, path: str, line: Column) -> None:
    """One line of text per row."""
    lines.select(line.alias("value")).write.text(path)
