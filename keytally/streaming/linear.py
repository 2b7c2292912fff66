"""Linear and majority sketches kept up over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from keytally.functions.seeds import SeedTable
from keytally.operators.linear import linear_sketch
from keytally.operators.majority import majority_local, majority_merge
from keytally.streaming.runner import batch_writer, batches, newest, one_batch, run

CELLS = "row int, bucket long, v long"


def run_linear_sketch(
    stream: DataFrame,
    seeds: SeedTable,
    buckets: int,
    folder: str,
    signed: bool = False,
    code: Column | None = None,
    partitions: int | None = None,
) -> list:
    """Count-Min or, signed, Fast-AGMS: a streaming grouped sum whose state is the cells. There
    are at most rows x buckets of them, so every micro-batch writes them all."""
    cells = linear_sketch(stream, seeds, buckets, signed, code=code)
    write = batch_writer(f"{folder}/cells", keep=2)
    return run(cells, write, f"{folder}/checkpoint", "complete", partitions)


def stream_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The sketch as of now."""
    return newest(spark, f"{folder}/cells", CELLS)


def run_majority_sketch(
    stream: DataFrame, seeds: SeedTable, buckets: int, folder: str, code: Column | None = None
) -> list:
    """The votes cast within the tasks of each micro-batch, merged into the sketch before it: only cells are
    shuffled, however many keys a micro-batch has."""
    schema = _votes_schema(stream.schema["key"].dataType)
    columns = ["row", "bucket", "cand", "cnt"]

    def each(batch: DataFrame, batch_id: int) -> None:
        now = majority_local(batch, seeds, buckets, code).select(columns)
        if batch_id > 0:
            before = one_batch(batch.sparkSession, f"{folder}/votes", schema, batch_id - 1)
            now = now.unionByName(before)
        batch_writer(f"{folder}/votes", keep=2)(majority_merge(now).select(columns), batch_id)

    return run(stream.select("key", "weight"), each, f"{folder}/checkpoint")


def _votes_schema(key_type: DataType) -> StructType:
    return StructType.fromDDL("row int, bucket long").add(StructField("cand", key_type)).add(
        StructField("cnt", LongType())
    )


def stream_votes(spark: SparkSession, folder: str, key_type: DataType) -> DataFrame:
    """The newest majority sketch."""
    return newest(spark, f"{folder}/votes", _votes_schema(key_type))


def run_histogram(
    stream: DataFrame, folder: str, partitions: int | None = None, drain: bool = False
) -> list:
    """Exact counts of a stream; state grows with the distinct keys."""
    counts = stream.groupBy("key").agg(F.sum("weight").alias("cnt"))
    write = batch_writer(f"{folder}/counts")
    return run(counts, write, f"{folder}/checkpoint", "update", partitions, drain)


def stream_histogram(spark: SparkSession, folder: str, key_type: DataType) -> DataFrame:
    """Each key's newest count."""
    schema = StructType([StructField("key", key_type), StructField("cnt", LongType())])
    rows = batches(spark, f"{folder}/counts", schema)
    return rows.groupBy("key").agg(F.max_by("cnt", "batch").alias("cnt"))
