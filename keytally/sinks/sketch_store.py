"""Keeping summaries and sketches as parquet tables, with a checked header."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytally.session import work_path
from keytally.sinks.folders import remove

FORMAT_VERSION = 1


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back; a folder for each value of its last column, if that is ``by``.

    A summary is small and is used several times by a query; stored, it is computed once,
    all uses see the same counters, and a lost executor does not bring it back.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Removes a table that ``stored`` wrote, once nothing will read it again."""
    remove(kept.sparkSession, kept.stored_at)


def save_sketch(sketch: DataFrame, path: str, kind: str, **params) -> None:
    """Writes the cells or counters under ``path/data`` and what they are under ``path/head``."""
    sketch.write.parquet(f"{path}/data")
    columns = {f.name: f.dataType.simpleString() for f in sketch.schema.fields}
    head = sketch.sparkSession.range(1).select(
        F.lit(kind).alias("kind"),
        F.lit(FORMAT_VERSION).alias("version"),
        F.lit(json.dumps(params, sort_keys=True)).alias("params"),
        F.lit(json.dumps(columns)).alias("columns"),
    )
    head.coalesce(1).write.parquet(f"{path}/head")


def load_sketch(spark: SparkSession, path: str, kind: str, **params) -> DataFrame:
    """Reads a sketch back; refuses another kind, version, shape or a broken table."""
    head = spark.read.parquet(f"{path}/head").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    if head.kind != kind:
        raise ValueError(f"{path} holds a {head.kind} sketch, not {kind}")
    if head.version != FORMAT_VERSION:
        raise ValueError(f"{path} has format {head.version}, not {FORMAT_VERSION}")
    kept = json.loads(head.params)
    wrong = {k: (kept.get(k), v) for k, v in params.items() if kept.get(k) != v}
    if wrong:
        raise ValueError(f"{path} was built with other parameters: {wrong}")
    data = spark.read.parquet(f"{path}/data")
    have = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    if have != json.loads(head.columns):
        raise ValueError(f"{path} is damaged: its columns do not match its header")
    return data
