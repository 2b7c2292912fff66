"""The training-corpus pipeline: five stages over ``documents``, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keytally.llm import decontaminate, mixing, quality, sharding, simhash
from keytally.sinks.sketch_store import stored

#: The mix of the pipeline: at most 80 % of the tokens that reach it, no document twice.
MIX = {"budget_share": 0.8, "max_epochs": 1, "seed": 17}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines.

    A null or empty text has no words and goes. Repeated rows are judged one by one; texts are read whole; other
    columns than those of documents are left out.
    """
    return quality.keep_good(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints (3-word shingles) linked at 2 bits or fewer: the smallest doc_id.

    Texts without words are one group; of rows that share the smallest id one stays, and a null id
    stays only where its group has no other.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; those without words have none and stay."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weights of the source tree choose.

    Rows that share id, language and source are taken or left together; nulls are values of their own; the order
    within a leaf is that of a hash of seed and id, so there are no ties but equal ids.
    """
    return mixing.keep_mixed(docs, **MIX)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row; null ids share a shard, a null text has size 16 and CRC 0."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Line labelling and components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
