"""The registered queries of the training-data operators, with the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keytally.llm import (
    centroids,
    decontaminate,
    licenses,
    mixing,
    phrases,
    pii,
    quality,
    sharding,
    simhash,
    tokens,
    toxicity,
    urls,
    warc,
)
from keytally.plans.registry import Registry

reg = Registry()
#: The mix of op2: 60 % of the tokens there are, no leaf more than twice over.
MIX = {"budget_share": 0.6, "max_epochs": 2, "seed": 17}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@reg.query("op1_warc_chunks", warc.RECORDS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, read back as chunk rows, one result row per record."""
    chunks = warc.read_chunks(warc.write_archives(_table(spark, sf_dir, "pages")))
    return warc.whole_records(chunks).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@reg.query("op2_mix_budgets", mixing.mix_sql(**MIX))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), **MIX)


@reg.query("op3_license_sentences", licenses.license_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@reg.query("op4_simhash_pigeonring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@reg.query("op5_fm_index_decontamination", decontaminate.OVERLAP_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    ).drop("spans")


@reg.query("op6_jump_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@reg.query("op7_token_frames")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    written = tokens.write_token_files(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return tokens.read_token_files(*written)


@reg.query("op8_toxicity_automata")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@reg.query("op9_crf_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


@reg.query("op10_disclosing_terms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


@reg.query("op11_url_filter", urls.judge_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.reported_urls(pages))


@reg.query("op12_phrase_collocations", phrases.collocation_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


@reg.query("op13_centroid_clusters", centroids.cluster_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("centroid")
