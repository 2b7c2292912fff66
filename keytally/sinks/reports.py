"""Reports on summaries, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytally.functions.seeds import SeedTable
from keytally.operators.linear import count_min_query
from keytally.operators.summaries import counters_of, heads_of
from keytally.sinks.sketch_store import stored

# Fixed value: ranks listed past the end of the result.
EXTRA_RANKS = 100


def _ranked(df: DataFrame, cnt: str) -> DataFrame:
    """All rows with their rank from 0, the largest ``cnt`` first, ties by key.

    Rows are dealt out by range and numbered within their part; only the parts' sizes are summed
    across. The dealt rows are stored, as parts keep their numbers only then.
    """
    order = [F.desc(cnt), F.asc("key")]
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = dealt.withColumn("_at", inside).join(starts, "_part")
    rank = (F.col("_start") + F.col("_at") - 1).cast("int")
    return numbered.withColumn("rank", rank).drop("_part", "_at", "_start")


def rank_comparison_report(hist: DataFrame, result: DataFrame, phi: float) -> DataFrame:
    """(rank, true_key, true_cnt, est_key, est_cnt, equal): exact and reported keys side by side,
    to EXTRA_RANKS past the end of the result.

    ``result`` holds the keys (key, est) reported at ``phi``, however many.
    """
    size = result.agg(F.count(F.lit(1)).alias("n")).scalar()
    true = _ranked(hist, "cnt").where(F.col("rank") <= size + EXTRA_RANKS)
    found = _ranked(result.select("key", "est"), "est").select(
        "rank", F.col("key").alias("est_key"), F.col("est").alias("est_cnt")
    )
    return true.join(found, "rank", "left").select(
        "rank",
        F.col("key").alias("true_key"),
        F.col("cnt").alias("true_cnt"),
        "est_key",
        F.coalesce("est_cnt", F.lit(0)).alias("est_cnt"),
        F.coalesce(F.col("key") == F.col("est_key"), F.lit(False)).alias("equal"),
    )


def rank_header(hist: DataFrame, phi: float) -> DataFrame:
    """(n, k, phi): the stream size and the number of frequent keys."""
    total = hist.agg(F.sum("cnt").alias("n")).scalar()
    bar = F.lit(phi) * total
    return hist.agg(
        F.sum("cnt").alias("n"), F.count_if(F.col("cnt") >= bar).alias("k"), F.lit(phi).alias("phi")
    )


def frequency_report(
    domain: DataFrame, hist: DataFrame, sketch: DataFrame, seeds: SeedTable, buckets: int
) -> DataFrame:
    """(key, true_cnt, est) for every key of the domain."""
    rows = domain.select("key").join(hist, "key", "left")
    return count_min_query(sketch, rows, seeds, buckets).select(
        "key", F.coalesce("cnt", F.lit(0)).alias("true_cnt"), "est"
    )


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.write.mode(mode).parquet(path)


def summary_to_string(summary: DataFrame, epsilon: Column | float | None = None, items: int = 0) -> DataFrame:
    """One row ``summary``: active items, total weight, maximum error and, if asked, the epsilon
    and the largest items."""
    rows = counters_of(summary).groupBy("key").agg(F.sum("cnt").alias("cnt"))
    heads = heads_of(summary).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("floor"), F.lit(0)).alias("floor")
    )
    parts = [
        F.lit("active items: "),
        rows.agg(F.count(F.lit(1)).alias("c")).scalar().cast("string"),
        F.lit("\ntotal weight: "),
        F.col("n").cast("string"),
        F.lit("\nmax error: "),
        F.col("floor").cast("string"),
    ]
    if epsilon is not None:
        value = epsilon if isinstance(epsilon, Column) else F.lit(epsilon)
        parts += [F.lit("\nepsilon: "), value.cast("string")]
    if items:
        top = rows.orderBy(F.desc("cnt"), "key").limit(items)
        line = F.concat_ws(" ", F.col("key").cast("string"), F.col("cnt").cast("string"))
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "key", line.alias("line"))))
        text = top.agg(ordered.alias("l")).select(F.array_join(F.col("l.line"), "\n").alias("t")).scalar()
        parts += [F.lit("\nitems:\n"), text]
    return heads.select(F.concat(*parts).alias("summary"))
