"""How good and how fast: estimates against exact counts, and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quality(truth: DataFrame, result: DataFrame) -> DataFrame:
    """One row of metrics from (key, cnt) truths and (key, est) results with distinct keys."""
    both = truth.select("key", "cnt").join(result.select("key", "est"), "key", "full")
    is_true, is_found = F.col("cnt").isNotNull(), F.col("est").isNotNull()
    hit = is_true & is_found
    error = F.abs(F.col("est") - F.col("cnt")) / F.col("cnt")
    counts = both.agg(
        F.count_if(is_found).alias("reported"),
        F.count_if(is_true).alias("truth"),
        F.count_if(hit).alias("hits"),
        F.avg(F.when(hit, error)).alias("mean_error"),
    )
    reported, true, hits = F.col("reported"), F.col("truth"), F.col("hits")
    return counts.select(
        "reported",
        "truth",
        "hits",
        F.when(reported == 0, 1.0).otherwise(hits / reported).alias("precision"),
        F.when(true == 0, 1.0).otherwise(hits / true).alias("recall"),
        F.when(reported == 0, 0.0).otherwise(F.col("mean_error")).alias("are"),
    )


def precision_recall_are(hist: DataFrame, result: DataFrame, phi: float) -> DataFrame:
    """reported, truth, hits, precision, recall, are; the truth is cnt >= phi * N.

    Precision is 1 and the error 0 where nothing is reported, recall is 1 where nothing is
    frequent; the error is null where no reported key is frequent.
    """
    total = hist.agg(F.sum("cnt").alias("n")).scalar()
    return _quality(hist.where(F.col("cnt") >= F.lit(phi) * total), result)


def duplicate_check(result: DataFrame) -> DataFrame:
    """Keys reported more than once."""
    return result.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)


def point_errors(hist: DataFrame, result: DataFrame) -> DataFrame:
    """Per reported key that exists, its errors, most frequent key first."""
    rows = result.select("key", "est").join(hist, "key")
    return rows.select(
        "key",
        "cnt",
        F.abs(F.col("cnt") - F.col("est")).alias("absolute_error"),
        F.abs(1 - F.col("est") / F.col("cnt")).alias("relative_error"),
    ).orderBy(F.desc("cnt"), "key")


def rank_table_quality(ranks: DataFrame, total: Column | int, phi: float) -> DataFrame:
    """The same metrics from a saved rank table; the truth starts at ceil(N * phi)."""
    bar = F.ceil((total if isinstance(total, Column) else F.lit(total)) * F.lit(phi))
    truth = ranks.where(F.col("true_cnt") >= bar)
    found = ranks.where(F.col("est_key").isNotNull())
    return _quality(
        truth.select(F.col("true_key").alias("key"), F.col("true_cnt").alias("cnt")),
        found.select(F.col("est_key").alias("key"), F.col("est_cnt").alias("est")),
    )


def zeta(domain: DataFrame, a: float) -> Column:
    """sum of 1 / i^a over a dense domain of ids from 0, as a one-value subquery."""
    return domain.agg(F.sum(1 / F.pow(F.col("id") + 1, F.lit(a))).alias("z")).scalar()


def error_bounds(
    ranks: DataFrame, total: Column, zeta_a: Column, a: float, delay: int, shards: int
) -> DataFrame:
    """What delayed increments may hide at rank r (from 1): relative to N, and per key of a
    Zipf stream. ``delay`` increments may be waiting in each of ``shards`` shards."""
    hidden = F.lit(float(delay * shards))
    return ranks.select(
        "rank",
        (hidden / total).alias("relative_bound"),
        (hidden / (zeta_a * F.pow(F.col("rank"), F.lit(a)))).alias("absolute_bound"),
    )


def run_summary(runs: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Mean and population standard deviation per configuration."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )


def speedup(
    summary: DataFrame, algorithm: str, baseline: str, config: tuple[str, ...], value: str = "mean"
) -> DataFrame:
    """Each algorithm's value over the baseline's in the same configuration."""
    base = summary.where(F.col(algorithm) == baseline).select(
        *config, F.col(value).alias("_base")
    )
    return summary.join(base, [*config], "left").select(
        *summary.columns, F.try_divide(F.col(value), F.col("_base")).alias("speedup")
    )


def operation_totals(workers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals over the workers of a run: from columns ``operations`` and ``queries``."""
    return (
        workers.groupBy(*by)
        .agg(F.sum("operations").alias("operations"), F.sum("queries").alias("queries"))
        .select(
            *by,
            "operations",
            "queries",
            (F.col("operations") - F.col("queries")).alias("inserts"),
            F.try_divide(F.col("queries") * 100, F.col("operations")).alias("query_percent"),
        )
    )


def throughput(workers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Millions of inserts, queries and operations per second of a run; a run lasts as long as
    its slowest worker (``ms``)."""
    def rate(count: Column) -> Column:
        return F.try_divide(count, F.col("_ms")) / 1000

    return (
        workers.groupBy(*by)
        .agg(
            F.sum("operations").alias("_ops"),
            F.sum("queries").alias("_queries"),
            F.max("ms").alias("_ms"),
        )
        .select(
            *by,
            rate(F.col("_ops") - F.col("_queries")).alias("m_inserts"),
            rate(F.col("_queries")).alias("m_queries"),
            rate(F.col("_ops")).alias("m_operations"),
        )
    )


def mean_latency(queries: DataFrame, worker: str, latency: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean over the workers of each worker's mean latency."""
    means = queries.groupBy(*by, worker).agg(F.avg(latency).alias("_mean"))
    return means.groupBy(*by).agg(F.avg("_mean").alias("latency"))
