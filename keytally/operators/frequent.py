"""Frequent elements from counter summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.operators.summaries import (
    counters_of,
    cut_to,
    cut_value,
    delta_rows,
    heads_of,
    local_summaries,
    merge_lower,
    merge_tree,
    merge_upper,
    sharded_summaries,
    total_of,
)

# --- Space-Saving ----------------------------------------------------------------------


def space_saving(stream: DataFrame, m: int, tasks: int | None = None) -> DataFrame:
    """One summary of m counters per input partition (of at most ``tasks``)."""
    return local_summaries(stream, "space_saving", m, tasks=tasks)


def space_saving_sharded(stream: DataFrame, m: int, shards: int, owner: Column) -> DataFrame:
    """One summary of m counters per owner; see ``sharded_summaries``."""
    return sharded_summaries(stream, "space_saving", m, shards, owner)


def bounds(summary: DataFrame) -> DataFrame:
    """(shard, key, est, lower, upper) of every counter of unmerged Space-Saving summaries."""
    return counters_of(summary).select(
        "shard",
        "key",
        F.col("cnt").alias("est"),
        (F.col("cnt") - F.col("err")).alias("lower"),
        F.col("cnt").alias("upper"),
    )


def at_least(estimates: DataFrame, threshold: Column | float | int) -> DataFrame:
    """The estimates that reach the threshold, largest first."""
    return estimates.where(F.col("est") >= threshold).orderBy(F.desc("est"), "key")


def frequent_elements_global(summary: DataFrame, phi: float) -> DataFrame:
    """Over all owners, the keys whose estimate reaches phi * N, N from the same summaries."""
    return at_least(bounds(summary), F.lit(phi) * total_of(summary, "n"))


def frequent_elements_merged(summary: DataFrame, phi: float) -> DataFrame:
    """The same for partition summaries with common keys."""
    return at_least(merge_upper(summary), F.lit(phi) * total_of(summary, "n"))


def space_saving_merge(summary: DataFrame, m: int, fan_in: int = 16) -> DataFrame:
    """(key, est, lower, upper): one summary of m counters, merged level by level; see ``merge_tree``."""
    return bounds(merge_tree(summary, "space_saving", m, fan_in)).drop("shard")


def include_pending(
    result: DataFrame, pending: DataFrame, untracked: Column | int = 0
) -> DataFrame:
    """Adds what is still on its way to all keys that are tracked or have something on its way.

    ``untracked`` is the most that a key may have had before without being in ``result``: the largest
    floor of the summaries. Increments are summed per key before they meet the result.
    """
    waiting = pending.groupBy("key").agg(F.sum("weight").alias("_waiting"))
    missed = untracked if isinstance(untracked, Column) else F.lit(untracked)
    return result.join(waiting.where("_waiting > 0"), "key", "full").withColumn(
        "est", F.coalesce(F.col("est"), missed) + F.coalesce("_waiting", F.lit(0))
    ).drop("_waiting")


def pending_weight(pending: DataFrame) -> DataFrame:
    """Total weight in flight."""
    return pending.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("pending"))


def point_estimate(summary: DataFrame, probes: DataFrame, owner: Column) -> DataFrame:
    """(key, est, error) of each probe from a sharded summary: 0 where the key is untracked,
    and the most the answer may be off."""
    tracked = counters_of(summary).select(
        F.col("shard").alias("owner"), "key", F.col("cnt").alias("_cnt"), F.col("err").alias("_err")
    )
    floors = heads_of(summary).select(F.col("shard").alias("owner"), F.col("floor").alias("_floor"))
    asked = probes.withColumn("owner", owner)
    return (
        asked.join(tracked, ["owner", "key"], "left")
        .join(floors, "owner", "left")
        .select(
            *probes.columns,
            F.coalesce("_cnt", F.lit(0)).alias("est"),
            F.coalesce("_err", "_floor", F.lit(0)).alias("error"),
        )
    )


def summary_weight_check(summary: DataFrame) -> DataFrame:
    """Per shard, the sum of the counters and the weight seen; equal for Space-Saving."""
    return summary.groupBy("shard").agg(
        F.sum("cnt").alias("counters"), F.sum("n").alias("n")
    )


# --- weighted Frequent with increments sent on -------------------------------------------


def weighted_frequent(stream: DataFrame, m: int, tasks: int | None = None) -> DataFrame:
    """One summary of under-counting counters per input partition (of at most ``tasks``)."""
    return local_summaries(stream, "frequent", m, tasks=tasks)


def delta_emission(
    stream: DataFrame, m: int, beta: float, flush: bool = True, tasks: int | None = None
) -> DataFrame:
    """The increments each partition sends on; see ``delta_rows``."""
    return delta_rows(stream, m, beta, flush, tasks)


def delta_merge(deltas: DataFrame, m: int) -> DataFrame:
    """(key, est): a second-level summary of m counters over the increments of all partitions."""
    sums = deltas.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("delta").alias("cnt"))
    return cut_to(sums, m).select("key", F.col("cnt").alias("est"))


def frequent_elements_lower(deltas: DataFrame, m: int, phi: float, eps: float) -> DataFrame:
    """Keys whose under-count reaches N * (phi - eps): none with phi * N or more is missed
    as long as the two summaries and the unsent share lose at most eps * N together."""
    threshold = total_of(deltas, "n") * F.lit(phi - eps)
    return at_least(delta_merge(deltas, m), threshold)


# --- frequent items with error bounds ----------------------------------------------------

EPSILON_FACTOR = 3.5
LOAD_FACTOR = 0.75


def item_capacity(lg_size: int) -> int:
    """Counters of a sketch of 2^lg_size slots."""
    return int(LOAD_FACTOR * 2**lg_size)


def frequent_items_sketch(stream: DataFrame, lg_size: int, tasks: int | None = None) -> DataFrame:
    """One median-purged summary per input partition (of at most ``tasks``)."""
    return local_summaries(stream, "items", item_capacity(lg_size), tasks=tasks)


def frequent_items_merge(sketch: DataFrame, lg_size: int, fan_in: int = 16) -> DataFrame:
    """Partition sketches, of any sizes, as one sketch of 2^lg_size slots, merged level by level: counters and
    offsets add up, then the counters are lowered until they fit."""
    return merge_tree(sketch, "items", item_capacity(lg_size), fan_in)


def item_rows(sketch: DataFrame) -> DataFrame:
    """(key, est, lower, upper) of every tracked item."""
    return merge_lower(sketch).select("key", F.col("upper").alias("est"), "lower", "upper")


def item_bounds(sketch: DataFrame, probes: DataFrame) -> DataFrame:
    """The probes with est (0 where untracked), lower, upper and max_error."""
    offset = total_of(sketch, "floor")
    zero = F.lit(0)
    return probes.join(item_rows(sketch), "key", "left").select(
        *probes.columns,
        F.coalesce("est", zero).alias("est"),
        F.coalesce("lower", zero).alias("lower"),
        F.coalesce("upper", offset).alias("upper"),
        offset.alias("max_error"),
    )


NO_FALSE_NEGATIVES = "no_false_negatives"
NO_FALSE_POSITIVES = "no_false_positives"


def frequent_items(
    sketch: DataFrame, error_type: str, threshold: Column | float | int | None = None
) -> DataFrame:
    """Items above the threshold (default: the maximum error), largest first: every item that
    may be, or only those that must be."""
    sides = {NO_FALSE_NEGATIVES: "upper", NO_FALSE_POSITIVES: "lower"}
    if error_type not in sides:
        raise ValueError(f"error_type must be one of {sorted(sides)}")
    if threshold is None:
        threshold = total_of(sketch, "floor")
    rows = item_rows(sketch)
    return rows.where(F.col(sides[error_type]) > threshold).orderBy(F.desc("est"), "key")


def sketch_statistics(sketch: DataFrame, lg_size: int) -> DataFrame:
    """One row: is_empty, active_items, total_weight, max_error, epsilon, apriori_error."""
    epsilon = EPSILON_FACTOR / 2**lg_size
    heads = heads_of(sketch).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_weight"),
        F.coalesce(F.sum("floor"), F.lit(0)).alias("max_error"),
    )
    active = counters_of(sketch).agg(F.count_distinct("key").alias("n")).scalar()
    return heads.withColumn("active_items", active).select(
        (F.col("active_items") == 0).alias("is_empty"),
        "active_items",
        "total_weight",
        "max_error",
        F.lit(epsilon).alias("epsilon"),
        (F.lit(epsilon) * F.col("total_weight")).alias("apriori_error"),
    )


def approx_top_k(stream: DataFrame, k: int, max_tracked: int = 10_000) -> DataFrame:
    """The k heaviest keys by Spark's own sketch; each row counts once."""
    packed = stream.select(F.expr(f"approx_top_k(key, {int(k)}, {int(max_tracked)})").alias("t"))
    return packed.select(F.explode("t").alias("t")).select(
        F.col("t.item").alias("key"), F.col("t.count").alias("est")
    )


def approx_top_k_states(stream: DataFrame, by: tuple[str, ...], max_tracked: int = 10_000) -> DataFrame:
    """One storable state of Spark's own sketch per group."""
    return stream.groupBy(*by).agg(
        F.expr(f"approx_top_k_accumulate(key, {int(max_tracked)})").alias("state")
    )


def approx_top_k_combined(states: DataFrame, k: int, max_tracked: int = 10_000) -> DataFrame:
    """The k heaviest keys over all states."""
    merged = states.agg(F.expr(f"approx_top_k_combine(state, {int(max_tracked)})").alias("state"))
    rows = merged.select(F.explode(F.expr(f"approx_top_k_estimate(state, {int(k)})")).alias("t"))
    return rows.select(F.col("t.item").alias("key"), F.col("t.count").alias("est"))


# --- per group ---------------------------------------------------------------------------


def frequent_elements_by_group(
    stream: DataFrame,
    by: tuple[str, ...],
    m: int,
    kind: str = "space_saving",
    tasks: int | None = None,
) -> DataFrame:
    """Summaries per group and partition; a hot group is summed up where its rows lie."""
    return local_summaries(stream, kind, m, by, tasks)


def frequent_by_group(
    summary: DataFrame, by: tuple[str, ...], phi: float, kind: str = "space_saving"
) -> DataFrame:
    """Per group, the keys whose upper bound reaches phi times the group's weight."""
    merge = merge_upper if kind == "space_saving" else merge_lower
    sizes = heads_of(summary).groupBy(*by).agg(F.sum("n").alias("n"))
    rows = merge(summary, by).join(sizes, [*by])
    return rows.where(F.col("upper") >= F.lit(phi) * F.col("n")).drop("n")
