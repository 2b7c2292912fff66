"""Exact counts: the ground truth of every estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_histogram(stream: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Total weight per key. Partial sums are formed before the shuffle."""
    return stream.groupBy(*by, "key").agg(F.sum("weight").alias("cnt"))


def sorted_histogram(stream: DataFrame) -> DataFrame:
    """The histogram, heaviest key first."""
    return exact_histogram(stream).orderBy(F.desc("cnt"), "key")


def stream_size(stream: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Total weight N, overall or per substream."""
    return stream.groupBy(*by).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"))


def size_of(stream: DataFrame) -> Column:
    """N as a one-value subquery; nothing is joined or collected."""
    return stream_size(stream).scalar()


def exact_frequent_elements(stream: DataFrame, phi: float) -> DataFrame:
    """Keys with cnt >= phi * N. N is summed from the same histogram, so its shuffle is reused."""
    hist = exact_histogram(stream)
    total = hist.agg(F.sum("cnt").alias("n")).scalar()
    return hist.where(F.col("cnt") >= F.lit(phi) * total)


def heavy_hitter_count(stream: DataFrame, phi: float) -> DataFrame:
    """How many keys have cnt >= phi * N."""
    return exact_frequent_elements(stream, phi).agg(F.count(F.lit(1)).alias("heavy_keys"))


def exact_top_k(stream: DataFrame, k: int) -> DataFrame:
    """The k heaviest keys, ties by key."""
    return sorted_histogram(stream).limit(k)


def _product(a: str, b: str) -> Column:
    """A product of two counts that may pass the BIGINT range."""
    wide = "decimal(19,0)"
    return F.col(a).cast(wide) * F.col(b).cast(wide)


def _total_product(a: str, b: str) -> Column:
    """An exact sum of products, given out as a double."""
    return F.coalesce(F.sum(_product(a, b)).cast("double"), F.lit(0.0))


def exact_join_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """sum f(x) * g(x). Both sides are counted per key first, so no hot key is joined raw."""
    f = exact_histogram(left)
    g = exact_histogram(right).withColumnRenamed("cnt", "cnt2")
    return f.join(g, "key").agg(_total_product("cnt", "cnt2").alias("join_size"))


def exact_self_join_size(stream: DataFrame) -> DataFrame:
    """sum f(x)^2."""
    return exact_histogram(stream).agg(_total_product("cnt", "cnt").alias("join_size"))


def _in_blocks(values: DataFrame, bits: int) -> DataFrame:
    """(key, v) rows with their block of 2^(bits/2) keys and the running total inside it."""
    if not 0 < bits <= 40:
        raise ValueError("bits must lie in 1..40")
    blocks = values.withColumn("_block", F.shiftright(F.col("key"), bits // 2))
    inside = Window.partitionBy("_block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_inside", F.sum("v").over(inside))


def _before_block(total: str) -> Column:
    """The sum of the lower blocks' totals, over one row per block."""
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(before), F.lit(0))


def prefix_sums(values: DataFrame, bits: int) -> DataFrame:
    """Running totals of (key, v) over the key order, as column ``prefix``.

    Keys are unique and lie in [0, 2^bits). They are cut into blocks of 2^(bits/2): one window
    runs inside each block and one over the block totals, so no window sees more than
    2^(bits/2 + 1) rows, however large the table behind them.
    """
    running = _in_blocks(values, bits)
    totals = (
        values.select(F.shiftright(F.col("key"), bits // 2).alias("_block"), "v")
        .groupBy("_block")
        .agg(F.sum("v").alias("_total"))
    )
    offsets = totals.select("_block", _before_block("_total").alias("_offset"))
    return running.join(offsets, "_block").select(
        *values.columns, (F.col("_offset") + F.col("_inside")).alias("prefix")
    )


def range_join_size(points: DataFrame, intervals: DataFrame, bits: int) -> DataFrame:
    """The number of (point, interval) matches, for points and ends in [0, 2^bits).

    Counted as sum over interval ends of S(hi) - S(lo - 1), with S the running point count.
    Ends and points are counted per value before they meet, so neither a hot point nor a
    popular interval is ever paired up. S is cut into blocks as in ``prefix_sums``; a block is
    summed up where it lies, and only one row per block goes on.
    """
    valid = intervals.where(F.col("hi") >= F.col("lo"))
    ends = valid.select(
        F.explode(
            F.array(
                F.struct(F.col("hi").alias("key"), F.lit(1).cast("long").alias("times")),
                F.struct((F.col("lo") - 1).alias("key"), F.lit(-1).cast("long").alias("times")),
            )
        ).alias("e")
    ).select("e.key", F.lit(0).cast("long").alias("v"), "e.times").where(F.col("key") >= 0)
    counts = points.select("key", F.col("weight").alias("v"), F.lit(0).cast("long").alias("times"))
    axis = counts.unionByName(ends).groupBy("key").agg(
        F.sum("v").alias("v"), F.sum("times").alias("times")
    )
    blocks = _in_blocks(axis, bits).groupBy("_block").agg(
        F.sum("v").alias("_total"),
        F.sum("times").alias("_times"),
        F.sum(_product("times", "_inside")).alias("_matches"),
    )
    matches = F.col("_matches") + _product("_times", "_before")
    return blocks.select("*", _before_block("_total").alias("_before")).agg(
        F.coalesce(F.sum(matches).cast("double"), F.lit(0.0)).alias("matches")
    )
