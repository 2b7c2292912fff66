"""Join-size and second-moment estimates from linear sketches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from keytally.functions.hashing import MASK31, key_code
from keytally.functions.seeds import SeedTable
from keytally.operators.exact import _product, exact_histogram, exact_join_size
from keytally.operators.linear import _ids, count_min_build, linear_sketch
from keytally.sinks.sketch_store import discard, stored


# --- combiners -------------------------------------------------------------------------


def average(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("estimate"))


def median(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The middle value; of an even number, the mean of the middle two."""
    return df.groupBy(*by).agg(F.median(value).alias("estimate"))


def minimum(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("estimate"))


PARTS = 1024


def _part_of(value: Column, low: Column, high: Column, whole: bool) -> Column:
    """The number of the part, of ``PARTS`` equal ones of [low, high], that a value falls into."""
    if whole:
        wide = lambda c: c.cast("decimal(38,0)")
        size = F.call_function("div", wide(high) - wide(low), F.lit(PARTS).cast("decimal(38,0)")) + 1
        return F.call_function("div", wide(value) - wide(low), size.cast("decimal(38,0)")).cast("long")
    # halved, so that no difference of two doubles is infinite
    share = (value / 2 - low / 2) / F.greatest(high / 2 - low / 2, F.lit(5e-324))
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1))


def _same(by: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])


def kth_smallest(df: DataFrame, value: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k-th smallest value per group, for any k, without sorting the values.

    Each pass counts the values between the bounds found so far in ``PARTS`` equal parts, and narrows the bounds to the
    part that has the k-th one, as far as its own least and largest value; when these are equal, they are the
    answer. A pass shuffles at most ``PARTS`` counts per task and group. Values are numbers; nulls and NaN do not
    count, and a group of fewer than k gives no row.
    """
    if k < 1:
        raise ValueError("k counts from 1")
    kind = df.schema[value].dataType
    whole = isinstance(kind, IntegralType) or (isinstance(kind, DecimalType) and kind.scale == 0)
    number = F.col(value) if whole else F.col(value).cast("double")
    rows = df.select(*by, number.alias("_v")).where(F.col("_v").isNotNull())
    if not whole:
        rows = rows.where(~F.isnan("_v") & (F.abs("_v") < F.lit(float("inf"))))
    groups = [*by, "_all"]
    rows = rows.withColumn("_all", F.lit(0))
    state = rows.groupBy(*groups).agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    state = stored(
        state.where(F.col("_n") >= k).select(*groups, "_low", "_high", F.lit(k).cast("long").alias("_k")), "kth"
    )
    while not state.where("_low < _high").isEmpty():
        open_groups = state.where("_low < _high")
        met = rows.alias("a").join(open_groups.alias("b"), _same(tuple(groups)))
        inside = met.where("a._v BETWEEN b._low AND b._high").select(
            "a.*", "b._k", _part_of(F.col("_v"), F.col("_low"), F.col("_high"), whole).alias("_part")
        )
        counts = inside.groupBy(*groups, "_k", "_part").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        order = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("_upto", F.sum("_n").over(order))
        less = F.col("_upto") - F.col("_n")
        narrowed = upto.where((less < F.col("_k")) & (F.col("_k") <= F.col("_upto"))).select(
            *groups, "_low", "_high", (F.col("_k") - less).alias("_k")
        )
        before, state = state, stored(state.where("_low = _high").unionByName(narrowed), "kth")
        discard(before)
    return state.select(*by, F.col("_low").cast(kind).alias("estimate"))


# --- sketches --------------------------------------------------------------------------


def _hash31(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``hash31`` of numbers below 2^31, seeds down and codes across."""
    r = a * x + b
    return ((r >> 31) + r) & MASK31


def agms_build(stream: DataFrame, seeds: SeedTable, code: Column | None = None) -> DataFrame:
    """One counter per (row, col): the sum of signed weights.

    Every counter sees every key. A task sums the weights per key a block at a time, works out the signs of all
    counters for a block of keys at once and adds them up; it sends on one row per counter, whatever the stream holds.
    """
    ids = (*_ids(seeds), "col")
    at = [seeds.columns.index(c) for c in ids]
    signs = [seeds.columns.index(c) for c in ("sa", "sb", "sc", "sd")]
    unique = list(dict.fromkeys(tuple(r[i] for i in (*at, *signs)) for r in seeds.rows))
    names = np.array([r[: len(ids)] for r in unique], np.int64)
    a, b, c, d = (np.array([r[len(ids) + i] for r in unique], np.int64)[:, None] for i in range(4))
    schema = ", ".join(f"{c} int" for c in ids) + ", v long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = [0] * len(unique), False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            sums = pa.Table.from_batches([batch]).group_by("x").aggregate([("weight", "sum")])
            codes, weights = sums["x"].to_numpy(), sums["weight_sum"].to_numpy()
            # a block's sum must not pass 64 bits; larger weights go in two halves
            high, low = weights >> 31, weights & MASK31
            for start in range(0, len(codes), 4096):
                x = codes[start : start + 4096]
                # the polynomial of ``fourwise``, all counters at once
                h = _hash31(_hash31(_hash31(a, b, x), c, x), d, x)
                sign = (h & 1) * 2 - 1
                part = slice(start, start + 4096)
                upper, lower = sign @ high[part], sign @ low[part]
                for i, (u, w) in enumerate(zip(upper.tolist(), lower.tolist())):
                    totals[i] += (u << 31) + w
        if seen:
            columns = [pa.array(names[:, i], pa.int32()) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64())], names=[*ids, "v"])

    coded = stream.select(key_code(stream, code).alias("x"), F.col("weight").cast("long").alias("weight"))
    known = coded.where("x IS NOT NULL AND weight IS NOT NULL")
    return known.mapInArrow(add, schema).groupBy(*ids).agg(F.sum("v").alias("v"))


def fast_agms_build(
    stream: DataFrame, seeds: SeedTable, buckets: int, by: tuple[str, ...] = (), **options
) -> DataFrame:
    """One signed counter per (row, bucket)."""
    return linear_sketch(stream, seeds, buckets, True, by, **options)


fast_count_build = count_min_build


def _row_frame(like: DataFrame, seeds: SeedTable) -> DataFrame:
    return seeds.frame(like.sparkSession).select(*_ids(seeds)).distinct()


def _groups(seeds: SeedTable) -> tuple[str, ...]:
    return _ids(seeds)[:-1]


def _row_products(left: DataFrame, right: DataFrame, seeds: SeedTable) -> DataFrame:
    """Per sketch row, the sum of products of equal cells; 0 where no cells meet."""
    ids = [c for c in left.columns if c != "v"]
    dot = (
        left.join(right.withColumnRenamed("v", "v2"), ids)
        .groupBy(*_ids(seeds))
        .agg(F.sum(_product("v", "v2")).alias("dot"))
    )
    return _row_frame(left, seeds).join(dot, [*_ids(seeds)], "left").select(
        *_ids(seeds), F.coalesce("dot", F.lit(0).cast("decimal(38,0)")).alias("dot")
    )


def _dots(left: DataFrame, right: DataFrame, seeds: SeedTable) -> DataFrame:
    return _row_products(left, right, seeds).withColumn("dot", F.col("dot").cast("double"))


def agms_join_size(left: DataFrame, right: DataFrame, seeds: SeedTable) -> DataFrame:
    """Average over the columns, median over the rows."""
    width = len({r[2] for r in seeds.rows})
    rows = _dots(left, right, seeds).withColumn("dot", F.col("dot") / F.lit(width))
    return median(rows, "dot", _groups(seeds))


def agms_self_join_size(sketch: DataFrame, seeds: SeedTable) -> DataFrame:
    return agms_join_size(sketch, sketch, seeds)


def fast_agms_join_size(left: DataFrame, right: DataFrame, seeds: SeedTable) -> DataFrame:
    """Median over the rows of the rows' dot products."""
    return median(_dots(left, right, seeds), "dot", _groups(seeds))


def fast_agms_self_join_size(sketch: DataFrame, seeds: SeedTable) -> DataFrame:
    return fast_agms_join_size(sketch, sketch, seeds)


def fast_count_join_size(
    left: DataFrame, right: DataFrame, seeds: SeedTable, buckets: int
) -> DataFrame:
    """Average over the rows of (B * dot - L1 * L1') / (B - 1).

    The numerators are summed exactly and divided once, so the order of rows cannot matter.
    """
    ids = [*_ids(seeds)]
    first = left.groupBy(*ids).agg(F.sum("v").alias("l1"))
    second = right.groupBy(*ids).agg(F.sum("v").alias("l2"))
    zero = F.lit(0)
    rows = (
        _row_products(left, right, seeds)
        .join(first, ids, "left")
        .join(second, ids, "left")
        .withColumn("l1", F.coalesce("l1", zero))
        .withColumn("l2", F.coalesce("l2", zero))
        .withColumn("value", F.col("dot") * F.lit(buckets) - _product("l1", "l2"))
    )
    mean = F.sum("value").cast("double") / (F.count(F.lit(1)) * (buckets - 1)).cast("double")
    return rows.groupBy(*_groups(seeds)).agg(mean.alias("estimate"))


def fast_count_self_join_size(sketch: DataFrame, seeds: SeedTable, buckets: int) -> DataFrame:
    return fast_count_join_size(sketch, sketch, seeds, buckets)


def count_min_join_size(left: DataFrame, right: DataFrame, seeds: SeedTable) -> DataFrame:
    """Least dot product over the rows: an upper bound."""
    return minimum(_dots(left, right, seeds), "dot", _groups(seeds))


def count_min_self_join_size(sketch: DataFrame, seeds: SeedTable) -> DataFrame:
    return count_min_join_size(sketch, sketch, seeds)


def compare_join_estimators(
    left: DataFrame, right: DataFrame, seeds: SeedTable, agms_seeds: SeedTable, buckets: int
) -> DataFrame:
    """(run, truth, agms, fast_agms, fast_count, count_min), every run in one plan.

    Both tables hold the same number of runs. The streams are counted per key once.
    """
    f, g = (exact_histogram(s).withColumnRenamed("cnt", "weight") for s in (left, right))
    signed = [fast_agms_build(s, seeds, buckets) for s in (f, g)]
    plain = [count_min_build(s, seeds, buckets) for s in (f, g)]
    agms = [agms_build(s, agms_seeds) for s in (f, g)]
    if "run" not in signed[0].columns:
        raise ValueError("comparing estimators needs at least two runs")
    estimates = {
        "agms": agms_join_size(*agms, agms_seeds),
        "fast_agms": fast_agms_join_size(*signed, seeds),
        "fast_count": fast_count_join_size(*plain, seeds, buckets),
        "count_min": count_min_join_size(*plain, seeds),
    }
    table = reduce(
        lambda a, b: a.join(b, "run"),
        [df.withColumnRenamed("estimate", name) for name, df in estimates.items()],
    )
    truth = exact_join_size(left, right).scalar()
    return table.select("run", truth.alias("truth"), *estimates)
