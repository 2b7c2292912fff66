"""Samples of a stream, reproducible from row ids, and estimates scaled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytally.functions.hashing import row_hash
from keytally.functions.seeds import draw_seeds
from keytally.operators.exact import exact_join_size

HASH_RANGE = 1 << 31
WIDE_RANGE = 1 << 62
INDEX_BITS = 16


def uniform(row_id: Column | str, seed: int) -> Column:
    """A number in (0, 1) that depends on the row id alone."""
    return (row_hash(row_id, draw_seeds(5, seed)) + F.lit(0.5)) / F.lit(float(HASH_RANGE))


def wide_hash(row_id: Column | str, seeds: tuple) -> Column:
    """A 62-bit hash of a row id from ten seeds."""
    high = row_hash(row_id, seeds[:5]) * F.lit(HASH_RANGE)
    return high + row_hash(row_id, seeds[5:])


def bernoulli_cut(p: float) -> int:
    """Rows whose wide hash lies below it are kept. A p too small to keep any hash is refused."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    cut = round(p * WIDE_RANGE)
    if p > 0 and cut == 0:
        raise ValueError(f"p must be 0 or at least {1 / WIDE_RANGE}")
    return cut


def bernoulli_sample(df: DataFrame, p: float, row_id: str, seed: int = 1) -> DataFrame:
    """Each row with probability p; 0 keeps none, 1 keeps all."""
    return df.where(wide_hash(row_id, draw_seeds(10, seed)) < F.lit(bernoulli_cut(p)))


def bernoulli_samples(
    df: DataFrame, p: float, row_id: str, runs: int, seed: int = 1, name: str = "run"
) -> DataFrame:
    """``runs`` independent samples in one scan, told apart by column ``name``; sample r is the
    one ``bernoulli_sample`` draws with seed + r."""
    numbers = F.array(
        *[
            F.struct(
                F.lit(r).alias("run"),
                *[F.lit(v).cast("long").alias(f"s{i}") for i, v in enumerate(draw_seeds(10, seed + r))],
            )
            for r in range(runs)
        ]
    )
    each = df.select("*", F.explode(numbers).alias("_s"))
    hashed = wide_hash(row_id, tuple(F.col(f"_s.s{i}") for i in range(10)))
    return each.where(hashed < F.lit(bernoulli_cut(p))).select(
        *df.columns, F.col("_s.run").alias(name)
    )


def _hashed(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """The rows with their hash and their hash range, one of 2^INDEX_BITS."""
    return df.withColumn("_h", row_hash(row_id, draw_seeds(5, seed))).withColumn(
        "_range", F.shiftright("_h", 31 - INDEX_BITS)
    )


def _range_starts(hashed: DataFrame) -> DataFrame:
    """(_range, _start): how many rows the lower ranges hold."""
    sizes = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )


def row_index(df: DataFrame, row_id: str, seed: int = 1, name: str = "index") -> DataFrame:
    """A dense index 0..N-1 in the order of (hash of the id, id).

    Rows are spread over 2^INDEX_BITS hash ranges; only the ranges' sizes are summed across,
    and each range is numbered on its own.
    """
    hashed = _hashed(df, row_id, seed)
    starts = _range_starts(hashed)
    inside = Window.partitionBy("_range").orderBy("_h", row_id)
    numbered = hashed.withColumn("_at", F.row_number().over(inside))
    return numbered.join(starts, "_range").select(
        *df.columns, (F.col("_start") + F.col("_at") - 1).alias(name)
    )


def sample_without_replacement(df: DataFrame, n: int, row_id: str, seed: int = 1) -> DataFrame:
    """Exactly min(n, N) rows: the first n by hash. The sizes of the hash ranges tell which ranges are
    needed, and only their rows are numbered, so no task holds the sample whole and little more
    than it is shuffled."""
    hashed = _hashed(df, row_id, seed)
    last = _range_starts(hashed).where(F.col("_start") < n).agg(F.max("_range").alias("r")).scalar()
    needed = hashed.where(F.col("_range") <= last).select(df.columns)
    return row_index(needed, row_id, seed, "_index").where(F.col("_index") < n).drop("_index")


def draw_index(draw: Column, total: Column, seed: int) -> Column:
    """The row a draw picks: a 62-bit hash of the draw modulo the number of rows."""
    return wide_hash(draw, draw_seeds(10, seed)) % total


def sample_with_replacement(
    df: DataFrame, draws: DataFrame, seed: int = 1, row_id: str | None = None, index: str | None = None
) -> DataFrame:
    """One row per draw. ``draws`` has a column ``draw`` of distinct numbers; rows are found by
    the dense ``index`` column, or by one made from ``row_id``."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    if index is None:
        if row_id is None:
            raise ValueError("name a row id or a dense index column")
        df, index = row_index(df, row_id, seed, "_index"), "_index"
    picks = draws.select("draw", draw_index(F.col("draw"), total, seed).alias("_pick"))
    return picks.join(df, F.col("_pick") == F.col(index)).select(
        "draw", *[c for c in df.columns if c != "_index"]
    )


def scale_bernoulli(estimate: Column, p: float, q: float) -> Column:
    """From samples kept with probabilities p and q to the whole."""
    return F.lit(1.0 / p) * F.lit(1.0 / q) * estimate


def scale_sizes(
    estimate: Column, total: Column, size: Column | int, total2: Column, size2: Column | int
) -> Column:
    """From samples of given sizes, with or without replacement, to the whole."""
    return (total.cast("double") / size) * (total2.cast("double") / size2) * estimate


def sample_join_size_bernoulli(
    left: DataFrame, right: DataFrame, p: float, q: float, row_id: str, row_id2: str, seed: int = 1
) -> DataFrame:
    """Join size estimated from Bernoulli samples of two streams."""
    a = bernoulli_sample(left, p, row_id, seed)
    b = bernoulli_sample(right, q, row_id2, seed + 1)
    return exact_join_size(a, b).select(scale_bernoulli(F.col("join_size"), p, q).alias("estimate"))


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def sample_join_size_fixed(
    left: DataFrame, right: DataFrame, sample: DataFrame, sample2: DataFrame
) -> DataFrame:
    """Join size estimated from fixed-size samples of two streams, with or without replacement."""
    scaled = scale_sizes(
        F.col("join_size"), _count(left), _count(sample), _count(right), _count(sample2)
    )
    return exact_join_size(sample, sample2).select(scaled.alias("estimate"))
