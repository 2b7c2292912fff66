"""Skewed frequency tables and the streams they stand for.

A domain is a DataFrame with a dense ``id`` column 0..dom-1 (``spark.range(dom)``, or the keys
of a table); ``dom`` and ``mass`` are numbers or one-value columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.functions.hashing import row_hash
from keytally.functions.seeds import draw_seeds
from keytally.operators.exact import prefix_sums
from keytally.operators.sampling import HASH_RANGE, row_index, uniform

CHUNK = 1_000_000
#: Rows of a shuffled stream that a task sorts in memory, and the chunks they are dealt out in.
SORTED_ROWS = 1 << 21
SORTED_CHUNK = SORTED_ROWS >> 4


def _num(value: Column | float | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("double")


def _freq(domain: DataFrame, cnt: Column, key: Column | None = None) -> DataFrame:
    key = F.col("id") if key is None else key
    return domain.select(key.cast("long").alias("key"), cnt.cast("long").alias("cnt"))


def freq_uniform(domain: DataFrame, dom, mass) -> DataFrame:
    """mass spread evenly; at least one per key."""
    return _freq(domain, F.rint(F.greatest(_num(dom), _num(mass)) / _num(dom)))


def freq_uniform_limited(domain: DataFrame, dom, mass, cutoff: float) -> DataFrame:
    """Uniform on the first ``cutoff`` share of the keys, 0 beyond."""
    part = F.rint(_num(dom) * F.lit(cutoff))
    each = F.rint(F.greatest(part, _num(mass)) / part)
    return _freq(domain, F.when(F.col("id") < part, each).otherwise(0.0))


def harmonic(domain: DataFrame, z: float) -> Column:
    """Generalised harmonic number of the domain, as a one-value subquery."""
    return domain.agg(F.sum(1 / F.pow(F.col("id") + 1, F.lit(z))).alias("h")).scalar()


def freq_zipf(domain: DataFrame, dom, mass, z: float) -> DataFrame:
    """f(i) = rint(mass / ((i + 1)^z * H)); z = 0 is uniform."""
    if z == 0:
        return freq_uniform(domain, dom, mass)
    return _freq(domain, F.rint(_num(mass) / (F.pow(F.col("id") + 1, F.lit(z)) * harmonic(domain, z))))


def freq_zipf_shifted(domain: DataFrame, dom, mass, z: float, shift: float) -> DataFrame:
    """Zipf with the keys moved right by ``shift``, around the end."""
    moved = (F.col("key") + F.lit(int(round(shift)))) % _num(dom).cast("long")
    return freq_zipf(domain, dom, mass, z).select(moved.alias("key"), "cnt")


def freq_zipf_reversed(domain: DataFrame, dom, mass, z: float) -> DataFrame:
    """Zipf with the largest key the most frequent."""
    rank = _num(dom) - F.col("id")
    return _freq(domain, F.rint(_num(mass) / (F.pow(rank, F.lit(z)) * harmonic(domain, z))))


def permutation(keys: DataFrame, share: float = 1.0, seed: int = 1) -> DataFrame:
    """(key, new_key): a random share of the keys permuted among themselves, the rest omitted.

    The chosen keys are numbered twice, in two hash orders, and equal numbers are paired.
    """
    bar = F.lit(round(share * HASH_RANGE))
    chosen = keys.select("key").where(row_hash("key", draw_seeds(5, seed)) < bar)
    there = row_index(chosen, "key", seed + 1)
    back = row_index(chosen, "key", seed + 2).withColumnRenamed("key", "new_key")
    return there.join(back, "index").select("key", "new_key")


def _rename_keys(freq: DataFrame, moves: DataFrame) -> DataFrame:
    moved = freq.join(moves, "key", "left")
    return moved.withColumn("key", F.coalesce("new_key", "key")).drop("new_key")


def shuffle_frequencies(freq: DataFrame, seed: int = 1) -> DataFrame:
    """The counts dealt out to the keys at random."""
    return _rename_keys(freq, permutation(freq, 1.0, seed))


def shuffle_frequencies_paired(f: DataFrame, g: DataFrame, seed: int = 1) -> DataFrame:
    """(key, cnt, cnt2): one permutation applied to two tables over the same keys."""
    both = f.join(g.withColumnRenamed("cnt", "cnt2"), "key")
    return _rename_keys(both, permutation(f, 1.0, seed))


def decorrelate(freq: DataFrame, dom, p: float, seed: int = 1) -> DataFrame:
    """p = 1 leaves the table as it is, 0 shuffles it, a negative p reverses it first; in
    between, a share 1 - |p| of the keys is permuted."""
    if not -1 <= p <= 1:
        raise ValueError("p must lie in [-1, 1]")
    if p < 0:
        freq = freq.withColumn("key", _num(dom).cast("long") - 1 - F.col("key"))
    return freq if abs(p) == 1 else _rename_keys(freq, permutation(freq, 1 - abs(p), seed))


def expand(freq: DataFrame, chunk: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """cnt copies of every row but for the cnt column. Large counts are cut into chunks that are
    dealt out to all tasks (to so many, where given), so a key with a third of the stream is not one task's work."""
    rest = [c for c in freq.columns if c != "cnt"]
    last = F.floor((F.col("cnt") - 1) / F.lit(chunk))
    chunks = (
        freq.where(F.col("cnt") > 0)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_chunk"))
        .withColumn("_size", F.least(F.lit(chunk), F.col("cnt") - F.col("_chunk") * chunk))
        .repartition(*([] if tasks is None else [tasks]), *rest, "_chunk")
    )
    return chunks.select(*rest, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size"))).alias("_")).drop("_")


GENERATORS = ("zipf", "zipf_reversed", "uniform", "uniform_limited", "zipf_shifted")


def generate_relation(
    domain: DataFrame, dom, mass, kind: str, param: float = 1.0, p: float = 1.0, seed: int = 1
) -> DataFrame:
    """A stream (key, weight) from one of GENERATORS, decorrelated by p. For zipf_shifted,
    which is not decorrelated, p is the shift."""
    if kind == "zipf":
        freq = freq_zipf(domain, dom, mass, param)
    elif kind == "zipf_reversed":
        freq = freq_zipf_reversed(domain, dom, mass, param)
    elif kind == "uniform":
        freq = freq_uniform(domain, dom, mass)
    elif kind == "uniform_limited":
        freq = freq_uniform_limited(domain, dom, mass, param)
    elif kind == "zipf_shifted":
        freq, p = freq_zipf_shifted(domain, dom, mass, param, p), 1.0
    else:
        raise ValueError(f"kind must be one of {GENERATORS}")
    rows = expand(decorrelate(freq, dom, p, seed))
    return rows.withColumn("weight", F.lit(1).cast("long"))


# The grid of data sets.
GRID_SIZES = (1_000_000, 10_000_000, 100_000_000)
GRID_SKEWS = tuple(0.5 + 0.25 * i for i in range(11))


def grid_frequencies(domain: DataFrame, sizes: DataFrame, skews: tuple[float, ...] = GRID_SKEWS) -> DataFrame:
    """(skew, n, key, cnt): a Zipf table per skew and per row of ``sizes`` (column ``n``).

    All tables come from one pass: per skew one weight per key, per size one multiple of it.
    ``sizes`` is a short list of parameters, taken in as one array.
    """
    wanted = sizes.agg(F.collect_set("n").alias("n")).scalar()
    literal = F.array(*[F.lit(float(z)) for z in skews])
    weights = domain.select("id", F.explode(literal).alias("skew")).withColumn(
        "w", 1 / F.pow(F.col("id") + 1, F.col("skew"))
    )
    norms = weights.groupBy("skew").agg(F.sum("w").alias("h"))
    both = weights.join(norms, "skew").select(
        "*", F.explode(wanted).alias("n")
    )
    cnt = F.rint(F.col("n") / (F.pow(F.col("id") + 1, F.col("skew")) * F.col("h")))
    return both.select("skew", "n", F.col("id").alias("key"), cnt.cast("long").alias("cnt"))


def shuffled_stream(freq: DataFrame, seed: int = 1) -> DataFrame:
    """The expanded stream with a random ``order`` column; sort by it to store it shuffled.

    It is dealt to tasks by the rows they will hold, not by the short table they come from, so that each can sort
    its own without spilling.
    """
    total = freq.agg(F.sum("cnt").alias("n")).first().n or 0
    rows = expand(freq, SORTED_CHUNK, 1 + total // SORTED_ROWS)
    return rows.withColumn("order", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))


#: Tries of the rejection method per row. A try fails with a probability well below one half, the
#: same for any n, so that none of so many succeeds for less than one row in 10^12. Such a row takes the
#: number of one more try as it is.
ZIPF_TRIES = 40


def zipf_draws(rows: DataFrame, row_id: str, n, theta: float, seed: int = 1) -> DataFrame:
    """A Zipf variate in 1..n per row by rejection-inversion (Hoermann and Derflinger, 1996).

    A point below the hat, the inverse of the integral of x^-theta at a uniform height, is
    rounded; it is taken if it lies under the step of that number. Needs no sum over the domain.
    """
    power = 1.0 - theta

    def area(x: Column) -> Column:
        return F.log(x) if power == 0 else (F.pow(x, F.lit(power)) - 1) / F.lit(power)

    def edge(y: Column) -> Column:
        return F.exp(y) if power == 0 else F.pow(1 + F.lit(power) * y, F.lit(1 / power))

    def step(k: Column) -> Column:
        return F.pow(k, F.lit(-theta))

    size = F.col("_size")
    low, high = area(F.lit(1.5)) - 1, area(size + 0.5)
    near = 2 - edge(area(F.lit(2.5)) - step(F.lit(2.0)))

    def point(numbers: tuple) -> tuple[Column, Column, Column]:
        u = (row_hash(row_id, numbers) + F.lit(0.5)) / F.lit(float(HASH_RANGE))
        height = high + u * (low - high)
        x = edge(height)
        return F.least(F.greatest(F.floor(x + 0.5).cast("double"), F.lit(1.0)), size), x, height

    def attempt(taken: Column, seeds: Column) -> Column:
        k, x, height = point(tuple(seeds[f"s{i}"] for i in range(5)))
        under = (k - x <= near) | (height >= area(k + 0.5) - step(k))
        return F.when(taken.isNotNull(), taken).when(under, k)

    tries = F.array(
        *[
            F.struct(
                *[F.lit(v).cast("long").alias(f"s{i}") for i, v in enumerate(draw_seeds(5, seed + t))]
            )
            for t in range(ZIPF_TRIES)
        ]
    )
    rest = point(tuple(F.lit(v).cast("long") for v in draw_seeds(5, seed + ZIPF_TRIES)))[0]
    drawn = F.coalesce(F.aggregate(tries, F.lit(None).cast("double"), attempt), rest)
    sized = rows.withColumn("_size", _num(n).cast("double"))
    return sized.select(*rows.columns, drawn.cast("long").alias("draw"))


def zipf_draws_by_table(rows: DataFrame, row_id: str, domain: DataFrame, s: float, seed: int = 1) -> DataFrame:
    """A Zipf variate per row by looking the uniform number up in the distribution's steps.

    The draw is one more than the number of steps below the uniform number. Uniform numbers lie on
    a grid of odd multiples of 2^-32, so steps are counted per grid cell, and a running total over
    the cells answers all draws.
    """
    cells = F.lit(float(1 << 32))
    weights = domain.select(F.col("id").alias("key"), (1 / F.pow(F.col("id") + 1, F.lit(s))).alias("v"))
    steps = prefix_sums(weights, 40).select(
        F.floor(F.col("prefix") / harmonic(domain, s) * cells).alias("key"),
        F.lit(1).cast("long").alias("v"),
    )
    drawn = rows.withColumn("_cell", 2 * row_hash(row_id, draw_seeds(5, seed)))
    asked = drawn.select(F.col("_cell").alias("key"), F.lit(0).cast("long").alias("v"))
    axis = steps.unionByName(asked).groupBy("key").agg(F.sum("v").alias("v"))
    below = prefix_sums(axis, 33).select(F.col("key").alias("_cell"), "prefix")
    return drawn.join(below, "_cell").select(*rows.columns, (F.col("prefix") + 1).alias("draw"))


def stable_draws(rows: DataFrame, row_id: str, alpha: float, seed: int = 1) -> DataFrame:
    """A symmetric alpha-stable variate per row, 0 < alpha <= 2 (Chambers, Mallows and Stuck, 1976).

    One expression for all alpha: the tangent for 1 (Cauchy) and a normal variate of variance 2 for 2
    are its values there.
    """
    if not 0 < alpha <= 2:
        raise ValueError("alpha must lie in (0, 2]")
    angle = F.lit(math.pi) * (uniform(row_id, seed) - 0.5)
    waiting = -F.log(uniform(row_id, seed + 1))
    rest = 1 - alpha
    value = (
        F.sin(F.lit(alpha) * angle)
        * F.pow(F.cos(angle), F.lit(-1 / alpha))
        * F.pow(F.cos(F.lit(rest) * angle) / waiting, F.lit(rest / alpha))
    )
    return rows.select(*rows.columns, value.alias("draw"))
