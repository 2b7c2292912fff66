"""Sums of random variables over intervals, and sketches of interval tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.functions.hashing import bch3, eh3
from keytally.functions.seeds import SeedTable
from keytally.operators.exact import exact_histogram, prefix_sums
from keytally.operators.join_size import fast_agms_build, fast_agms_join_size

MAX_BITS = 30


def _distinct(intervals: DataFrame) -> DataFrame:
    return intervals.select("lo", "hi").distinct()


def interval_sum(intervals: DataFrame, xi: Callable[[Column], Column]) -> DataFrame:
    """(lo, hi, total): xi summed over every number of each distinct interval; 0 where hi < lo.
    For intervals of bounded width."""
    numbers = F.when(F.col("hi") >= F.col("lo"), F.sequence("lo", "hi"))
    rows = _distinct(intervals).select("lo", "hi", F.explode_outer(numbers).alias("_k"))
    return rows.groupBy("lo", "hi").agg(F.coalesce(F.sum(xi(F.col("_k"))), F.lit(0)).alias("total"))


def touched_values(intervals: DataFrame, xi: Callable[[Column], Column]) -> DataFrame:
    """(key, v) for the numbers that lie in an interval, and with v = 0 for those just before one:
    all that ``interval_sum_by_prefix`` looks at. Each number's value is worked out once."""
    numbers = F.when(F.col("hi") >= F.col("lo"), F.sequence(F.col("lo") - 1, F.col("hi")))
    rows = _distinct(intervals).select("lo", F.explode(numbers).alias("key"))
    inside = rows.groupBy("key").agg(F.max(F.col("key") >= F.col("lo")).alias("_in"))
    value = F.when(F.col("_in"), xi(F.col("key"))).otherwise(F.lit(0))
    return inside.where("key >= 0").select("key", value.cast("long").alias("v"))


def interval_sum_by_prefix(intervals: DataFrame, values: DataFrame, bits: int) -> DataFrame:
    """The same from the variable's values (key, v) over the domain [0, 2^bits), or over those that
    the intervals touch: two lookups of a running total per interval, however wide."""
    running = prefix_sums(values, bits).select("key", "prefix")
    ends = _distinct(intervals).withColumn("_before", F.col("lo") - 1)
    high = running.select(F.col("key").alias("hi"), F.col("prefix").alias("_high"))
    low = running.select(F.col("key").alias("_before"), F.col("prefix").alias("_low"))
    total = F.when(
        F.col("hi") >= F.col("lo"), F.col("_high") - F.coalesce("_low", F.lit(0))
    ).otherwise(0)
    return ends.join(high, "hi", "left").join(low, "_before", "left").select(
        "lo", "hi", total.alias("total")
    )


def dyadic_cover(intervals: DataFrame, bits: int) -> DataFrame:
    """Each interval within [0, 2^bits) as at most 2 * bits disjoint dyadic blocks: columns
    ``level`` and ``block``, the block being [block * 2^level, (block + 1) * 2^level)."""
    _check(bits)
    level = F.col("level")
    first = F.call_function("shiftright", F.col("lo") + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
    end = F.call_function("shiftright", F.col("hi") + 1, level)
    odd_first = F.when((first < end) & (first.bitwiseAND(1) == 1), first)
    odd_end = F.when((first < end) & (end.bitwiseAND(1) == 1), end - 1)
    return (
        intervals.where(F.col("hi") >= F.col("lo"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level"))
        .select("*", F.explode(F.array_compact(F.array(odd_first, odd_end))).alias("block"))
    )


def dyadic_ancestors(points: DataFrame, bits: int) -> DataFrame:
    """Each point of [0, 2^bits) with its bits + 1 enclosing blocks."""
    _check(bits)
    level = F.col("level")
    return points.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level")).select(
        "*", F.call_function("shiftright", F.col("key"), level).alias("block")
    )


def _check(bits: int) -> None:
    if not 0 < bits <= MAX_BITS:
        raise ValueError(f"bits must lie in 1..{MAX_BITS}")


def node_id(bits: int) -> Column:
    """One number per (level, block): ``level`` leading ones, then the block's own bits."""
    top = F.lit(1 << (bits + 1)).cast("long")
    shift = F.lit(bits + 1) - F.col("level")
    return top - F.call_function("shiftleft", F.lit(1).cast("long"), shift) + F.col("block")


def _sum_of_blocks(intervals: DataFrame, bits: int, value: Column) -> DataFrame:
    asked = _distinct(intervals)
    sums = dyadic_cover(asked, bits).groupBy("lo", "hi").agg(F.sum(value).alias("total"))
    return asked.join(sums, ["lo", "hi"], "left").select(
        "lo", "hi", F.coalesce("total", F.lit(0)).alias("total")
    )


def _block_start() -> Column:
    return F.call_function("shiftleft", F.col("block"), F.col("level"))


def _ones(level: Column) -> Column:
    """A mask of the low ``level`` bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1


def interval_sum_bch3(intervals: DataFrame, bits: int, i0: int, i1: int) -> DataFrame:
    """interval_sum of bch3 without visiting the numbers: over a dyadic block the variable is
    constant if no seed bit lies inside the block, and cancels out otherwise."""
    level = F.col("level")
    free = F.lit(i1).cast("long").bitwiseAND(_ones(level)) == 0
    width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    value = F.when(free, bch3(i0, i1, _block_start()) * width).otherwise(F.lit(0).cast("long"))
    return _sum_of_blocks(intervals, bits, value)


# Fixed value: the even bits, each the lower bit of a pair.
EVEN_BITS = 0x55555555


def interval_sum_eh3(intervals: DataFrame, bits: int, i0: int, i1: int) -> DataFrame:
    """interval_sum of eh3 from its dyadic blocks. Over the four values of a pair of bits the
    signs add up to 2, or to -2 where both seed bits of the pair are set; a block of odd level
    has half a pair more, worth 2 or 0."""
    level, block = F.col("level"), F.col("block")
    seed = F.lit(i1).cast("long")
    pairs = (level / 2).cast("int")
    both = seed.bitwiseAND(F.shiftright(seed, 1)).bitwiseAND(EVEN_BITS)
    twos = F.bit_count(both.bitwiseAND(_ones(pairs * 2))).cast("long")
    full = F.call_function("shiftleft", F.lit(1).cast("long"), pairs) * (1 - 2 * (twos % 2))
    half_seed = F.call_function("shiftright", seed, level - 1).bitwiseAND(1)
    half = F.when((half_seed + block) % 2 == 0, F.lit(2)).otherwise(F.lit(0)).cast("long")
    value = eh3(i0, i1, _block_start()) * full * F.when(level % 2 == 1, half).otherwise(F.lit(1))
    return _sum_of_blocks(intervals, bits, value)


@dataclass(frozen=True)
class _FreeForm:
    """The quadratic form of a block's free bits in a basis that takes it apart.

    ``pairs`` are (e, q(e), f, q(f)): two vectors that meet each other only; ``lone`` are (r, q(r)): vectors that meet
    none. Vectors are masks of bits, q is the form without its linear terms.
    """

    pairs: list[tuple[int, int, int, int]]
    lone: list[tuple[int, int]]


def _parity(bits: int) -> int:
    return bits.bit_count() & 1


def _free_form(seeds: list[int], level: int) -> _FreeForm:
    """The form over the ``level`` lowest bits, by the symplectic Gram-Schmidt process over GF(2)."""

    def q(v: int) -> int:
        on = [i for i in range(level) if v >> i & 1]
        return _parity(sum(_parity(seeds[i] & v & -(1 << (i + 1))) << n for n, i in enumerate(on)))

    def meet(u: int, v: int) -> int:
        return q(u ^ v) ^ q(u) ^ q(v)

    left, pairs, lone = [1 << i for i in range(level)], [], []
    while left:
        e = left.pop()
        at = next((n for n, v in enumerate(left) if meet(e, v)), None)
        if at is None:
            lone.append((e, q(e)))
            continue
        f = left.pop(at)
        # what meets one of the two is moved by the other until it meets neither
        left = [v ^ (e if meet(v, f) else 0) ^ (f if meet(v, e) else 0) for v in left]
        pairs.append((e, q(e), f, q(f)))
    return _FreeForm(pairs, lone)


def interval_sum_rm7(intervals: DataFrame, bits: int, i0: int, seeds: list[int]) -> DataFrame:
    """interval_sum of rm7 from its dyadic blocks, at a cost by bits and not by width.

    Within a block the high bits are fixed, so the form is the quadratic part of the free bits, the same for all blocks
    of a level, plus linear terms. In the basis of ``_free_form`` the sum over the block is a product:
    2 or -2 per pair (-2 where both vectors have an odd value) and 2 per lone vector, or 0 if one of these has an
    odd value.
    """
    forms = [_free_form(seeds, level) for level in range(bits + 1)]

    def structs(rows: list[tuple[int, ...]], names: tuple[str, ...]) -> str:
        kind = "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>"
        body = ", ".join(
            "named_struct(" + ", ".join(f"'{n}', {v}L" for n, v in zip(names, row)) + ")" for row in rows
        )
        return f"cast(array({body}) AS {kind})"

    pair_names, lone_names = ("e", "qe", "f", "qf"), ("r", "qr")
    pairs = "array(" + ", ".join(structs(f.pairs, pair_names) for f in forms) + ")"
    lone = "array(" + ", ".join(structs(f.lone, lone_names) for f in forms) + ")"
    table = F.expr("array(" + ", ".join(f"{v}L" for v in seeds) + ")")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def shifted(x: Column, by: Column) -> Column:
        return F.call_function("shiftleft", x, by)

    def odd(x: Column) -> Column:
        return F.bit_count(x).cast("long").bitwiseAND(1)

    high, level = F.col("high"), F.col("level")
    # bit i of the linear terms: the seed's own bit i and its products with the fixed bits
    linear = F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        zero,
        lambda total, i: total.bitwiseOR(
            F.when(i < level, shifted(odd(F.element_at(table, i + 1).bitwiseAND(high.bitwiseOR(shifted(one, i)))), i)).otherwise(zero)
        ),
    )
    fixed = F.aggregate(
        F.sequence(F.lit(0), F.lit(bits)),
        F.lit(i0).cast("long"),
        lambda total, i: total
        + F.call_function("shiftright", high, i).bitwiseAND(1)
        * odd(F.element_at(table, i + 1).bitwiseAND(high).bitwiseAND(-shifted(one, i))),
    )
    blocks = dyadic_cover(_distinct(intervals), bits).select(
        "lo", "hi", "level", _block_start().alias("high")
    )
    parts = blocks.select(
        "lo", "hi", "level", linear.alias("linear"), fixed.alias("fixed"),
        F.element_at(F.expr(pairs), level + 1).alias("pairs"),
        F.element_at(F.expr(lone), level + 1).alias("lone"),
    )
    terms = F.col("linear")
    minus = F.aggregate(
        "pairs",
        F.col("fixed"),
        lambda total, p: total
        + (odd(terms.bitwiseAND(p.e)) + p.qe).bitwiseAND(1)
        * (odd(terms.bitwiseAND(p.f)) + p.qf).bitwiseAND(1),
    )
    cancels = F.exists("lone", lambda r: (odd(terms.bitwiseAND(r.r)) + r.qr).bitwiseAND(1) == 1)
    size = shifted(one, F.size("pairs") + F.size("lone"))
    # an odd form is +1
    value = F.when(cancels, zero).otherwise(size * (minus.bitwiseAND(1) * 2 - 1))
    sums = parts.groupBy("lo", "hi").agg(F.sum(value).alias("total"))
    return _distinct(intervals).join(sums, ["lo", "hi"], "left").select(
        "lo", "hi", F.coalesce("total", F.lit(0)).alias("total")
    )


def dyadic_interval_sum(
    intervals: DataFrame, bits: int, xi: Callable[[Column], Column]
) -> DataFrame:
    """(lo, hi, total): xi summed over the node ids of each interval's cover."""
    return _sum_of_blocks(intervals, bits, xi(node_id(bits)))


def dyadic_point_value(points: DataFrame, bits: int, xi: Callable[[Column], Column]) -> DataFrame:
    """(key, total): xi summed over the node ids of each distinct point's enclosing blocks."""
    nodes = dyadic_ancestors(points.select("key").distinct(), bits)
    return nodes.groupBy("key").agg(F.sum(xi(node_id(bits))).alias("total"))


def point_nodes(points: DataFrame, bits: int) -> DataFrame:
    """A stream of points as a stream of node ids; points are counted first."""
    counts = exact_histogram(points).withColumnRenamed("cnt", "weight")
    return dyadic_ancestors(counts, bits).select(node_id(bits).alias("key"), "weight")


def interval_nodes(intervals: DataFrame, bits: int) -> DataFrame:
    """A table of intervals as a stream of node ids; equal intervals are counted first."""
    counts = intervals.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("weight"))
    return dyadic_cover(counts, bits).select(node_id(bits).alias("key"), "weight")


def interval_sketch_join_size(
    points: DataFrame, intervals: DataFrame, bits: int, seeds: SeedTable, buckets: int
) -> DataFrame:
    """Estimated number of (point, interval) matches: a point and an interval share exactly one
    node where they match, and none otherwise."""
    left = fast_agms_build(point_nodes(points, bits), seeds, buckets)
    right = fast_agms_build(interval_nodes(intervals, bits), seeds, buckets)
    return fast_agms_join_size(left, right, seeds)
