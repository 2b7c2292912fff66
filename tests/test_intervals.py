"""Fast interval sums against summing number by number."""

import random

import pytest
from pyspark.sql import functions as F

from keytally.functions import hashing as h
from keytally.functions.seeds import draw_seeds, seed_table
from keytally.operators import exact, intervals

BITS = 7
TOP = (1 << BITS) - 1


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(0, 0), (0, TOP), (5, 4), (TOP, TOP), (0, 63), (64, 127), (1, 126)]
    for _ in range(120):
        lo = rng.randint(0, TOP)
        rows.append((lo, rng.randint(lo, TOP)))
    return spark.createDataFrame(rows, "lo long, hi long")


def as_dict(df):
    return {(r.lo, r.hi): r.total for r in df.collect()}


SEED_SETS = [(1, 0x6D), (0, 0x78), (1, 0x40), (0, 0), (1, 0x33), (0, 0x0C), (1, 0xFFFFFFFF), (0, 0x2B6A1C40)]


@pytest.mark.parametrize("i0,i1", SEED_SETS)
def test_bch3_and_eh3(table, i0, i1):
    for fast, xi in ((intervals.interval_sum_bch3, h.bch3), (intervals.interval_sum_eh3, h.eh3)):
        want = as_dict(intervals.interval_sum(table, lambda x: xi(i0, i1, x)))
        assert as_dict(fast(table, BITS, i0, i1)) == want
        assert want[(5, 4)] == 0


def test_prefix_path(spark, table):
    a, b = draw_seeds(2, 5)
    values = spark.range(TOP + 1).select(F.col("id").alias("key"), h.cw2(a, b, F.col("id")).alias("v"))
    want = as_dict(intervals.interval_sum(table, lambda x: h.cw2(a, b, x)))
    assert as_dict(intervals.interval_sum_by_prefix(table, values, BITS)) == want


def test_cover_is_exact(table):
    blocks = intervals.dyadic_cover(table.distinct(), BITS).collect()
    seen = {}
    for r in blocks:
        width = 1 << r.level
        seen.setdefault((r.lo, r.hi), []).extend(range(r.block * width, (r.block + 1) * width))
    for r in table.distinct().collect():
        assert sorted(seen.get((r.lo, r.hi), [])) == list(range(r.lo, r.hi + 1))
    assert max(len([1 for r in blocks if (r.lo, r.hi) == k]) for k in seen) <= 2 * BITS


def test_point_meets_interval_in_one_node(spark, table):
    points = spark.range(TOP + 1).select(F.col("id").alias("key"), F.lit(1).alias("weight"))
    nodes = intervals.dyadic_ancestors(points, BITS).select(
        F.col("key").alias("p"), intervals.node_id(BITS).alias("node")
    )
    cover = intervals.dyadic_cover(table.distinct(), BITS).select(
        "lo", "hi", intervals.node_id(BITS).alias("node")
    )
    hits = nodes.join(cover, "node").groupBy("lo", "hi").agg(
        F.count("p").alias("n"), F.count_distinct("p").alias("d"), F.min("p").alias("a"), F.max("p").alias("b")
    )
    for r in hits.collect():
        assert r.n == r.d == r.hi - r.lo + 1 and (r.a, r.b) == (r.lo, r.hi)


def test_sketch_is_near_the_truth(spark, table):
    points = spark.range(TOP + 1).select(
        F.col("id").alias("key"), (F.col("id") % 7).alias("weight")
    )
    truth = exact.range_join_size(points, table, BITS).head()[0]
    got = [
        intervals.interval_sketch_join_size(points, table, BITS, seed_table(5, seed=s), 256).head()[0]
        for s in range(4)
    ]
    assert abs(sum(got) / len(got) - truth) < 0.3 * truth


def test_rm7_is_a_quadratic_form(spark):
    """The column against the definition, bit by bit."""
    seeds = draw_seeds(32, 8, bits=32)
    column = F.array(*[F.lit(s).cast("long") for s in seeds])
    got = spark.range(300).select("id", h.rm7(1, column, F.col("id") * 7919).alias("v")).collect()
    for r in got:
        j, total = r.id * 7919, 1
        for i in range(32):
            if j >> i & 1:
                total += sum(seeds[i] >> k & j >> k & 1 for k in range(i, 32))
        assert r.v == (1 if total % 2 else -1)
