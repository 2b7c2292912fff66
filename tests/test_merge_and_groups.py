"""Merging by levels, counters of many groups, summaries as bytes, and what works by counts alone."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from keytally.functions.hashing import owner_by_hash
from keytally.functions.seeds import draw_seeds, seed_table
from keytally.operators import exact, frequent, intervals, join_size, linear
from keytally.operators import summaries as su
from keytally.sinks import summary_bytes
from keytally.sinks.sketch_store import stored

KINDS = ["space_saving", "frequent", "items"]


def skewed(n, seed=1, top=400):
    r = random.Random(seed)
    return [min(int(r.paretovariate(0.7)), top) for _ in range(n)]


def bounds_of(summary, kind, by=()):
    merge = su.merge_upper if kind == "space_saving" else su.merge_lower
    return merge(summary, by)


# --- merge tree


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("fan_in", [2, 7, 1000])
def test_tree_keeps_the_bounds(spark, make_stream, kind, fan_in):
    stream = make_stream(skewed(6000), partitions=23)
    m, truth = 40, Counter(skewed(6000))
    merged = su.merge_tree(su.local_summaries(stream, kind, m), kind, m, fan_in)
    rows = bounds_of(merged, kind).collect()
    assert 0 < len(rows) <= m and merged.select("shard").distinct().count() == 1
    assert all(r.lower <= truth[r.key] <= r.upper for r in rows)
    head = merged.where("key IS NULL").collect()
    assert len(head) == 1 and head[0].n == 6000
    # every level forgets at most a (m + 1)-th of what its counters hold; the median gives up twice that
    assert head[0].floor <= (2 if kind == "items" else 1) * 2 * 6000 / m
    missed = [k for k, c in truth.items() if c > head[0].floor and k not in {r.key for r in rows}]
    assert not missed


def test_a_thousand_summaries_meet_a_few_at_a_time(spark, monkeypatch):
    """The bounds hold, and no node gets more than fan_in summaries."""
    rows, truth, m, r = [], Counter(), 8, random.Random(3)
    for shard in range(1000):
        counts = Counter(min(int(r.paretovariate(0.6)), 50) for _ in range(20))
        top = counts.most_common(m)
        floor = counts.most_common(m + 1)[m][1] if len(counts) > m else 0
        truth += counts
        rows.append((shard * 3, None, 0, 0, floor, 20))
        rows += [(shard * 3, k, c, 0, floor, 0) for k, c in top]
    schema = "shard long, key long, cnt long, err long, floor long, n long"
    merged = su.merge_tree(spark.createDataFrame(rows, schema), "space_saving", 60, fan_in=10)
    got = frequent.bounds(merged).collect()
    assert all(x.lower <= truth[x.key] <= x.upper for x in got)
    assert merged.where("key IS NULL").first().n == 20_000
    sizes = Counter()
    count = 1 + 999 * 3
    while count > 1:
        nodes = Counter(s % -(-count // 10) for s in range(count))
        sizes[max(nodes.values())] += 1
        count = -(-count // 10)
    assert max(sizes) <= 10
    with pytest.raises(ValueError):
        su.merge_tree(merged, "space_saving", 5, fan_in=1)


def test_tree_of_nothing(spark, make_stream):
    empty = make_stream([]).where("false")
    merged = su.merge_tree(su.local_summaries(empty, "space_saving", 5), "space_saving", 5)
    assert merged.where("key IS NOT NULL").count() == 0
    texts = su.local_summaries(make_stream(["a", "b", "a", (None, 5)], "string"), "items", 5)
    got = frequent.item_rows(su.merge_tree(texts, "items", 5)).collect()
    assert {(r.key, r.lower) for r in got} == {("a", 2), ("b", 1)}


def test_a_task_that_runs_again_gives_the_same_owner(spark, make_stream):
    stream = make_stream(skewed(3000), partitions=9)
    owner = owner_by_hash("key", 2)
    runs = [
        sorted(map(tuple, frequent.space_saving_sharded(s, 15, 2, owner).collect()), key=repr)
        for s in (stream, stream.orderBy(F.rand(3)).repartition(9))
    ]
    assert runs[0] == runs[1]
    assert su.owners_for(stream) == 4 and su.owners_for(stream, 2) == 5


# --- many groups


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("block", [16, 1 << 18])
def test_grouped_counters_keep_the_bounds(kind, block):
    """Blocks of a few rows, so that groups are carried over; against exact counts."""
    r = random.Random(7)
    keys = skewed(4000, 5, 60)
    rows = [(r.choice(["a", "a", "b", "c", None]), k, 1 + k % 3) for k in keys]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    m, schema = 12, pa.schema(
        [("g", pa.string()), ("shard", pa.int64()), ("key", pa.int64())] + [(c, pa.int64()) for c in su.COUNTER_COLUMNS]
    )
    counters = su.GroupedCounters(kind, m, ["g"], schema)
    out = []
    for at in range(0, len(rows), block):
        part = rows[at : at + block]
        table = pa.table({"g": pa.array([x[0] for x in part], pa.string()), "key": [x[1] for x in part], "weight": [x[2] for x in part]})
        out += counters.add(table, (part[-1][0],))
    out += counters.finish()
    frame = pa.Table.from_batches(out).to_pylist()
    truth, sizes = Counter(), Counter()
    for g, k, w in rows:
        truth[g, k] += w
        sizes[g] += w
    heads = {x["g"]: x for x in frame if x["key"] is None}
    assert {g: x["n"] for g, x in heads.items()} == dict(sizes)
    assert len(heads) == sum(x["key"] is None for x in frame)
    for x in frame:
        if x["key"] is None:
            continue
        true, floor = truth[x["g"], x["key"]], heads[x["g"]]["floor"]
        if kind == "space_saving":
            assert x["cnt"] - x["err"] <= true <= x["cnt"]
        else:
            assert x["cnt"] <= true <= x["cnt"] + floor
    for g, head in heads.items():
        own = {x["key"] for x in frame if x["g"] == g and x["key"] is not None}
        assert len(own) <= m
        assert all(c <= head["floor"] for (h, k), c in truth.items() if h == g and k not in own)
        assert head["floor"] <= (2 if kind == "items" else 1) * sizes[g] / m


@pytest.mark.parametrize("kind", KINDS)
def test_groups_of_any_type(spark, kind):
    rows = [(1.5, None, 2**60 + 1, 3), (float("nan"), 2**60 + 3, 4, 1), (float("nan"), 2**60 + 3, 4, 2), (None, None, 4, 7)]
    rows += [(0.5, i, 9, 1) for i in range(300)]
    stream = spark.createDataFrame(rows, "a double, b long, key long, weight long").repartition(2)
    summary = frequent.frequent_elements_by_group(stream, ("a", "b"), 2, kind)
    heads = summary.where("key IS NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    want = stream.groupBy("a", "b").agg(F.sum("weight").alias("n"))
    assert heads.exceptAll(want).count() == 0 == want.exceptAll(heads).count()
    counted = summary.where("key IS NOT NULL").groupBy("a", "b", "key").agg(F.sum("cnt").alias("cnt"))
    exact_counts = stream.groupBy("a", "b", "key").agg(F.sum("weight").alias("cnt"))
    assert counted.exceptAll(exact_counts).count() == 0 == exact_counts.exceptAll(counted).count()


# --- bytes


def test_bytes_and_back(spark, make_stream):
    for keys, kind in ((["ä", "", "long" * 500] * 3, "string"), ([2**62, -5, 0, 0], "long")):
        stream = make_stream(keys, kind)
        summary = stored(su.local_summaries(stream, "space_saving", 2), "summary")
        key_type = StringType() if kind == "string" else LongType()
        again = summary_bytes.from_bytes(summary_bytes.to_bytes(summary), key_type)
        assert again.exceptAll(summary).count() == 0 == summary.exceptAll(again).count()
    empty = summary_bytes.to_bytes(summary.where("false"))
    assert summary_bytes.from_bytes(empty).count() == 0
    with pytest.raises(ValueError):
        summary_bytes.to_bytes(summary.withColumn("key", F.lit(1.5)))


def test_damaged_bytes_are_refused():
    cnt, err = np.array([3, 1]), np.array([0, 1])
    for keys in (pa.array([4, 9]), pa.array(["x", "yé"])):
        data = summary_bytes.pack(7, 4, 1, keys, cnt, err)
        assert summary_bytes.unpack(data)[:4] == (7, 4, 1, keys.to_pylist())
        for at in range(len(data)):
            with pytest.raises(ValueError):
                summary_bytes.unpack(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        for size in range(len(data)):
            with pytest.raises(ValueError):
                summary_bytes.unpack(data[:size])
        with pytest.raises(ValueError):
            summary_bytes.unpack(data + b"\0")

    def signed(body):
        return body + struct.pack("<I", zlib.crc32(body))

    good = summary_bytes.pack(7, 4, 1, pa.array([4, 9]), cnt, err)[:-4]
    head = summary_bytes.HEAD
    for fields in ((b"KTCS", 2, 0, 7, 4, 1, 2), (b"KTCS", 1, 3, 7, 4, 1, 2), (b"KTCS", 1, 0, 7, 0, 1, 2),
                   (b"KTCS", 1, 0, 7, 4, -1, 2), (b"KTCS", 1, 0, 7, 4, 1, 3), (b"KTCS", 1, 1, 7, 4, 1, 2),
                   (b"XXXX", 1, 0, 7, 4, 1, 2), (b"KTCS", 1, 0, 7, 4, 1, 1 << 40), (b"KTCS", 1, 1, 7, 4, 1, 1 << 40)):
        with pytest.raises(ValueError):
            summary_bytes.unpack(signed(head.pack(*fields) + good[head.size :]))
    with pytest.raises(ValueError):
        summary_bytes.unpack(None)


# --- by counts alone


def quadratic(seeds, i0, n):
    j, total = np.arange(n, dtype=np.uint64), np.full(n, i0, np.int64)
    for i in range(32):
        on = (j >> np.uint64(i)) & np.uint64(1)
        total += on.astype(np.int64) * np.bitwise_count(j & np.uint64(seeds[i] & ~((1 << i) - 1))).astype(np.int64)
    return (total & 1) * 2 - 1


@pytest.mark.parametrize("case", ["dense", "sparse", "none"])
def test_rm7_sums_by_blocks(spark, case):
    r, bits = random.Random(2), 16
    seeds = list(draw_seeds(32, 5, bits=32))
    if case != "dense":
        seeds = [s & r.getrandbits(32) & r.getrandbits(32) & r.getrandbits(32) if case == "sparse" else 0 for s in seeds]
    upto = np.concatenate([[0], np.cumsum(quadratic(seeds, 77, 1 << bits))])
    rows = [(r.randrange(1 << bits), r.randrange(1 << bits)) for _ in range(100)] + [(0, (1 << bits) - 1), (5, 5)]
    got = intervals.interval_sum_rm7(spark.createDataFrame(rows, "lo long, hi long"), bits, 77, seeds).collect()
    assert len(got) == len(set(rows))
    assert all(x.total == (upto[x.hi + 1] - upto[x.lo] if x.hi >= x.lo else 0) for x in got)


def test_rm7_of_wide_intervals_adds_up(spark):
    """Widths of 2^29: two halves make the whole."""
    seeds, half, full = list(draw_seeds(32, 9, bits=32)), (1 << 29) - 1, (1 << 30) - 1
    rows = [(0, half), (half + 1, full), (0, full), (123, half + 77), (half + 78, full), (0, 122)]
    table = spark.createDataFrame(rows, "lo long, hi long")
    got = {(x.lo, x.hi): x.total for x in intervals.interval_sum_rm7(table, 30, 1, seeds).collect()}
    assert got[0, half] + got[half + 1, full] == got[0, full]
    assert got[0, 122] + got[123, half + 77] + got[half + 78, full] == got[0, full]


def test_running_estimates_over_several_levels(spark):
    seeds = seed_table(rows=2, seed=3)
    r = random.Random(4)
    rows = [(r.randrange(5), r.randrange(4), i * 3) for i in range(500)]
    stream = spark.createDataFrame(rows, "key long, weight long, at long").repartition(3)
    results = [
        sorted(map(tuple, linear.update_and_query(stream, seeds, 8, "at", chunk=c).collect()))
        for c in (2, 5, 10**6)
    ]
    assert results[0] == results[1] == results[2]
    assert linear.update_and_query(stream.where("false"), seeds, 8, "at").count() == 0


@pytest.mark.parametrize("kind", ["long", "double", "int", "decimal(20,0)", "float"])
def test_kth_smallest_of_any_k(spark, kind, monkeypatch):
    monkeypatch.setattr(join_size, "PARTS", 4)
    r = random.Random(8)
    whole = kind in ("long", "int", "decimal(20,0)")
    wide = [2**62, -(2**62), 2**63 - 1, -(2**63)] if kind in ("long",) else [1e30, -1e30, 1e-300] if kind == "double" else [3, -3]
    values = [r.randrange(-50, 50) if whole else r.gauss(0, 5) for _ in range(300)] + wide + [7] * 40
    values = values if whole else [float(v) for v in values]
    rows = [(r.choice(["a", "b", None]), v) for v in values] + [("c", 1 if whole else 1.5), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v " + ("double" if not whole else "long"))
    df = df.withColumn("v", F.col("v").cast(kind)).repartition(3)
    if not whole:
        df = df.union(spark.createDataFrame([("a", float("nan")), ("b", float("inf"))], "g string, v double"))
        df = df.withColumn("v", F.col("v").cast(kind))
    known = {}
    for row in df.where("v IS NOT NULL").collect():
        if whole or abs(row.v) < float("inf"):
            known.setdefault(row.g, []).append(row.v)
    for k in (1, 50, 90, 10**6):
        got = {x.g: x.estimate for x in join_size.kth_smallest(df, "v", k, ("g",)).collect()}
        assert got == {g: sorted(v)[k - 1] for g, v in known.items() if len(v) >= k}
    every = sorted(sum(known.values(), []))
    k = len(every) // 2
    assert join_size.kth_smallest(df, "v", k).first()[0] == every[k - 1]
    assert join_size.kth_smallest(df, "v", k).schema["estimate"].dataType == df.schema["v"].dataType
    with pytest.raises(ValueError):
        join_size.kth_smallest(df, "v", 0)


def test_agms_cells_are_signed_sums(spark, make_stream):
    """Against the sign columns, key by key; weights of any sign and size."""
    from keytally.functions.hashing import cw4, fold31

    seeds = seed_table(rows=2, cols=3, runs=2, seed=6)
    rows = [(k % 90, w) for k, w in enumerate([1, -2, 2**40, 5, 0] * 60)] + [(2**60 + 5, 3)]
    stream = make_stream(rows, partitions=4)
    cells = join_size.agms_build(stream, seeds)
    want = {}
    counts = exact.exact_histogram(stream)
    for run, row, col, a, b, c, d, *_ in seeds.rows:
        sign = cw4(a, b, c, d, fold31("key"))
        want[run, row, col] = counts.agg(F.sum(sign * F.col("cnt"))).first()[0]
    assert {(x.run, x.row, x.col): x.v for x in cells.collect()} == want
    assert join_size.agms_build(stream.where("false"), seeds).count() == 0
    texts = make_stream(["a", "b", "a"], "string")
    assert join_size.agms_build(texts, seeds).count() == len(want)
