"""Linear and majority sketches: merging, order, accuracy and odd inputs."""

import statistics

import pytest
from pyspark.sql import functions as F

from keytally.functions.hashing import fold31
from keytally.functions.seeds import seed_table
from keytally.operators import exact, join_size, linear, majority
from keytally.sources.key_streams import key_stream, table

SEEDS = seed_table(rows=3, seed=1)


def rows(df, *order):
    return sorted(tuple(r[c] for c in (order or df.columns)) for r in df.collect())


def test_merge_is_build_of_union(make_stream):
    a, b = make_stream(list(range(50)) * 3), make_stream([(k, 2) for k in range(30, 90)])
    merged = linear.merge_cells(*(linear.count_min_build(x, SEEDS, 16) for x in (a, b)))
    whole = linear.count_min_build(a.unionByName(b), SEEDS, 16)
    assert rows(merged, "row", "bucket", "v") == rows(whole, "row", "bucket", "v")


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partitions_do_not_matter(spark, make_stream, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        stream = make_stream([k % 13 for k in range(500)], partitions=partitions)
        cells = rows(linear.linear_sketch(stream, SEEDS, 8, signed=True), "row", "bucket", "v")
        votes = rows(majority.majority_build(stream, SEEDS, 8))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plain = make_stream([k % 13 for k in range(500)], partitions=2)
    assert cells == rows(linear.linear_sketch(plain, SEEDS, 8, signed=True), "row", "bucket", "v")
    assert votes == rows(majority.majority_build(plain, SEEDS, 8))


def test_count_min_never_falls_short(spark, small):
    stream = key_stream(spark, small, "lineitem", "l_partkey")
    hist = exact.exact_histogram(stream)
    sketch = linear.count_min_build(stream, SEEDS, 32)
    got = linear.count_min_query(sketch, hist, SEEDS, 32)
    assert got.where("est < cnt").count() == 0
    assert got.count() == hist.count()


def test_every_run_answers_for_itself(make_stream):
    seeds = seed_table(rows=3, runs=4, seed=6)
    stream = make_stream([k for k in range(50) for _ in range(60)])
    hist = exact.exact_histogram(stream)
    got = linear.count_min_query(linear.count_min_build(stream, seeds, 64), hist, seeds, 64).collect()
    assert len(got) == 200 and {r.run for r in got} == {0, 1, 2, 3}
    assert all(r.est >= 60 for r in got)
    with pytest.raises(ValueError):
        linear.local_copies_query(stream, hist, seeds, 64, "key")


def test_depth_one(make_stream):
    seeds = seed_table(rows=1, seed=5)
    stream = make_stream([1, 1, 2])
    sketch = linear.count_min_build(stream, seeds, 1024)
    got = linear.count_min_query(sketch, stream.select("key").distinct(), seeds, 1024)
    assert rows(got, "key", "est") == [(1, 2), (2, 1)]


def test_preaggregate_gives_the_same(make_stream):
    stream = make_stream([(k % 5, k % 3) for k in range(100)])
    a = linear.linear_sketch(stream, SEEDS, 8, True)
    b = linear.linear_sketch(stream, SEEDS, 8, True, preaggregate=True)
    assert rows(a, "row", "bucket", "v") == rows(b, "row", "bucket", "v")


def test_big_keys(make_stream):
    keys = [2**31 - 1, 2**31, 2**32 - 1, 2**40 + 5, 2**62 - 1, -1, -(2**63)]
    stream = make_stream(keys)
    folded = [r[0] for r in stream.select(fold31("key")).collect()]
    assert all(0 <= x < 2**31 for x in folded)
    assert linear.linear_sketch(stream, SEEDS, 64, True).count() > 0


def test_empty(make_stream):
    empty = make_stream([])
    assert linear.count_min_build(empty, SEEDS, 8).count() == 0
    assert exact.exact_join_size(empty, empty).head()[0] == 0
    assert exact.stream_size(empty).head()[0] == 0
    cells = join_size.fast_agms_build(empty, SEEDS, 8)
    assert join_size.fast_agms_join_size(cells, cells, SEEDS).head()[0] == 0
    plain = linear.count_min_build(empty, SEEDS, 8)
    assert join_size.fast_count_join_size(plain, plain, SEEDS, 8).head()[0] == 0
    probes = make_stream([1, 2]).select("key")
    assert {r.est for r in linear.count_min_query(plain, probes, SEEDS, 8).collect()} == {0}


def test_estimators_are_accurate(spark):
    """Over 12 seed sets the mean estimate is near the truth: signs and buckets do not conspire."""
    folder = "/root/testdata/sf0.01"
    left = key_stream(spark, folder, "orders", "o_custkey")
    right = key_stream(spark, folder, "customer", "c_custkey")
    seeds = seed_table(rows=5, runs=12, seed=101)
    agms = seed_table(rows=3, cols=16, runs=12, seed=103)
    got = join_size.compare_join_estimators(left, right, seeds, agms, 128).collect()
    truth = got[0].truth
    assert truth == 15000
    for name, share in (("fast_agms", 0.08), ("fast_count", 0.15), ("agms", 0.5)):
        assert abs(statistics.mean(r[name] for r in got) - truth) < share * truth, name
    assert all(r.count_min >= truth for r in got)


def test_big_products(make_stream):
    stream = make_stream([(1, 2**62), (2, 2**61)])
    want = float(2**124 + 2**122)
    assert exact.exact_self_join_size(stream).head()[0] == want
    cells = linear.count_min_build(stream, seed_table(rows=2, seed=9), 4096)
    assert join_size.count_min_self_join_size(cells, seed_table(rows=2, seed=9)).head()[0] == want


def test_majority_floor(make_stream):
    """A strict majority key of a cell is its candidate, with at least its lead as score."""
    stream = make_stream([5] * 60 + list(range(100, 140)))
    cells = majority.majority_build(stream, SEEDS, 1).collect()
    assert {(r.cand, r.cnt, r.max_cnt, r.total) for r in cells} == {(5, 20, 60, 100)}


def test_majority_finds_heavy_key_in_parts(make_stream):
    stream = make_stream([(k % 50, 1) for k in range(500)] + [(7, 1)] * 400).withColumn(
        "part", F.col("key") % 1 + F.floor(F.rand(3) * 3)
    )
    local = majority.majority_build(stream, SEEDS, 64, by=("part",))
    top = majority.majority_top_k(majority.majority_merge(local), SEEDS, 64, 1, 100).collect()
    assert top[0].key == 7 and top[0].est <= 410


def test_running_estimates_match_batch(spark, small):
    stream = key_stream(spark, small, "events", "user_id", extra=("event_id",))
    a = linear.update_and_query(stream, SEEDS, 16, "event_id", chunk=7)
    b = linear.update_and_query(stream, SEEDS, 16, "event_id", chunk=10**6)
    assert rows(a, "event_id", "key", "est") == rows(b, "event_id", "key", "est")


def test_range_join_size(spark, make_stream):
    points = make_stream([3] * 10 + [0, 1, 5, 15])
    table = spark.createDataFrame([(0, 15), (3, 3), (4, 2), (5, 9)], "lo long, hi long")
    assert exact.range_join_size(points, table, 4).head()[0] == 14 + 10 + 0 + 1


def test_kth_smallest(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 9), (2, 1)], "g int, v long")
    assert rows(join_size.kth_smallest(df, "v", 2, ("g",))) == [(1, 5)]
    assert join_size.kth_smallest(df, "v", 4).head()[0] == 9
    assert join_size.kth_smallest(df, "v", 5).count() == 0


def test_hot_keys_are_cut_before_the_shuffle(spark, small):
    hist = exact.exact_histogram(
        key_stream(spark, small, "lineitem", "l_partkey", extra=("l_linenumber",)), ("l_linenumber",)
    )
    plan = linear.hot_keys(hist, "l_linenumber")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_the_key(spark, small):
    stream = key_stream(spark, small, "lineitem", "l_partkey")
    plan = linear.count_min_build(stream, SEEDS, 8)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    assert plan.count("Exchange") == 1
    assert table(spark, small, "lineitem").count() > 0


def test_estimates_of_parts_group_no_keys(spark):
    """Per part the least cell of a key, if all are there, with no table of keys in a task; null is a part."""
    stream = spark.createDataFrame(
        [(k, 1 + k % 3, (0, 1, None)[k % 3]) for k in range(90)], "key long, weight long, part long"
    )
    probes = spark.range(120).select(F.col("id").alias("key"))
    sketch = linear.count_min_build(stream, SEEDS, 16, by=("part",)).localCheckpoint()
    cells = {(r.part, r.row, r.bucket): r.v for r in sketch.collect()}
    want = set()
    own = linear.hash_rows(probes, SEEDS, 16).collect()
    for key in range(120):
        at = [(r.row, r.bucket) for r in own if r.key == key]
        for part in (0, 1, None):
            found = [cells.get((part, *a)) for a in at]
            if None not in found:
                want.add((part, key, min(found)))
    got = linear.estimates_per_part(sketch, probes, SEEDS, 16, "part")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
