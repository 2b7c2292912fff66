"""Samples, generators, text streams, logs and the sketch store."""

import pytest
from pyspark.sql import functions as F

from keytally.functions import sizes
from keytally.functions.hashing import row_hash
from keytally.functions.seeds import draw_seeds, seed_table
from keytally.operators import exact, frequent, linear, quality, sampling
from keytally.session import work_path
from keytally.sinks import reports
from keytally.sinks.sketch_store import load_sketch, save_sketch, stored
from keytally.sources import run_logs, synthetic
from keytally.sources.key_streams import as_stream, key_stream, table
from keytally.sources.text_streams import read_key_stream_text, write_key_stream_text


def test_bernoulli(spark):
    df = spark.range(20000)
    assert sampling.bernoulli_sample(df, 0, "id").count() == 0
    assert sampling.bernoulli_sample(df, 1, "id").count() == 20000
    assert abs(sampling.bernoulli_sample(df, 0.3, "id").count() - 6000) < 300
    # Ids that agree in their low 31 bits are sampled on their own.
    wide = spark.range(4000).select((F.col("id") * F.lit(2**31)).alias("id"))
    assert abs(sampling.bernoulli_sample(wide, 0.5, "id").count() - 2000) < 200
    with pytest.raises(ValueError):
        sampling.bernoulli_sample(df, 1.5, "id")
    many = sampling.bernoulli_samples(df, 0.3, "id", 3, seed=4)
    for r in range(3):
        one = sampling.bernoulli_sample(df, 0.3, "id", 4 + r)
        assert many.where(F.col("run") == r).select("id").exceptAll(one).count() == 0


@pytest.mark.parametrize("n", [0, 1, 777, 5000, 9000])
def test_without_replacement(spark, n):
    df = spark.range(5000)
    a = sampling.sample_without_replacement(df, n, "id", 3)
    b = df.orderBy(row_hash("id", draw_seeds(5, 3)), "id").limit(n)
    ids = sorted(r.id for r in a.collect())
    assert ids == sorted(r.id for r in b.collect())
    assert len(ids) == len(set(ids)) == min(n, 5000)


def test_with_replacement(spark):
    df = spark.range(100).withColumnRenamed("id", "row")
    draws = spark.range(1000).withColumnRenamed("id", "draw")
    got = sampling.sample_with_replacement(df, draws, 3, row_id="row").collect()
    assert len(got) == 1000 and len({r.row for r in got}) > 95


def test_row_index_is_dense(spark):
    got = sampling.row_index(spark.range(3000), "id", 9).collect()
    assert sorted(r["index"] for r in got) == list(range(3000))


def test_zipf(spark):
    freq = synthetic.freq_zipf(spark.range(1000), 1000, 10_000, 1.25)
    assert freq.agg(F.sum("cnt")).head()[0] == 10_065
    assert freq.where("key = 0").head().cnt == 2_575
    flat = synthetic.freq_zipf(spark.range(10), 10, 100, 0)
    assert {r.cnt for r in flat.collect()} == {10}


def test_expand_splits_hot_keys(spark):
    freq = spark.createDataFrame([(1, 2500), (2, 1), (3, 0), (4, 1000)], "key long, cnt long")
    got = synthetic.expand(freq, chunk=1000).groupBy("key").count()
    assert {(r.key, r["count"]) for r in got.collect()} == {(1, 2500), (2, 1), (4, 1000)}


def test_shuffled_streams_are_dealt_by_their_rows(spark):
    """A short table that stands for many rows is not one task's work."""
    freq = spark.createDataFrame([(k, 100_000) for k in range(60)], "key long, cnt long")
    got = synthetic.shuffled_stream(freq).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 6_000_000 and len(got) == 3
    empty = synthetic.shuffled_stream(freq.where("key < 0"))
    assert empty.count() == 0


def test_shuffles_keep_the_counts(spark):
    freq = synthetic.freq_zipf(spark.range(500), 500, 5000, 1.0)
    want = sorted(r.cnt for r in freq.collect())
    for out in (synthetic.shuffle_frequencies(freq), synthetic.decorrelate(freq, 500, -0.5)):
        got = out.collect()
        assert sorted(r.key for r in got) == list(range(500))
        assert sorted(r.cnt for r in got) == want
    assert synthetic.decorrelate(freq, 500, 1).exceptAll(freq).count() == 0
    both = synthetic.shuffle_frequencies_paired(freq, freq).collect()
    assert all(r.cnt == r.cnt2 for r in both)
    with pytest.raises(ValueError):
        synthetic.decorrelate(freq, 500, 2)


def test_draws(spark):
    domain = spark.range(200)
    rows = spark.range(20000).withColumnRenamed("id", "i")
    weights = [1 / k**0.8 for k in range(1, 201)]
    share = weights[0] / sum(weights)
    closed = synthetic.zipf_draws(rows, "i", 200, 0.8)
    looked = synthetic.zipf_draws_by_table(rows, "i", domain, 0.8)
    for df in (closed, looked):
        low, high, ones = df.agg(F.min("draw"), F.max("draw"), F.count_if(F.col("draw") == 1)).head()
        assert low == 1 and high <= 201
        assert abs(ones / 20000 - share) < 0.02
    normal = synthetic.stable_draws(rows, "i", 2.0).agg(F.avg("draw"), F.stddev("draw")).head()
    assert abs(normal[0]) < 0.05 and abs(normal[1] - 2**0.5) < 0.05
    for alpha in (1.0, 0.005, 0.7):
        assert synthetic.stable_draws(rows, "i", alpha).where("draw IS NULL").count() == 0
    for theta in (1.0, 2.5):
        out = synthetic.zipf_draws(rows, "i", 50, theta, seed=3)
        tops = dict(map(tuple, out.groupBy("draw").count().collect()))
        total = sum(1 / k**theta for k in range(1, 51))
        for k in (1, 2, 5):
            assert abs(tops[k] / 20000 - 1 / k**theta / total) < 0.015
    with pytest.raises(ValueError):
        synthetic.stable_draws(rows, "i", 2.5)


def test_generators_by_name(spark):
    for kind, p in (("zipf", 1.0), ("uniform", 0.3), ("uniform_limited", 1.0), ("zipf_shifted", 3.0)):
        df = synthetic.generate_relation(spark.range(50), 50, 1000, kind, 0.5, p)
        assert abs(df.count() - 1000) < 60
    with pytest.raises(ValueError):
        synthetic.generate_relation(spark.range(5), 5, 10, "other")


def test_text_stream(spark):
    path = work_path(spark, "ints")
    lines = spark.createDataFrame([("1 2  3 ",), ("",), (" 4\t5",), ("x 6",)], "value string")
    lines.write.text(path)
    assert sorted(r.key for r in read_key_stream_text(spark, path).collect()) == [1, 2, 3, 4, 5, 6]
    again = work_path(spark, "ints")
    write_key_stream_text(read_key_stream_text(spark, path), again)
    assert read_key_stream_text(spark, again).count() == 6


def test_null_keys_are_dropped(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k long")
    assert as_stream(df, "k").count() == 2


def test_store(spark, small):
    seeds = seed_table(rows=2, seed=3)
    cells = linear.count_min_build(key_stream(spark, small, "lineitem", "l_suppkey"), seeds, 8)
    path = work_path(spark, "sketch")
    save_sketch(cells, path, "count_min", rows=2, buckets=8)
    back = load_sketch(spark, path, "count_min", rows=2, buckets=8)
    assert back.exceptAll(cells).count() == 0 and back.count() == cells.count()
    with pytest.raises(ValueError, match="not fast_agms"):
        load_sketch(spark, path, "fast_agms")
    with pytest.raises(ValueError, match="other parameters"):
        load_sketch(spark, path, "count_min", buckets=16)
    cells.drop("v").write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="damaged"):
        load_sketch(spark, path, "count_min")


def test_logs(spark):
    path = work_path(spark, "log")
    lines = [
        "Total processing throughput 12.500000 MOps per sec",
        "noise",
        "Average latency: 3.25 us",
        "Precision:0.900000, Recall:1.000000, AverageRelativeError:nan",
        "4096 128",
        "1000 2 0.001",
        "0 17 500 17 510 1",
        "1 18 400 4294967295 0 0",
    ]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    assert run_logs.read_throughput(spark, path).head().mops == 12.5
    assert run_logs.read_latency(spark, path).head().latency_us == 3.25
    accuracy = run_logs.read_accuracy(spark, path).head()
    assert (accuracy.precision, accuracy.recall) == (0.9, 1.0) and accuracy.are != accuracy.are
    assert run_logs.read_memory(spark, path).head()[1:] == (4096, 128)
    assert run_logs.read_rank_headers(spark, path).head()[1:] == (1000, 2, 0.001)
    ranks = sorted(run_logs.read_rank_table(spark, path).collect())
    assert [r.est_key for r in ranks] == [17, None] and [r.equal for r in ranks] == [True, False]
    assert ranks[0].file.endswith(".txt")


def test_run_parameters(spark):
    names = ["skew_cm_a_throughput_24_1.25_0.0001_1000_16_10000000_100_runs_throughput.log", "other.log"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    first, second = run_logs.with_run_parameters(df).collect()
    assert tuple(first)[1:] == (24, 1.25, 0.0001, 1000, 16, 10_000_000, 100)
    assert set(tuple(second)[1:]) == {None}


def test_string_keys_find_their_code(make_stream):
    seeds = seed_table(rows=2, seed=4)
    stream = make_stream(["a", "b", "a"], kind="string")
    sketch = linear.count_min_build(stream, seeds, 4096)
    got = linear.count_min_query(sketch, stream.select("key").distinct(), seeds, 4096)
    assert {(r.key, r.est) for r in got.collect()} == {("a", 2), ("b", 1)}


def test_quality_edges(spark, make_stream):
    hist = exact.exact_histogram(make_stream([1] * 6 + [2] * 3 + [3]))
    none = spark.createDataFrame([], "key long, est long")
    got = quality.precision_recall_are(hist, none, 0.5).head()
    assert (got.precision, got.recall, got.are) == (1.0, 0.0, 0.0)
    some = spark.createDataFrame([(1, 9), (3, 5)], "key long, est long")
    got = quality.precision_recall_are(hist, some, 0.5).head()
    assert (got.precision, got.recall, got.are) == (0.5, 1.0, 0.5)
    wrong = spark.createDataFrame([(3, 5)], "key long, est long")
    assert quality.precision_recall_are(hist, wrong, 0.5).head().are is None
    empty = exact.exact_histogram(make_stream([]))
    assert quality.precision_recall_are(empty, none, 0.5).head().recall == 1.0
    assert quality.duplicate_check(some.unionByName(wrong)).head().key == 3


def test_rank_report(spark, make_stream):
    hist = exact.exact_histogram(make_stream([k for k in range(1, 200) for _ in range(k)]))
    result = hist.orderBy(F.desc("cnt")).limit(5).select("key", F.col("cnt").alias("est"))
    got = sorted(reports.rank_comparison_report(hist, result, 0.01).collect())
    assert len(got) == 106 and [r.rank for r in got] == list(range(106))
    assert sum(r.equal for r in got) == 5 and got[5].est_key is None


def test_rank_report_has_no_cap(spark, make_stream):
    hist = exact.exact_histogram(make_stream(list(range(700)) + [0, 1, 2]))
    result = hist.where("key < 400").select("key", F.col("cnt").alias("est"))
    got = sorted(reports.rank_comparison_report(hist, result, 0.005).collect())
    assert [r.rank for r in got] == list(range(501))
    assert all(r.equal for r in got[:400]) and not any(r.equal for r in got[400:])


def test_sizes(make_stream):
    assert sizes.counters_for(0.001) == 1001
    assert sizes.counters_for(0.0001, 1.25, 24) == int((1 / 0.0024) ** 0.8) + 1
    assert sizes.counters_for_deltas(0.01, 0.001, 4) == int(5 / (4 * 0.009)) + 1
    with pytest.raises(ValueError):
        sizes.counters_for_deltas(0.01, 0.02, 4)
    stream = make_stream([k for k in range(1, 200) for _ in range(2000 // k)], partitions=1)
    n = sum(2000 // k for k in range(1, 200))
    summary = frequent.space_saving(stream, sizes.counters_for(0.02))
    assert summary.agg(F.max("err")).head()[0] <= 0.02 * n


def test_summary_text(spark, make_stream):
    summary = stored(frequent.frequent_items_sketch(make_stream([1, 1, 2]), 5), "t")
    text = reports.summary_to_string(summary, items=1).head()[0]
    assert "active items: 2" in text and text.endswith("1 2")
    assert table is not None
