"""Frequent elements through Spark: merging, sharding, groups and guarantees."""

import pytest
from pyspark.sql import functions as F

from keytally.functions.hashing import owner_by_hash, owner_of
from keytally.operators import exact, frequent
from keytally.operators.summaries import merge_lower, merge_upper
from keytally.sinks.sketch_store import stored

ZIPF = [k for k in range(1, 400) for _ in range(4000 // k)]
STREAMS = {
    "ascending": ZIPF,
    "descending": ZIPF[::-1],
    "distinct": list(range(3000)),
    "hot": [1] * 5000 + list(range(2, 2000)),
    "single": [9] * 1000,
}


def check(hist, estimates):
    both = hist.join(estimates, "key", "left")
    assert both.where("lower > cnt OR upper < cnt").count() == 0


@pytest.mark.parametrize("name", STREAMS)
def test_merged_and_sharded(make_stream, name):
    stream = make_stream(STREAMS[name], partitions=5)
    hist = exact.exact_histogram(stream)
    m, phi = 200, 0.02
    truth = {r.key for r in exact.exact_frequent_elements(stream, phi).collect()}
    local = stored(frequent.space_saving(stream, m), "t")
    check(hist, merge_upper(local))
    assert truth <= {r.key for r in frequent.frequent_elements_merged(local, phi).collect()}
    sharded = stored(frequent.space_saving_sharded(stream, m, 3, owner_of("key", 3)), "t")
    check(hist, frequent.bounds(sharded))
    assert truth <= {r.key for r in frequent.frequent_elements_global(sharded, phi).collect()}
    weights = frequent.summary_weight_check(sharded).collect()
    assert all(r.counters == r.n for r in weights) and sum(r.n for r in weights) == len(STREAMS[name])
    for kind in (frequent.weighted_frequent(stream, m), frequent.frequent_items_sketch(stream, 8)):
        check(hist, merge_lower(stored(kind, "t")))


def test_each_owner_in_one_task(make_stream):
    stream = make_stream(list(range(4000)), partitions=6)
    summary = stored(frequent.space_saving_sharded(stream, 50, 7, owner_by_hash("key", 7)), "t")
    heads = summary.where("key IS NULL").collect()
    assert sorted(r.shard for r in heads) == list(range(7))


def test_room_for_all_is_exact(make_stream):
    stream = make_stream([(k % 40, k % 5) for k in range(2000)])
    want = {(r.key, r.cnt) for r in exact.exact_histogram(stream).collect() if r.cnt}
    summary = stored(frequent.space_saving(stream, 64), "t")
    got = {(r.key, r.est) for r in merge_upper(summary).collect()}
    assert got == want


def test_merge_keeps_the_largest(make_stream):
    stream = make_stream(ZIPF, partitions=4)
    summary = stored(frequent.space_saving(stream, 300), "t")
    top = frequent.space_saving_merge(summary, 10).collect()
    assert len(top) == 10 and top[0].key == 1


def test_fewer_tasks_fewer_summaries(make_stream):
    stream = make_stream(ZIPF, partitions=6)
    summary = stored(frequent.space_saving(stream, 300, tasks=2), "t")
    assert summary.where("key IS NULL").count() == 2
    check(exact.exact_histogram(stream), merge_upper(summary))


def test_hot_key_crosses_the_shuffle_once_per_task(make_stream):
    from keytally.operators.summaries import pending_deltas

    stream = make_stream([5] * 40_000 + list(range(100, 500)) * 20, partitions=4)
    deltas = pending_deltas(stream, owner_of("key", 3))
    hot = deltas.where("key = 5").agg(F.count(F.lit(1)), F.sum("weight")).head()
    assert hot[0] <= 4 and hot[1] == 40_000


@pytest.mark.parametrize("partitions", [1, 17])
def test_answers_do_not_depend_on_partitions(spark, small, partitions):
    import __spark_entry__ as entry
    from oracle_check import compare, connect

    names = (
        "frequent_elements_global", "frequent_elements_lower", "space_saving_merge", "topkapi_merge",
        "frequent_items_merge", "augmented_sketch", "range_join_size", "update_and_query",
        "sample_without_replacement_large", "shuffle_frequencies",
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        duck, queries, sql = connect(small), entry.queries(), entry.oracle_sql()
        faults = {n: compare(queries[n](spark, small), sql[n], duck) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not any(faults.values()), faults


def test_empty_input(make_stream):
    empty = make_stream([])
    for summary in (
        frequent.space_saving(empty, 10),
        frequent.space_saving_sharded(empty, 10, 2, owner_of("key", 2)),
    ):
        summary = stored(summary, "t")
        assert frequent.frequent_elements_global(summary, 0.1).count() == 0


def test_negative_weight_is_refused(make_stream):
    with pytest.raises(Exception, match="weights must not be negative"):
        frequent.space_saving(make_stream([(1, 5), (2, -1)]), 10).collect()


def test_nan_weight_is_refused(spark):
    from keytally.sources.key_streams import as_stream

    df = spark.createDataFrame([(1, float("nan"))], "k long, w double")
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        as_stream(df, "k", "w").collect()


def test_items_merge_of_sizes(make_stream):
    a, b = make_stream(ZIPF), make_stream(list(range(5000)))
    hist = exact.exact_histogram(a.unionByName(b))
    both = stored(
        frequent.frequent_items_sketch(a, 7).unionByName(frequent.frequent_items_sketch(b, 5)), "t"
    )
    merged = stored(frequent.frequent_items_merge(both, 6), "t")
    assert merged.where("key IS NOT NULL").count() <= frequent.item_capacity(6)
    rows = frequent.item_rows(merged)
    check(hist, rows)
    untracked = hist.join(rows, "key", "left_anti").agg(F.max("cnt")).head()[0]
    assert untracked <= merged.where("key IS NULL").head().floor
    sizes = merged.where("key IS NULL").head()
    assert sizes.n == len(ZIPF) + 5000
    with pytest.raises(ValueError):
        frequent.frequent_items(merged, "other")


def test_items_error_types(make_stream):
    stream = make_stream(ZIPF)
    sketch = stored(frequent.frequent_items_sketch(stream, 6), "t")
    truth = {r.key for r in exact.exact_histogram(stream).collect() if r.cnt > 300}
    none_missed = {r.key for r in frequent.frequent_items(sketch, frequent.NO_FALSE_NEGATIVES, 300).collect()}
    none_wrong = {r.key for r in frequent.frequent_items(sketch, frequent.NO_FALSE_POSITIVES, 300).collect()}
    assert none_wrong <= truth <= none_missed
    assert frequent.frequent_items(sketch, frequent.NO_FALSE_POSITIVES).count() > 0


def test_delta_guarantee(make_stream):
    stream = make_stream(ZIPF, partitions=4)
    n, m, beta = len(ZIPF), 100, 0.002
    hist = exact.exact_histogram(stream)
    for flush in (True, False):
        deltas = stored(frequent.delta_emission(stream, m, beta, flush), "t")
        merged = frequent.delta_merge(deltas, m)
        slack = (2 / (m + 1) + (0 if flush else beta)) * n
        both = hist.join(merged, "key", "left")
        lost = both.where(F.coalesce("est", F.lit(0)) + slack < F.col("cnt")).count()
        assert lost == 0 and both.where("est > cnt").count() == 0


def test_groups(spark, make_stream):
    stream = make_stream(ZIPF, partitions=4).withColumn("g", F.col("key") % 3)
    hist = exact.exact_histogram(stream, ("g",))
    summary = stored(frequent.frequent_elements_by_group(stream, ("g",), 50), "t")
    rows = merge_upper(summary, ("g",))
    both = hist.join(rows, ["g", "key"])
    assert both.where("lower > cnt OR upper < cnt").count() == 0
    found = frequent.frequent_by_group(summary, ("g",), 0.05)
    sizes = hist.groupBy("g").agg(F.sum("cnt").alias("n"))
    heavy = hist.join(sizes, "g").where("cnt >= 0.05 * n")
    assert heavy.join(found, ["g", "key"], "left_anti").count() == 0


def test_rows_are_folded_in_pieces(monkeypatch):
    import pyarrow as pa

    import keytally.operators.summaries as s

    monkeypatch.setattr(s, "BATCH_ROWS", 30)
    monkeypatch.setattr(s, "MAX_DISTINCT", 25)
    schema = pa.schema([pa.field("key", pa.string()), pa.field("weight", pa.int64(), nullable=False)])
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([str((i * j) % 40) for j in range(20)]), pa.array([i] * 20)], schema=schema
        )
        for i in range(1, 30)
    ]
    frames = list(s.compacted(iter(batches), ["key"]))
    assert len(frames) > 1 and all(f["key"].is_unique for f in frames)
    total = {}
    for f in frames:
        for key, weight in zip(f["key"], f["weight"]):
            total[key] = total.get(key, 0) + weight
    want = {}
    for i in range(1, 30):
        for j in range(20):
            key = str((i * j) % 40)
            want[key] = want.get(key, 0) + i
    assert total == want


def test_a_key_that_is_only_pending_is_found(spark):
    result = spark.createDataFrame([(1, 10), (2, 4)], "key long, est long")
    pending = spark.createDataFrame([(2, 5), (3, 7), (3, 1), (4, 0)], "key long, weight long")
    got = frequent.include_pending(result, pending, 2)
    assert sorted(map(tuple, got.collect())) == [(1, 10), (2, 9), (3, 10)]


def test_rows_without_a_key_are_left_out(spark):
    stream = spark.createDataFrame([(1, 2), (None, 5), (1, 1), (2, 1)], "key long, weight long")
    rows = frequent.space_saving(stream.repartition(1), 4)
    assert sorted((r.key, r.cnt) for r in rows.where("key IS NOT NULL").collect()) == [(1, 3), (2, 1)]
    assert rows.where("key IS NULL").agg(F.sum("n")).head()[0] == 4


def test_a_group_that_spans_blocks_is_one_summary(monkeypatch):
    """Rows come by group; blocks of 70 rows cut groups of 200 rows anywhere."""
    import pyarrow as pa

    import keytally.operators.summaries as s

    monkeypatch.setattr(s, "BATCH_ROWS", 70)
    schema = pa.schema([("g", pa.int64())] + [(c, pa.int64()) for c in ("shard", "key", "cnt", "err", "floor", "n")])
    run = s._grouped_runner("space_saving", 5, ["g"], schema)

    class Task:
        def partitionId(self):
            return 3

    monkeypatch.setattr(s.TaskContext, "get", staticmethod(lambda: Task()))
    batches = [
        pa.RecordBatch.from_pydict({"g": [i // 8] * 25, "key": list(range(25)), "weight": [1] * 25})
        for i in range(32)
    ]
    out = pa.Table.from_batches(list(run(iter(batches)))).to_pandas()
    heads = out[out["key"].isna()]
    assert list(heads["g"]) == [0, 1, 2, 3] and list(heads["n"]) == [200] * 4
    rows = out[out["key"].notna()]
    assert (rows.groupby("g").size() == 5).all() and set(out["shard"]) == {3}
    assert ((rows["cnt"] - rows["err"] <= 8) & (8 <= rows["cnt"])).all()


def test_point_estimate(spark, make_stream):
    stream = make_stream(ZIPF)
    owner = owner_of("key", 2)
    summary = stored(frequent.space_saving_sharded(stream, 100, 2, owner), "t")
    probes = spark.createDataFrame([(1,), (399,), (123456,)], "key long")
    got = {r.key: r for r in frequent.point_estimate(summary, probes, owner).collect()}
    assert got[1].est >= 4000 >= got[1].est - got[1].error
    assert got[123456].est == 0 and got[123456].error > 0
