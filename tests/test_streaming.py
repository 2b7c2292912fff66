"""Streams give what a batch gives, also after a restart."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from keytally.functions.hashing import owner_by_hash
from keytally.functions.seeds import seed_table
from keytally.operators import exact, frequent, linear
from keytally.session import work_path
from keytally.sources.key_streams import key_stream, live_key_stream
from keytally.streaming import counters, linear as stream_linear, marks

SCHEMA = "key long, weight long"
SEEDS = seed_table(rows=2, seed=3)


def add_file(spark, path, keys):
    rows = spark.createDataFrame([(k, 1) for k in keys], SCHEMA)
    rows.coalesce(1).write.mode("append").parquet(path)


def live(spark, path):
    return live_key_stream(spark, path, SCHEMA, "key", "weight", files_per_trigger=1)


def test_restart_goes_on(spark):
    path, folder, cells = (work_path(spark, n) for n in ("in", "out", "cells"))
    owner = owner_by_hash("key", 3)
    schema = counters.summary_schema(LongType())
    everything = []
    for part in (list(range(50)) * 2, [7] * 100, [1, 2, 3]):
        add_file(spark, path, part)
        everything += part
        counters.run_space_saving(live(spark, path), 100, owner, folder, phi=0.3)
        stream_linear.run_linear_sketch(live(spark, path), SEEDS, 16, cells)
    batch = spark.createDataFrame([(k, 1) for k in everything], SCHEMA)
    want = {(r.key, r.cnt) for r in exact.exact_histogram(batch).collect()}
    now = counters.snapshot(spark, folder, schema)
    assert {(r.key, r.est) for r in frequent.bounds(now).collect()} == want
    got = stream_linear.stream_cells(spark, cells)
    whole = linear.count_min_build(batch, SEEDS, 16)
    assert sorted(got.select("row", "bucket", "v").collect()) == sorted(
        whole.select("row", "bucket", "v").collect()
    )
    visible = {r.batch: r.visible for r in counters.visible_weight(spark, folder, schema).collect()}
    assert max(visible.values()) == len(everything)
    last = counters.answers(spark, folder, LongType()).where(F.col("batch") == max(visible))
    assert {r.key for r in last.collect()} == {7}


def test_untouched_owners_stay_in_the_snapshot(spark):
    path, folder = (work_path(spark, n) for n in ("in", "out"))
    add_file(spark, path, list(range(40)))
    counters.run_space_saving(live(spark, path), 100, owner_by_hash("key", 4), folder)
    add_file(spark, path, [5])
    counters.run_space_saving(live(spark, path), 100, owner_by_hash("key", 4), folder)
    now = counters.snapshot(spark, folder, counters.summary_schema(LongType()))
    assert now.agg(F.sum("n")).head()[0] == 41
    assert now.where("key IS NOT NULL").count() == 40


def test_bounded_stream_state(spark, small):
    """With fewer counters than keys, the bounds hold over the stream."""
    path, folder = (work_path(spark, n) for n in ("in", "out"))
    batch = key_stream(spark, small, "lineitem", "l_partkey")
    batch.repartition(4).write.parquet(path)
    counters.run_space_saving(live(spark, path), 20, owner_by_hash("key", 2), folder)
    now = counters.snapshot(spark, folder, counters.summary_schema(LongType()))
    rows = frequent.bounds(now)
    assert rows.count() == 40
    both = rows.join(exact.exact_histogram(batch), "key", "left").fillna(0, ["cnt"])
    assert both.where("lower > cnt OR upper < cnt").count() == 0


def test_majority_over_batches(spark):
    path, folder = (work_path(spark, n) for n in ("in", "out"))
    for part in ([4] * 30 + [5] * 10, [4] * 5 + [6] * 2):
        add_file(spark, path, part)
    stream_linear.run_majority_sketch(live(spark, path), SEEDS, 512, folder)
    votes = stream_linear.stream_votes(spark, folder, LongType())
    top = {r.cand: r.cnt for r in votes.where("row = 0").collect()}
    assert top == {4: 35, 5: 10, 6: 2}


def test_progress_as_throughput(spark):
    from keytally.operators.quality import throughput
    from keytally.streaming.runner import progress_table

    path, folder = (work_path(spark, n) for n in ("in", "out"))
    for _ in range(3):
        add_file(spark, path, list(range(100)))
    progress = stream_linear.run_histogram(live(spark, path), folder, partitions=2)
    rows = progress_table(spark, progress)
    assert rows.agg(F.sum("operations")).head()[0] == 300 and rows.count() >= 3
    assert throughput(rows).head().m_operations > 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def ordered(spark, path):
    rows = spark.readStream.schema("key long, weight long, at long").option("maxFilesPerTrigger", 1)
    return rows.parquet(path)


def test_marks_are_answered_as_of_their_row(spark):
    """Over several micro-batches, a restart, rows without a key and keys past 2^53."""
    path, folder = (work_path(spark, n) for n in ("in", "marks"))
    big = (1 << 60) + 1
    keys = [big if i % 3 else (None if i % 5 == 0 else i % 7) for i in range(230)]
    owner = owner_by_hash("key", 3)
    for start, end in ((0, 90), (90, 100), (100, 230)):
        rows = [(keys[i], 2, i) for i in range(start, end)]
        spark.createDataFrame(rows, "key long, weight long, at long").coalesce(1).write.mode("append").parquet(path)
        progress = marks.run_marks(ordered(spark, path), 50, 0.3, "at", 40_000, owner, 3, folder, 3)
    found = marks.frequent_at_marks(spark, folder, LongType(), 0.3, 3).collect()
    every = marks.rows_per_mark(40_000)
    assert every == 25
    want = {}
    for mark in range(1, 230 // every + 1):
        seen = [k for k in keys[: mark * every] if k is not None]
        n = 2 * len(seen)
        want |= {(mark, k): (2 * seen.count(k), n) for k in set(seen) if 2 * seen.count(k) >= 0.3 * n}
    assert {(r.mark, r.key): (r.est, r.n) for r in found} == want
    assert all(r.latency_us > 0 for r in found)
    assert marks.average_latency(spark, folder, LongType()).first().queries == 230 // every
    with pytest.raises(ValueError):
        marks.rows_per_mark(0)


def test_flush_sends_all_and_the_stream_goes_on(spark):
    path, folder = (work_path(spark, n) for n in ("in", "deltas"))
    shard = owner_by_hash("key", 3)
    big = (1 << 60) + 1
    add_file(spark, path, [big] * 40 + [1] * 9 + [2])
    counters.run_deltas(live(spark, path), 20, 0.9, shard, folder, 3, shards=3, flush=True)
    got = {r.key: r.est for r in counters.merged_deltas(spark, folder, LongType()).collect()}
    assert got == {big: 40, 1: 9, 2: 1}
    add_file(spark, path, [1, 2, 2, 3])
    counters.run_deltas(live(spark, path), 20, 0.9, shard, folder, 3, shards=3)
    held = {r.key: r.est for r in counters.merged_deltas(spark, folder, LongType()).collect()}
    assert held != {big: 40, 1: 10, 2: 3, 3: 1}
    counters.run_deltas(live(spark, path), 20, 0.9, shard, folder, 3, shards=3, flush=True)
    got = {r.key: r.est for r in counters.merged_deltas(spark, folder, LongType()).collect()}
    assert got == {big: 40, 1: 10, 2: 3, 3: 1}
    with pytest.raises(ValueError):
        counters.run_deltas(live(spark, path), 20, 0.9, shard, folder, 3, flush=True)


@pytest.mark.parametrize("owners", [2, 7])
def test_owners_dealt_anew_keep_their_bounds(spark, small, owners):
    """To more owners, and to fewer, which have to drop counters."""
    path, first, second = (work_path(spark, n) for n in ("in", "old", "new"))
    batch = key_stream(spark, small, "lineitem", "l_partkey")
    batch.repartition(3).write.parquet(path)
    counters.run_space_saving(live(spark, path), 25, owner_by_hash("key", 4), first, partitions=4)
    state = counters.state_of(spark, first)
    schema = counters.summary_schema(LongType())
    same = state.select(schema.fieldNames()).exceptAll(counters.snapshot(spark, first, schema))
    assert same.count() == 0
    owner = owner_by_hash("key", owners)
    warm = counters.dealt_anew(state, owner, owners)
    assert warm.agg(F.sum("n")).first()[0] == batch.count()
    counters.run_space_saving(live(spark, path), 25, owner, second, warm=warm, partitions=owners)
    now = counters.snapshot(spark, second, schema)
    assert now.where("key IS NULL").agg(F.sum("n")).first()[0] == 2 * batch.count()
    truth = exact.exact_histogram(batch).withColumn("cnt", 2 * F.col("cnt"))
    both = truth.join(frequent.bounds(now), "key", "full")
    assert both.where("cnt IS NULL OR lower > cnt OR upper < cnt").count() == 0
    floor = now.where("key IS NULL").agg(F.max("floor")).first()[0]
    assert both.where(F.col("est").isNull() & (F.col("cnt") > floor)).count() == 0


def test_progress_of_every_micro_batch(spark):
    """More micro-batches than Spark itself remembers."""
    from keytally.streaming.runner import progress_table

    spark_keeps = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    assert spark_keeps == 100
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        path, folder = (work_path(spark, n) for n in ("in", "out"))
        for i in range(12):
            add_file(spark, path, [i])
        progress = stream_linear.run_linear_sketch(live(spark, path), SEEDS, 16, folder, partitions=1)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    rows = progress_table(spark, progress).collect()
    assert len(rows) == 12 and sum(r.operations for r in rows) == 12 and all(r.queries == 0 for r in rows)


def test_old_snapshots_are_removed(spark):
    from keytally.sinks.folders import names

    path, folder = (work_path(spark, n) for n in ("in", "out"))
    for i in range(4):
        add_file(spark, path, [i])
    stream_linear.run_linear_sketch(live(spark, path), SEEDS, 16, folder, partitions=1)
    assert [n for n in names(spark, f"{folder}/cells") if n[0] not in "._"] == ["batch=2", "batch=3"]
    assert stream_linear.stream_cells(spark, folder).agg(F.sum("v")).first()[0] == 8


def test_faults_at_marks_without_a_row_per_key_and_mark(spark):
    """Against all keys at all marks; one answer is wrong, one is missing, and a null key counts as missed."""
    keys = [None if i % 4 == 0 else (i % 3 if i % 2 else 100 + i) for i in range(400)]
    every, phi = 10, 0.15
    rows = [(i // every, k) for i, k in enumerate(keys)]
    counts = spark.createDataFrame(rows, "step long, key long").groupBy("step", "key").agg(F.count("*").alias("cnt"))
    seen = spark.createDataFrame([(m,) for m in range(1, 41)], "mark long")
    truth, answers = {}, []
    for mark in range(1, 41):
        before = keys[: mark * every]
        truth[mark] = {k for k in set(before) if before.count(k) >= phi * every * mark}
        answers += [(mark, k, n, n, n) for k in truth[mark] - {None} for n in [before.count(k)]]
    dropped, broken = answers[5], answers[9]
    given = [a for a in answers if a not in (dropped, broken)] + [(*broken[:2], 0, 0, 0), (40, 999, 1, 1, 1)]
    found = spark.createDataFrame(given, "mark long, key long, est long, lower long, upper long")
    want = {mark: int(None in truth[mark]) for mark in truth}
    for mark in (dropped[0], broken[0], 40):
        want[mark] += 1
    got = marks.faults_at_marks(counts, found, seen, phi, every).collect()
    assert {r.mark: r.faults for r in got} == {m: n for m, n in want.items() if n}
    runs = marks.counts_up_to(counts, found, F.lit(40))
    assert runs.count() == counts.count() + len(given)
    assert marks.frequent_up_to(runs, phi, every).count() == sum(map(len, truth.values()))


USERS = 50_000


@pytest.fixture(scope="module")
def many_users(spark):
    """More users than four owners had counters for, and more per owner than an Arrow batch has rows."""
    folder = work_path(spark, "users")
    rows = spark.range(USERS + 500).select(
        F.col("id").alias("event_id"), (F.col("id") % USERS).alias("user_id"), F.lit("view").alias("event_type")
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name, times", [("stream_space_saving_exact_case", 1), ("warm_start", 2)])
def test_exact_streams_count_every_user(spark, many_users, name, times):
    from keytally.plans.streams import reg

    rows = reg.queries[name](spark, many_users)
    assert rows.count() == USERS
    cnt = times * F.when(F.col("key") < 500, 2).otherwise(1)
    assert rows.where((F.col("est") != cnt) | (F.col("lower") != cnt) | (F.col("upper") != cnt)).count() == 0
    assert "user_id AS key" in reg.sql[name]
