"""Queries for the quality metrics, the reports, the sketch store and the run logs.

The run logs are derived from the events: an event is a measured query of a worker (user_id) in a
run (event_type), its value the latency.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keytally.functions.hashing import owner_by_hash
from keytally.functions.seeds import seed_table
from keytally.operators import exact, linear
from keytally.operators import frequent as f
from keytally.operators import quality as ql
from keytally.operators.linear import count_min_build, count_min_query
from keytally.plans import sqltext as q
from keytally.plans.registry import Registry
from keytally.session import work_path
from keytally.sinks import reports
from keytally.sinks.sketch_store import load_sketch, save_sketch, stored
from keytally.sources import run_logs
from keytally.sources.key_streams import key_stream, table, token_stream

reg = Registry()

PHI = 0.01
SEEDS = seed_table(rows=4, seed=37)
BUCKETS = 64
SUPP = q.stream("lineitem", "l_suppkey")
HIST = q.hist(SUPP)
CELLS = q.sketch(SUPP, SEEDS, BUCKETS)
N = f"(SELECT SUM(cnt) FROM {HIST})"


def supp(s, d):
    return key_stream(s, d, "lineitem", "l_suppkey")


def estimated(s, d):
    """Keys whose Count-Min estimate reaches phi * N: some of them are not frequent."""
    hist = exact.exact_histogram(supp(s, d))
    rows = count_min_query(
        count_min_build(supp(s, d), SEEDS, BUCKETS), hist.select("key"), SEEDS, BUCKETS
    )
    total = hist.agg(F.sum("cnt").alias("n")).scalar()
    return rows.where(F.col("est") >= F.lit(PHI) * total)


ESTIMATED = (
    f"(SELECT key, est FROM {q.count_min_est(CELLS, f'(SELECT key FROM {HIST})', SEEDS, BUCKETS)} "
    f"WHERE est >= {PHI}::DOUBLE * {N})"
)


def counted(s, d):
    """Keys reported by summaries with room for every supplier, of which there are as many as that takes: exact counts."""
    room = 1 << 16
    suppliers = supp(s, d).select(F.approx_count_distinct("key").alias("n")).first().n
    owners = max(4, 4 * suppliers // room)
    summary = stored(
        f.space_saving_sharded(supp(s, d), room, owners, owner_by_hash("key", owners)), "supp"
    )
    return f.frequent_elements_global(summary, PHI)


_metrics = (
    "SELECT COUNT(est) AS reported, COUNT(cnt) AS truth, COUNT(*) FILTER (est IS NOT NULL AND cnt IS NOT NULL) AS "
    "hits, hits::DOUBLE / reported AS precision, hits::DOUBLE / truth AS recall, round(AVG(ABS(est - cnt) / "
    "cnt::DOUBLE), 9) AS are FROM (SELECT * FROM {hist} WHERE cnt >= {bar}) FULL JOIN {result} USING (key)"
)


def _rounded(df):
    return df.withColumn("are", F.round("are", 9))


reg.add(
    "precision_recall_are",
    lambda s, d: _rounded(
        ql.precision_recall_are(exact.exact_histogram(supp(s, d)), estimated(s, d), PHI)
    ),
    _metrics.format(hist=HIST, bar=f"{PHI}::DOUBLE * {N}", result=ESTIMATED),
)
reg.add(
    "precision_recall_are_exact_case",
    lambda s, d: ql.precision_recall_are(exact.exact_histogram(supp(s, d)), counted(s, d), PHI).select(
        "precision", "recall", "are"
    ),
    "SELECT 1::DOUBLE AS precision, 1::DOUBLE AS recall, 0::DOUBLE AS are FROM (SELECT COUNT(*) FROM lineitem)",
)
reg.add(
    "duplicate_check",
    lambda s, d: ql.duplicate_check(
        table(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    ),
    "SELECT l_orderkey || '-' || l_linenumber AS key, COUNT(*) AS times FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1",
)
reg.add(
    "point_errors",
    lambda s, d: ql.point_errors(exact.exact_histogram(supp(s, d)), estimated(s, d)),
    f"SELECT key, cnt, ABS(cnt - est) AS absolute_error, ABS(1 - est / cnt::DOUBLE) AS relative_error FROM {HIST} JOIN "
    f"{ESTIMATED} USING (key)",
)


def ranks(s, d):
    return reports.rank_comparison_report(exact.exact_histogram(supp(s, d)), counted(s, d), PHI)


_frequent = f"(SELECT * FROM {HIST} WHERE cnt >= {PHI}::DOUBLE * {N})"
RANKS = (
    "(SELECT (t.r - 1)::INTEGER AS rank, t.key AS true_key, t.cnt AS true_cnt, e.key AS est_key, COALESCE(e.cnt, 0) AS "
    f"est_cnt, e.key IS NOT NULL AS \"equal\" FROM (SELECT *, row_number() OVER (ORDER BY cnt DESC, key) AS r FROM {HIST}) "
    f"t LEFT JOIN (SELECT *, row_number() OVER (ORDER BY cnt DESC, key) AS r FROM {_frequent}) e USING (r) "
    f"WHERE t.r <= (SELECT COUNT(*) FROM {_frequent}) + 101)"
)
reg.add("rank_comparison_report", ranks, f"SELECT * FROM {RANKS}")
reg.add(
    "rank_header",
    lambda s, d: reports.rank_header(exact.exact_histogram(supp(s, d)), PHI),
    f"SELECT {N}::BIGINT AS n, COUNT(*) AS k, {PHI}::DOUBLE AS phi FROM {_frequent}",
)
reg.add(
    "rank_table_quality",
    lambda s, d: ql.rank_table_quality(ranks(s, d), exact.size_of(supp(s, d)), PHI),
    f"SELECT COUNT(est_key) AS reported, COUNT(*) FILTER (true_cnt >= ceil({PHI}::DOUBLE * {N})) AS truth, truth AS hits, "
    f"hits::DOUBLE / reported AS precision, 1::DOUBLE AS recall, 0::DOUBLE AS are FROM {RANKS}",
)


@reg.query(
    "error_bounds",
    "WITH n AS (SELECT SUM(weight)::DOUBLE AS n FROM "
    + q.TOKENS
    + "), z AS (SELECT SUM(1 / pow(p_partkey + 1, 1.25::DOUBLE)) AS z FROM part) SELECT r::INTEGER AS rank, 4000 / n AS "
    "relative_bound, round(4000 / (z * pow(r, 1.25::DOUBLE)), 6) AS absolute_bound FROM (SELECT row_number() OVER (ORDER BY "
    f"cnt DESC, key) AS r FROM (SELECT * FROM {HIST} WHERE cnt >= {PHI}::DOUBLE * {N})), n, z",
)
def _bounds(s, d):
    order = exact.exact_frequent_elements(supp(s, d), PHI)
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "key"))
    domain = table(s, d, "part").select(F.col("p_partkey").alias("id"))
    rows = ql.error_bounds(
        order.select(rank.alias("rank")),
        exact.size_of(token_stream(s, d)),
        ql.zeta(domain, 1.25),
        1.25,
        delay=1000,
        shards=4,
    )
    return rows.withColumn("absolute_bound", F.round("absolute_bound", 6))


def runs(s, d):
    """A run per (algorithm, configuration, repetition), with a measured value."""
    return table(s, d, "events").select(
        F.col("event_type").alias("algorithm"),
        (F.col("user_id") % 10).alias("skew"),
        "value",
    )


def summary(s, d):
    return ql.run_summary(runs(s, d), "value", ("algorithm", "skew"))


_summary = (
    "(SELECT event_type AS algorithm, user_id % 10 AS skew, COUNT(*) AS runs, AVG(value) AS mean, stddev_pop(value) "
    "AS std FROM events GROUP BY 1, 2)"
)
reg.add(
    "run_summary",
    lambda s, d: summary(s, d).select(
        "algorithm", "skew", "runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    ),
    f"SELECT algorithm, skew, runs, round(mean, 6) AS mean, round(std, 6) AS std FROM {_summary}",
)
reg.add(
    "speedup",
    lambda s, d: ql.speedup(summary(s, d), "algorithm", "view", ("skew",)).select(
        "algorithm", "skew", F.round("speedup", 6).alias("speedup")
    ),
    f"SELECT a.algorithm, skew, round(a.mean / b.mean, 6) AS speedup FROM {_summary} a LEFT JOIN (SELECT skew, mean FROM "
    f"{_summary} WHERE algorithm = 'view') b USING (skew)",
)


def workers(s, d):
    """Per run and worker: operations, queries among them, and a duration in ms."""
    return table(s, d, "events").groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("operations"),
        F.count_if(F.col("value") > 50).alias("queries"),
        F.sum(F.ceil("value")).alias("ms"),
    )


_workers = (
    "(SELECT event_type, user_id, COUNT(*) AS operations, COUNT(*) FILTER (value > 50) AS queries, "
    "SUM(ceil(value))::BIGINT AS ms FROM events GROUP BY 1, 2)"
)
reg.add(
    "operation_totals",
    lambda s, d: ql.operation_totals(workers(s, d), ("event_type",)),
    "SELECT event_type, SUM(operations)::BIGINT AS operations, SUM(queries)::BIGINT AS queries, (SUM(operations) - "
    "SUM(queries))::BIGINT AS inserts, (SUM(queries) * 100)::DOUBLE / SUM(operations) AS query_percent FROM "
    f"{_workers} GROUP BY 1",
)
reg.add(
    "throughput",
    lambda s, d: ql.throughput(workers(s, d), ("event_type",)),
    "SELECT event_type, (SUM(operations) - SUM(queries))::DOUBLE / MAX(ms) / 1000 AS m_inserts, SUM(queries)::DOUBLE / "
    f"MAX(ms) / 1000 AS m_queries, SUM(operations)::DOUBLE / MAX(ms) / 1000 AS m_operations FROM {_workers} GROUP BY 1",
)
reg.add(
    "mean_latency",
    lambda s, d: ql.mean_latency(
        table(s, d, "events"), "user_id", "value", ("event_type",)
    ).select("event_type", F.round("latency", 6).alias("latency")),
    "SELECT event_type, round(AVG(m), 6) AS latency FROM (SELECT event_type, user_id, AVG(value) AS m FROM events "
    "GROUP BY 1, 2) GROUP BY 1",
)

# --- reports and the sketch store ------------------------------------------------------


@reg.query(
    "frequency_report",
    f"SELECT key, COALESCE(cnt, 0) AS true_cnt, est FROM {q.count_min_est(CELLS, '(SELECT p_partkey AS key FROM part)', SEEDS, BUCKETS)} "
    f"LEFT JOIN {HIST} USING (key)",
)
def _frequency_report(s, d):
    report = reports.frequency_report(
        table(s, d, "part").select(F.col("p_partkey").alias("key")),
        exact.exact_histogram(supp(s, d)),
        count_min_build(supp(s, d), SEEDS, BUCKETS),
        SEEDS,
        BUCKETS,
    )
    path = work_path(s, "frequency-report")
    reports.write_report(report, path)
    return s.read.parquet(path)


@reg.query("save_and_load_sketch", f'SELECT "row", bucket, v FROM {CELLS}')
def _store(s, d):
    path = work_path(s, "sketch")
    shape = {"rows": SEEDS.depth, "buckets": BUCKETS}
    save_sketch(count_min_build(supp(s, d), SEEDS, BUCKETS), path, "count_min", **shape)
    return load_sketch(s, path, "count_min", **shape)


reg.add(
    "summary_to_string",
    lambda s, d: reports.summary_to_string(
        stored(f.frequent_items_sketch(key_stream(s, d, "events", "event_type"), 6), "types"), 3.5 / 64, 3
    ),
    "WITH h AS (SELECT event_type AS key, COUNT(*) AS cnt FROM events GROUP BY 1), t AS (SELECT * FROM h ORDER BY cnt "
    "DESC, key LIMIT 3) SELECT 'active items: ' || (SELECT COUNT(*) FROM h) || chr(10) || 'total weight: ' || (SELECT "
    "SUM(cnt)::BIGINT FROM h) || chr(10) || 'max error: 0' || chr(10) || 'epsilon: 0.0546875' || chr(10) || 'items:' || chr(10) "
    "|| (SELECT string_agg(key || ' ' || cnt, chr(10) ORDER BY cnt DESC, key) FROM t) AS summary",
)

# --- run logs --------------------------------------------------------------------------


def _written(s, d, line):
    path = work_path(s, "run-log")
    run_logs.write_log_lines(table(s, d, "events"), path, line)
    return path


reg.add(
    "read_throughput_log",
    lambda s, d: run_logs.read_throughput(
        s,
        _written(s, d, F.concat(F.lit("Total processing throughput "), F.col("value"), F.lit(" MOps per sec"))),
    ).select("mops"),
    "SELECT value AS mops FROM events",
)
reg.add(
    "read_latency_log",
    lambda s, d: run_logs.read_latency(
        s, _written(s, d, F.concat(F.lit("Average latency: "), F.col("value"), F.lit(" us")))
    ).select("latency_us"),
    "SELECT value AS latency_us FROM events",
)
reg.add(
    "read_accuracy_log",
    lambda s, d: run_logs.read_accuracy(
        s,
        _written(
            s,
            d,
            F.concat(
                F.lit("Precision:"), F.lit(1) / (F.col("event_id") + 1),
                F.lit(", Recall:"), F.lit(0.5),
                F.lit(", AverageRelativeError:"), F.col("value"),
            ),
        ),
    ).select("precision", "recall", "are"),
    "SELECT 1::DOUBLE / (event_id + 1) AS precision, 0.5::DOUBLE AS recall, value AS are FROM events",
)
reg.add(
    "read_memory_log",
    lambda s, d: run_logs.read_memory(
        s, _written(s, d, F.concat_ws(" ", "event_id", "user_id"))
    ).select("bytes", "counters"),
    "SELECT event_id AS bytes, user_id AS counters FROM events",
)


@reg.query("read_rank_table", f"SELECT * FROM {RANKS}")
def _rank_table(s, d):
    path = work_path(s, "ranks")
    line = F.concat_ws(
        " ",
        "rank",
        "true_key",
        "true_cnt",
        F.coalesce(F.col("est_key").cast("string"), F.lit(run_logs.NO_KEY[0])),
        "est_cnt",
        F.col("equal").cast("int"),
    )
    run_logs.write_log_lines(ranks(s, d), path, line)
    return run_logs.read_rank_table(s, path).drop("file")
