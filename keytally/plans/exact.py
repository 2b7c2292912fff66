"""Queries for the exact operators and the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from keytally.operators import exact
from keytally.plans import sqltext as q
from keytally.plans.registry import Registry
from keytally.sources.key_streams import key_stream, table, token_stream
from keytally.sources.text_streams import read_key_stream_text, write_key_stream_text
from keytally.session import work_path

PHI = 0.005
SUPP = q.stream("lineitem", "l_suppkey")

reg = Registry()


def supp(spark, d):
    return key_stream(spark, d, "lineitem", "l_suppkey")


#: The domain of the interval queries is [0, 2^KEY_BITS): supplier keys plus a quantity, at any size of
#: the tables. Node ids depend on it.
KEY_BITS = 30


def intervals(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("lo"),
        (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("hi"),
    )


INTERVALS = (
    "(SELECT l_suppkey AS lo, l_suppkey + l_quantity::BIGINT AS hi FROM lineitem)"
)

reg.add(
    "key_stream",
    lambda s, d: key_stream(s, d, "orders", "o_custkey"),
    "SELECT o_custkey AS key, 1::BIGINT AS weight FROM orders",
)
reg.add("token_stream", token_stream, f"SELECT key, weight FROM {q.TOKENS}")
reg.add(
    "exact_histogram",
    lambda s, d: exact.sorted_histogram(token_stream(s, d)),
    f"SELECT key, cnt FROM {q.hist(q.TOKENS)}",
)
reg.add(
    "exact_histogram_weighted",
    lambda s, d: exact.sorted_histogram(key_stream(s, d, "lineitem", "l_partkey", "l_quantity")),
    f"SELECT key, cnt FROM {q.hist(q.stream('lineitem', 'l_partkey', 'l_quantity'))}",
)
reg.add(
    "stream_size",
    lambda s, d: exact.stream_size(token_stream(s, d)),
    f"SELECT SUM(weight)::BIGINT AS n FROM {q.TOKENS}",
)
reg.add(
    "stream_size_by_worker",
    lambda s, d: exact.stream_size(
        key_stream(s, d, "lineitem", "l_suppkey", extra=(F.expr("l_orderkey % 4").alias("part"),)),
        ("part",),
    ),
    "SELECT l_orderkey % 4 AS part, COUNT(*) AS n FROM lineitem GROUP BY 1",
)
reg.add(
    "exact_frequent_elements",
    lambda s, d: exact.exact_frequent_elements(token_stream(s, d), PHI),
    f"WITH h AS {q.hist(q.TOKENS)} SELECT key, cnt FROM h "
    f"WHERE cnt >= {PHI}::DOUBLE * (SELECT SUM(cnt) FROM h)",
)
reg.add(
    "heavy_hitter_count",
    lambda s, d: exact.heavy_hitter_count(supp(s, d), 0.01),
    f"WITH h AS {q.hist(SUPP)} SELECT COUNT(*) AS heavy_keys FROM h "
    "WHERE cnt >= 0.01::DOUBLE * (SELECT SUM(cnt) FROM h)",
)
reg.add(
    "exact_top_k",
    lambda s, d: exact.exact_top_k(token_stream(s, d), 15),
    f"SELECT key, cnt FROM {q.hist(q.TOKENS)} ORDER BY cnt DESC, key LIMIT 15",
)
reg.add(
    "exact_join_size",
    lambda s, d: exact.exact_join_size(
        key_stream(s, d, "orders", "o_custkey"), key_stream(s, d, "customer", "c_custkey")
    ),
    "SELECT COUNT(*)::DOUBLE AS join_size FROM orders JOIN customer ON o_custkey = c_custkey",
)
reg.add(
    "exact_self_join_size",
    lambda s, d: exact.exact_self_join_size(token_stream(s, d)),
    f"SELECT SUM(cnt * cnt)::DOUBLE AS join_size FROM {q.hist(q.TOKENS)}",
)
reg.add(
    "range_join_size",
    lambda s, d: exact.range_join_size(supp(s, d), intervals(s, d), KEY_BITS),
    "SELECT SUM(p.cnt * i.n)::DOUBLE AS matches FROM "
    f"{q.hist(SUPP)} p JOIN (SELECT lo, hi, COUNT(*) AS n FROM {INTERVALS} GROUP BY 1, 2) i "
    "ON p.key BETWEEN i.lo AND i.hi",
)


@reg.query(
    "prefix_sums",
    f"SELECT key, cnt AS v, SUM(cnt) OVER (ORDER BY key)::BIGINT AS prefix FROM {q.hist(SUPP)}",
)
def _prefix(s, d):
    counts = exact.exact_histogram(supp(s, d)).withColumnRenamed("cnt", "v")
    return exact.prefix_sums(counts, KEY_BITS)


@reg.query(
    "read_key_stream_text",
    "SELECT l_partkey AS key, 1::BIGINT AS weight FROM lineitem",
)
def _text(s, d):
    path = work_path(s, "key-text")
    write_key_stream_text(key_stream(s, d, "lineitem", "l_partkey"), path)
    return read_key_stream_text(s, path)


@reg.query(
    "write_key_stream_text",
    "SELECT l_returnflag AS flag, l_suppkey AS key, COUNT(*) AS cnt FROM lineitem GROUP BY 1, 2",
)
def _text_parts(s, d):
    path = work_path(s, "key-text")
    stream = key_stream(s, d, "lineitem", "l_suppkey", extra=(F.col("l_returnflag").alias("flag"),))
    write_key_stream_text(stream, path, partition_by=("flag",))
    return (
        s.read.text(path)
        .groupBy("flag", F.col("value").cast("long").alias("key"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
