"""Queries for samples and for the interval operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from keytally.functions import hashing as h
from keytally.functions.seeds import draw_seeds, seed_table
from keytally.operators import intervals as iv
from keytally.operators import join_size as j
from keytally.operators import sampling as sm
from keytally.plans import sqltext as q
from keytally.plans.exact import INTERVALS, KEY_BITS, SUPP, intervals, supp
from keytally.plans.registry import Registry
from keytally.sources.key_streams import key_stream, table

reg = Registry()

P, Q = 0.3, 0.5
SIZE = 2000
SEED = 5
SEEDS = seed_table(rows=5, seed=23)
RUNS = 4
RUN_SEEDS = seed_table(rows=5, runs=RUNS, seed=29)
BUCKETS = 128


def orders(s, d):
    return key_stream(s, d, "orders", "o_custkey", extra=("o_orderkey",))


def customers(s, d):
    return key_stream(s, d, "customer", "c_custkey", extra=("c_name",))


def customer_rows(s, d):
    keys = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("id"))
    return keys.withColumn("weight", F.lit(1).cast("long"))


def _cut(p: float, row_id: str, seed: int) -> str:
    return f"{q.wide_hash(row_id, seed)} < {sm.bernoulli_cut(p)}"


ORDERS = "(SELECT o_custkey AS key, o_orderkey, 1::BIGINT AS weight FROM orders)"
CUSTOMERS = "(SELECT c_custkey AS key, c_custkey AS id, 1::BIGINT AS weight FROM customer)"

reg.add(
    "bernoulli_sample",
    lambda s, d: sm.bernoulli_sample(table(s, d, "events").select("event_id", "user_id"), P, "event_id", SEED),
    f"SELECT event_id, user_id FROM events WHERE {_cut(P, 'event_id', SEED)}",
)
for _name, _size in (("sample_without_replacement", SIZE), ("sample_without_replacement_large", 4 * SIZE)):
    reg.add(
        _name,
        lambda s, d, size=_size: sm.sample_without_replacement(
            table(s, d, "events").select("event_id", "user_id"), size, "event_id", SEED
        ),
        f"SELECT event_id, user_id FROM events ORDER BY {q.row_hash('event_id', SEED)}, event_id LIMIT {_size}",
    )


def _pick_sql(draw: str, total: str, seed: int) -> str:
    return f"({q.wide_hash(draw, seed)} % {total})"


def draws(s, d):
    """One draw per order."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias("draw"))


_draws = "(SELECT o_orderkey AS draw FROM orders)"
reg.add(
    "sample_with_replacement",
    lambda s, d: sm.sample_with_replacement(
        table(s, d, "events").select("event_id", "user_id"), draws(s, d), SEED, index="event_id"
    ),
    "SELECT draw, event_id, user_id FROM (SELECT draw, "
    f"{_pick_sql('draw', '(SELECT COUNT(*) FROM events)', SEED)} AS pick FROM {_draws}) "
    "JOIN events ON pick = event_id",
)
reg.add(
    "sample_with_replacement_by_id",
    lambda s, d: sm.sample_with_replacement(
        table(s, d, "events").select("event_id", "user_id"), draws(s, d), SEED, row_id="event_id"
    ),
    "SELECT draw, event_id, user_id FROM (SELECT draw, "
    f"{_pick_sql('draw', '(SELECT COUNT(*) FROM events)', SEED)} AS pick FROM {_draws}) JOIN (SELECT "
    f"event_id, user_id, {q.row_index('event_id', SEED)} AS i FROM events) ON pick = i",
)
reg.add(
    "row_index",
    lambda s, d: sm.row_index(table(s, d, "events").select("event_id"), "event_id", SEED),
    f"SELECT event_id, {q.row_index('event_id', SEED)} AS \"index\" FROM events",
)
reg.add(
    "sample_join_size_bernoulli",
    lambda s, d: sm.sample_join_size_bernoulli(
        orders(s, d), customer_rows(s, d), P, Q, "o_orderkey", "id", SEED
    ),
    f"SELECT (1 / {P}::DOUBLE) * (1 / {Q}::DOUBLE) * COUNT(*)::DOUBLE AS estimate FROM (SELECT * FROM "
    f"{ORDERS} WHERE {_cut(P, 'o_orderkey', SEED)}) a JOIN (SELECT * FROM {CUSTOMERS} WHERE "
    f"{_cut(Q, 'id', SEED + 1)}) b USING (key)",
)
_scaled = (
    "SELECT ((SELECT COUNT(*) FROM orders)::DOUBLE / (SELECT COUNT(*) FROM a)) * ((SELECT COUNT(*) FROM "
    "customer)::DOUBLE / (SELECT COUNT(*) FROM b)) * COUNT(*)::DOUBLE AS estimate FROM a JOIN b USING (key)"
)


def _wor_sql(source: str, row_id: str, n: int, seed: int) -> str:
    return f"(SELECT * FROM {source} ORDER BY {q.row_hash(row_id, seed)}, {row_id} LIMIT {n})"


@reg.query(
    "sample_join_size_without_replacement",
    f"WITH a AS {_wor_sql(ORDERS, 'o_orderkey', SIZE, SEED)}, b AS "
    f"{_wor_sql(CUSTOMERS, 'id', 500, SEED)} {_scaled}",
)
def _wor_join(s, d):
    left, right = orders(s, d), customer_rows(s, d)
    a = sm.sample_without_replacement(left, SIZE, "o_orderkey", SEED)
    b = sm.sample_without_replacement(right, 500, "id", SEED)
    return sm.sample_join_size_fixed(left, right, a, b)


def _wr_sql(source: str, row_id: str, total: str, rows: str, seed: int) -> str:
    return (
        f"(SELECT key FROM (SELECT {_pick_sql('draw', f'(SELECT COUNT(*) FROM {total})', seed)} AS pick "
        f"FROM {rows}) JOIN {source} ON pick = {row_id})"
    )


@reg.query(
    "sample_join_size_with_replacement",
    f"WITH a AS {_wr_sql(ORDERS, 'o_orderkey', 'orders', _draws, SEED)}, b AS "
    f"{_wr_sql(CUSTOMERS, 'id', 'customer', _draws, SEED + 1)} {_scaled}",
)
def _wr_join(s, d):
    left, right = orders(s, d), customer_rows(s, d)
    a = sm.sample_with_replacement(left, draws(s, d), SEED, index="o_orderkey")
    b = sm.sample_with_replacement(right, draws(s, d), SEED + 1, index="id")
    return sm.sample_join_size_fixed(left, right, a, b)


@reg.query(
    "scale_estimate",
    "SELECT c_custkey AS key, (1 / 0.3::DOUBLE) * (1 / 0.5::DOUBLE) * n::DOUBLE AS bernoulli, "
    "((SELECT COUNT(*) FROM orders)::DOUBLE / 500) * ((SELECT COUNT(*) FROM customer)::DOUBLE / 100) * "
    "n::DOUBLE AS fixed_size FROM (SELECT o_custkey AS c_custkey, COUNT(*) AS n FROM orders GROUP BY 1)",
)
def _scale(s, d):
    counts = orders(s, d).groupBy("key").agg(F.sum("weight").cast("double").alias("n"))
    totals = [table(s, d, t).agg(F.count(F.lit(1)).alias("n")).scalar() for t in ("orders", "customer")]
    return counts.select(
        "key",
        sm.scale_bernoulli(F.col("n"), P, Q).alias("bernoulli"),
        sm.scale_sizes(F.col("n"), totals[0], 500, totals[1], 100).alias("fixed_size"),
    )


def _over_runs(s, d):
    """(run, full_est, sampled_est): Fast-AGMS on the whole streams and on their samples."""
    left, right = orders(s, d), customer_rows(s, d)
    full = j.fast_agms_join_size(
        *(j.fast_agms_build(x.select("key", "weight"), RUN_SEEDS, BUCKETS) for x in (left, right)), RUN_SEEDS
    ).withColumnRenamed("estimate", "full_est")

    def sampled(df, p, row_id, seed):
        """The cells of each run, from its own sample and seeds only."""
        rows = sm.bernoulli_samples(df, p, row_id, RUNS, seed, "run").select("run", "key", "weight")
        return j.fast_agms_build(rows, RUN_SEEDS, BUCKETS, own_run=True)

    est = j.fast_agms_join_size(
        sampled(left, P, "o_orderkey", SEED), sampled(right, Q, "id", SEED + RUNS), RUN_SEEDS
    )
    scaled = sm.scale_bernoulli(F.col("estimate"), P, Q).alias("sampled_est")
    return full.join(est.select("run", scaled), "run")


def _run_cells(source: str, seed: int | None = None, p: float = 1.0, row_id: str = "") -> str:
    where = (
        "WHERE "
        + " OR ".join(f"(s.run = {r} AND {_cut(p, row_id, seed + r)})" for r in range(RUNS))
        if seed is not None
        else ""
    )
    return (
        f'(SELECT s.run, s."row", {q.bucket(BUCKETS)} AS bucket, SUM({q.sign(q.four("s.sa", "s.sb", "s.sc", "s.sd", "x"))}'
        f" * weight)::BIGINT AS v FROM (SELECT *, {q.fold('key')} AS x FROM {source}), "
        f"{RUN_SEEDS.values_sql()} {where} GROUP BY ALL)"
    )


def _run_est(a: str, b: str) -> str:
    return (
        "(SELECT run, MEDIAN(COALESCE(dot, 0)::DOUBLE) AS est FROM (SELECT run, \"row\" FROM "
        f'{RUN_SEEDS.values_sql()}) LEFT JOIN (SELECT run, "row", SUM(a.v * b.v) AS dot FROM {a} a JOIN {b} b '
        'USING (run, "row", bucket) GROUP BY ALL) USING (run, "row") GROUP BY run)'
    )


reg.add(
    "sketch_over_sample",
    _over_runs,
    "SELECT f.run, f.est AS full_est, (1 / 0.3::DOUBLE) * (1 / 0.5::DOUBLE) * g.est AS sampled_est FROM "
    f"{_run_est(_run_cells(ORDERS), _run_cells(CUSTOMERS))} f JOIN "
    f"{_run_est(_run_cells(ORDERS, SEED, P, 'o_orderkey'), _run_cells(CUSTOMERS, SEED + RUNS, Q, 'id'))} g "
    "ON f.run = g.run",
)

# --- intervals -------------------------------------------------------------------------

A, B, C, D = draw_seeds(4, 41)
I0, I1, I2 = draw_seeds(3, 42)
# Seeds without low bits, so that the sums over blocks do not all cancel out.
BCH_SEED = I1 & ~7
EH_SEED = I1
RM7 = draw_seeds(32, 43, bits=32)
_each = (
    f"SELECT lo, hi, COALESCE(SUM({{xi}}), 0)::BIGINT AS total FROM (SELECT lo, hi, unnest(generate_series("
    f"lo, hi)) AS j FROM (SELECT DISTINCT lo, hi FROM {INTERVALS})) GROUP BY lo, hi"
)


def _parity(bits: str) -> str:
    return q.sign(f"bit_count(({bits})::BIGINT)::BIGINT + {I0}")


_bch5 = _parity(f"xor({I1} & j, {I2} & ((j::HUGEINT * j * j % 4294967296)::BIGINT))")
_eh3 = _parity(f"xor({EH_SEED} & j, j & ((j << 1) & {q.ODD}))")
for _name, _xi, _sql in (
    ("interval_sum_cw2", lambda x: h.cw2(A, B, x), q.sign(q.h31(A, B, "j"))),
    ("interval_sum_cw4", lambda x: h.cw4(A, B, C, D, x), q.sign(q.four(A, B, C, D, "j"))),
    ("interval_sum_bch5", lambda x: h.bch5(I0, I1, I2, x), _bch5),
):
    reg.add(
        _name,
        lambda s, d, xi=_xi: iv.interval_sum(intervals(s, d), xi),
        _each.format(xi=_sql),
    )
reg.add(
    "interval_sum_bch3",
    lambda s, d: iv.interval_sum_bch3(intervals(s, d), KEY_BITS, I0, BCH_SEED),
    _each.format(xi=_parity(f"{BCH_SEED} & j")),
)
reg.add(
    "interval_sum_eh3",
    lambda s, d: iv.interval_sum_eh3(intervals(s, d), KEY_BITS, I0, EH_SEED),
    _each.format(xi=_eh3),
)
_rm7 = q.sign(
    f"{I0} + "
    + " + ".join(
        f"((j >> {i}) & 1) * bit_count(({seed} & j & ~{2**i - 1})::BIGINT)" for i, seed in enumerate(RM7)
    )
)


reg.add(
    "interval_sum_rm7",
    lambda s, d: iv.interval_sum_rm7(intervals(s, d), KEY_BITS, I0, list(RM7)),
    _each.format(xi=_rm7),
)
#: Wide intervals: from 0 up to a place near 2^29 at which the table's own intervals lie.
FAR = 1 << 29


@reg.query("interval_sum_rm7_wide", _each.format(xi=re.sub(r"\bj\b", f"(j + {FAR})", _rm7)))
def _rm7_wide(s, d):
    """Each interval, moved up by 2^29, as the difference of two intervals of that width."""
    own = intervals(s, d).distinct().where("hi >= lo")
    ends = own.select((F.col("hi") + FAR).alias("hi")).union(own.select(F.col("lo") + FAR - 1)).distinct()
    wide = iv.interval_sum_rm7(ends.select(F.lit(0).cast("long").alias("lo"), "hi"), 30, I0, list(RM7))
    high = wide.select((F.col("hi") - FAR).alias("hi"), F.col("total").alias("upto"))
    low = wide.select((F.col("hi") - FAR + 1).alias("lo"), F.col("total").alias("before"))
    return own.join(high, "hi").join(low, "lo").select(
        "lo", "hi", (F.col("upto") - F.col("before")).alias("total")
    )


def _cover_sql(bits: int, source: str, extra: str = "") -> str:
    """The blocks of each interval, level by level."""
    return (
        f"(SELECT lo, hi{extra}, level, unnest(list_filter([CASE WHEN f < e AND f & 1 = 1 THEN f END, CASE WHEN "
        "f < e AND e & 1 = 1 THEN e - 1 END], lambda b : b IS NOT NULL)) AS block FROM (SELECT *, (lo + (1::BIGINT "
        "<< level) - 1) >> level AS f, (hi + 1) >> level AS e FROM "
        f"{source}, (SELECT unnest(range(0, {bits + 1}))::INTEGER AS level)))"
    )


_node = f"({1 << (KEY_BITS + 1)} - (1::BIGINT << ({KEY_BITS + 1} - level)) + block)"
_distinct = f"(SELECT DISTINCT lo, hi FROM {INTERVALS})"


reg.add(
    "dyadic_cover",
    lambda s, d: iv.dyadic_cover(intervals(s, d).distinct(), KEY_BITS),
    f"SELECT lo, hi, level, block FROM {_cover_sql(KEY_BITS, _distinct)}",
)
for _name, _xi, _sql in (
    ("dyadic_interval_sum_eh3", lambda x: h.eh3(I0, EH_SEED, x), _eh3),
    ("dyadic_interval_sum_bch5", lambda x: h.bch5(I0, I1, I2, x), _bch5),
    ("dyadic_interval_sum_cw4", lambda x: h.cw4(A, B, C, D, x), q.sign(q.four(A, B, C, D, "j"))),
):
    reg.add(
        _name,
        lambda s, d, xi=_xi: iv.dyadic_interval_sum(intervals(s, d), KEY_BITS, xi),
        f"SELECT lo, hi, SUM({_sql})::BIGINT AS total FROM (SELECT lo, hi, {_node} AS j FROM "
        f"{_cover_sql(KEY_BITS, _distinct)}) GROUP BY lo, hi",
    )
reg.add(
    "dyadic_point_value",
    lambda s, d: iv.dyadic_point_value(supp(s, d), KEY_BITS, lambda x: h.eh3(I0, EH_SEED, x)),
    f"SELECT key, SUM({_eh3})::BIGINT AS total FROM (SELECT key, {_node} AS j FROM (SELECT key, level, key >> "
    f"level AS block FROM (SELECT DISTINCT l_suppkey AS key FROM lineitem), (SELECT unnest(range(0, "
    f"{KEY_BITS + 1}))::INTEGER AS level))) GROUP BY key",
)
_point_nodes = (
    f"(SELECT {_node} AS key, weight FROM (SELECT level, key >> level AS block, cnt AS weight FROM {q.hist(SUPP)}, "
    f"(SELECT unnest(range(0, {KEY_BITS + 1}))::INTEGER AS level)))"
)
_interval_nodes = (
    f"(SELECT {_node} AS key, n AS weight FROM "
    + _cover_sql(KEY_BITS, f"(SELECT lo, hi, COUNT(*) AS n FROM {INTERVALS} GROUP BY 1, 2)", ", n")
    + ")"
)
reg.add(
    "interval_sketch_join_size",
    lambda s, d: iv.interval_sketch_join_size(
        supp(s, d), intervals(s, d), KEY_BITS, SEEDS, BUCKETS
    ),
    'SELECT MEDIAN(dot) AS estimate FROM (SELECT "row", SUM(a.v::HUGEINT * b.v)::DOUBLE AS dot FROM '
    f"{q.sketch(_point_nodes, SEEDS, BUCKETS, signed=True)} a JOIN "
    f'{q.sketch(_interval_nodes, SEEDS, BUCKETS, signed=True)} b USING ("row", bucket) GROUP BY "row")',
)
