"""Queries for the hash families, the linear sketches and the join-size estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from keytally.functions import hashing as h
from keytally.functions.seeds import draw_seeds, seed_table
from keytally.operators import join_size as j
from keytally.operators import linear
from keytally.plans import sqltext as q
from keytally.plans.registry import Registry
from keytally.sources.key_streams import key_stream, table, token_stream

reg = Registry()

SEEDS = seed_table(rows=4)
BUCKETS = 64
WIDE = 512
JOIN_SEEDS = seed_table(rows=5, seed=7)
JOIN_BUCKETS = 128
AGMS_SEEDS = seed_table(rows=5, cols=12, seed=11)
RUNS = 10
RUN_SEEDS = seed_table(rows=5, runs=RUNS, seed=13)
RUN_AGMS_SEEDS = seed_table(rows=3, cols=8, runs=RUNS, seed=17)
PARTS = 4
SLACK = 5

SUPP = q.stream("lineitem", "l_suppkey")
PART = q.stream("lineitem", "l_partkey")
PARTED = q.stream("lineitem", "l_partkey", extra="l_orderkey % 4 AS part")
CUST = q.stream("orders", "o_custkey")
CUST2 = q.stream("customer", "c_custkey")
PROBES = "(SELECT p_partkey AS key FROM part)"


def parts(s, d):
    return key_stream(s, d, "lineitem", "l_partkey")


def parted(s, d):
    part = F.expr(f"l_orderkey % {PARTS}").alias("part")
    return key_stream(s, d, "lineitem", "l_partkey", extra=(part,))


def probes(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("key"))


def supp(s, d):
    return key_stream(s, d, "lineitem", "l_suppkey")


def cust(s, d):
    return key_stream(s, d, "orders", "o_custkey")


def cust2(s, d):
    return key_stream(s, d, "customer", "c_custkey")


# --- hash families ---------------------------------------------------------------------

A, B, C, D = draw_seeds(4, 31)
I0, I1, I2 = draw_seeds(3, 32, bits=32)
RM7 = draw_seeds(32, 33, bits=32)
KEY = q.fold("l_partkey")
_cube = f"((((j * j) & {q.M32}) * j) & {q.M32})"


def _hash_query(name: str, make, sql: str) -> None:
    reg.add(
        name,
        lambda s, d: table(s, d, "lineitem").select("l_partkey").distinct().select(
            "l_partkey", make(h.fold31("l_partkey")).alias("value")
        ),
        f"SELECT l_partkey, ({sql})::BIGINT AS value FROM "
        f"(SELECT DISTINCT l_partkey, {KEY} AS j FROM lineitem)",
    )


def _parity(bits: str) -> str:
    return q.sign(f"bit_count(({bits})::BIGINT)::BIGINT + {I0}")


_hash_query("hash31", lambda x: h.hash31(A, B, x), q.h31(A, B, "j"))
_hash_query("fourwise", lambda x: h.fourwise(A, B, C, D, x), q.four(A, B, C, D, "j"))
_hash_query("cw2b", lambda x: h.cw2b(A, B, x, 97), f"{q.h31(A, B, 'j')} % 97")
_hash_query("cw4b", lambda x: h.cw4b(A, B, C, D, x, 97), f"{q.four(A, B, C, D, 'j')} % 97")
_hash_query("cw2", lambda x: h.cw2(A, B, x), q.sign(q.h31(A, B, "j")))
_hash_query("cw4", lambda x: h.cw4(A, B, C, D, x), q.sign(q.four(A, B, C, D, "j")))
_hash_query("bch3", lambda x: h.bch3(I0, I1, x), _parity(f"{I1} & j"))
_hash_query(
    "eh3",
    lambda x: h.eh3(I0, I1, x),
    _parity(f"xor({I1} & j, j & ((j << 1) & {q.ODD}))"),
)
_hash_query(
    "bch5",
    lambda x: h.bch5(I0, I1, I2, x),
    _parity(f"xor({I1} & j, {I2} & (((j::HUGEINT * j * j) % 4294967296)::BIGINT))"),
)
_rm7_bits = " + ".join(
    f"((j >> {i}) & 1) * bit_count(({seed} & j & ~{2**i - 1})::BIGINT)"
    for i, seed in enumerate(RM7)
)
_hash_query(
    "rm7",
    lambda x: h.rm7(I0, F.array(*[F.lit(v).cast("long") for v in RM7]), x),
    q.sign(f"{I0} + {_rm7_bits}"),
)
_hash_query("owner_of", lambda x: h.owner_of(x, 6), "(j & 511) % 6")
reg.add(
    "key_to_int",
    lambda s, d: token_stream(s, d).select("key").distinct().select(
        "key", h.key_to_int("key").alias("value")
    ),
    "SELECT key, ('0x' || substr(md5(key), 1, 7))::BIGINT AS value FROM "
    f"(SELECT DISTINCT key FROM {q.TOKENS})",
)
reg.add(
    "seed_table",
    lambda s, d: SEEDS.attach(supp(s, d), only=("row", "ha", "hb")).groupBy("row", "ha", "hb").agg(
        F.sum("weight").alias("n")
    ),
    f'SELECT s."row", s.ha::BIGINT AS ha, s.hb::BIGINT AS hb, SUM(weight)::BIGINT AS n '
    f"FROM {SUPP}, {SEEDS.values_sql()} GROUP BY ALL",
)

# --- Count-Min -------------------------------------------------------------------------

reg.add(
    "count_min_build",
    lambda s, d: linear.count_min_build(parts(s, d), SEEDS, BUCKETS),
    f'SELECT "row", bucket, v FROM {q.sketch(PART, SEEDS, BUCKETS)}',
)
reg.add(
    "count_min_build_tokens",
    lambda s, d: linear.count_min_build(
        token_stream(s, d), SEEDS, WIDE, code=h.key_to_int("key"), preaggregate=True
    ),
    'SELECT "row", bucket, v FROM '
    + q.sketch(
        q.TOKENS, SEEDS, WIDE, x=q.fold("('0x' || substr(md5(key), 1, 7))")
    ),
)
reg.add(
    "count_min_query",
    lambda s, d: linear.count_min_query(
        linear.count_min_build(parts(s, d), SEEDS, BUCKETS), probes(s, d), SEEDS, BUCKETS
    ),
    f"SELECT key, est FROM {q.count_min_est(q.sketch(PART, SEEDS, BUCKETS), PROBES, SEEDS, BUCKETS)}",
)
reg.add(
    "count_min_query_joined",
    lambda s, d: linear.count_min_query(
        linear.count_min_build(parts(s, d), SEEDS, BUCKETS),
        probes(s, d),
        SEEDS,
        BUCKETS,
    ),
    f"SELECT key, est FROM {q.count_min_est(q.sketch(PART, SEEDS, BUCKETS), PROBES, SEEDS, BUCKETS)}",
)
RUN_SEEDS = seed_table(rows=3, runs=4, seed=47)
_run_cells = q.sketch(PART, RUN_SEEDS, BUCKETS, ids='run, "row"')
reg.add(
    "count_min_query_by_run",
    lambda s, d: linear.count_min_query(
        linear.count_min_build(parts(s, d), RUN_SEEDS, BUCKETS), probes(s, d), RUN_SEEDS, BUCKETS
    ),
    f'SELECT key, run, MIN(v)::BIGINT AS est FROM (SELECT key, s.run, s."row", {q.bucket(BUCKETS)} AS bucket '
    f"FROM (SELECT *, {q.fold('key')} AS x FROM {PROBES}), {RUN_SEEDS.values_sql()}) "
    f'JOIN {_run_cells} USING (run, "row", bucket) GROUP BY key, run',
)
reg.add(
    "update_and_query",
    lambda s, d: linear.update_and_query(
        key_stream(s, d, "events", "user_id", extra=("event_id",)), SEEDS, BUCKETS, "event_id", 1024
    ),
    "SELECT event_id, key, MIN(running)::BIGINT AS est FROM (SELECT event_id, key, SUM(weight) "
    'OVER (PARTITION BY "row", bucket ORDER BY event_id) AS running FROM (SELECT event_id, key, '
    f's."row", {q.bucket(BUCKETS)} AS bucket, 1::BIGINT AS weight FROM (SELECT event_id, user_id AS '
    f"key, {q.fold('user_id')} AS x FROM events), {SEEDS.values_sql()})) GROUP BY event_id, key",
)
reg.add(
    "count_min_merge",
    lambda s, d: linear.merge_cells(
        linear.count_min_build(cust(s, d), SEEDS, BUCKETS),
        linear.count_min_build(cust2(s, d), SEEDS, BUCKETS),
    ),
    f'SELECT "row", bucket, v FROM '
    f"{q.sketch(f'(FROM {CUST} UNION ALL FROM {CUST2})', SEEDS, BUCKETS)}",
)
_per_part = (
    "(SELECT part, key, CASE WHEN COUNT(v) = 4 THEN MIN(v) ELSE 0 END AS est FROM "
    f'{q.cells_of(PROBES, SEEDS, BUCKETS)} JOIN {{cells}} USING ("row", bucket) GROUP BY part, key)'
)
reg.add(
    "count_min_local_copies",
    lambda s, d: linear.local_copies_query(parted(s, d), probes(s, d), SEEDS, BUCKETS, "part"),
    f"SELECT key, COALESCE(SUM(est), 0)::BIGINT AS est FROM {PROBES} LEFT JOIN "
    + _per_part.format(cells=q.sketch(PARTED, SEEDS, BUCKETS, by="part"))
    + " USING (key) GROUP BY key",
)
_owned = q.sketch(
    q.stream("lineitem", "l_partkey", extra="(l_partkey & 511) % 4 AS owner"),
    SEEDS,
    BUCKETS,
    by="owner",
)
_owned_probes = "(SELECT p_partkey AS key, (p_partkey & 511) % 4 AS owner FROM part)"
reg.add(
    "count_min_owner_partitioned",
    lambda s, d: linear.owner_partitioned_query(
        parts(s, d), probes(s, d), SEEDS, BUCKETS, h.owner_of("key", PARTS)
    ),
    "SELECT key, MIN(COALESCE(v, 0))::BIGINT AS est FROM "
    f"{q.cells_of(_owned_probes, SEEDS, BUCKETS, 'key, owner')} LEFT JOIN {_owned} "
    'USING (owner, "row", bucket) GROUP BY key',
)
_flushed = (
    f'(SELECT "row", bucket, SUM(v - v % {SLACK})::BIGINT AS v FROM '
    f"{q.sketch(PARTED, SEEDS, BUCKETS, by='part')} GROUP BY ALL)"
)
reg.add(
    "count_min_hybrid",
    lambda s, d: linear.hybrid_query(
        parted(s, d), probes(s, d), SEEDS, BUCKETS, "part", PARTS, SLACK
    ),
    f"SELECT key, est + {(SLACK - 1) * PARTS} AS est FROM "
    f"{q.count_min_est(_flushed, PROBES, SEEDS, BUCKETS)}",
)
_ph = q.hist(PARTED, "part")
_augmented = (
    f"WITH h AS {_ph}, ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY cnt "
    "DESC, key) AS n FROM h), hot AS (SELECT part, key, cnt FROM ranked WHERE n <= 16), cold AS "
    "(SELECT part, key, cnt AS weight FROM ranked WHERE n > 16) "
)
reg.add(
    "augmented_sketch",
    lambda s, d: linear.augmented_query(parted(s, d), probes(s, d), SEEDS, BUCKETS, "part"),
    _augmented
    + "SELECT key, COALESCE(SUM(COALESCE(cnt, est)), 0)::BIGINT AS est FROM "
    + f"{PROBES} LEFT JOIN (SELECT part, key, cnt, est FROM "
    + _per_part.format(cells=q.sketch("cold", SEEDS, BUCKETS, by="part"))
    + " FULL JOIN hot USING (part, key)) USING (key) GROUP BY key",
)
_slacked = f"(SELECT key, cnt - cnt % {SLACK} AS weight FROM {_ph})"
reg.add(
    "slack_filter",
    lambda s, d: linear.slack_filter_query(
        parted(s, d), probes(s, d), SEEDS, BUCKETS, "part", PARTS, SLACK
    ),
    f"SELECT key, est + {(SLACK - 1) * PARTS} AS est FROM "
    f"{q.count_min_est(q.sketch(_slacked, SEEDS, BUCKETS), PROBES, SEEDS, BUCKETS)}",
)


@reg.query(
    "delegated_point_query",
    "WITH h AS (SELECT (l_partkey & 511) % 4 AS owner, l_partkey AS key, COUNT(*) AS cnt FROM "
    "lineitem WHERE l_linenumber < 7 GROUP BY ALL), ranked AS (SELECT *, row_number() OVER "
    "(PARTITION BY owner ORDER BY cnt DESC, key) AS n FROM h), cold AS (SELECT owner, key, cnt AS "
    "weight FROM ranked WHERE n > 16), waiting AS (SELECT l_partkey AS key, COUNT(*) AS w FROM "
    "lineitem WHERE l_linenumber >= 7 GROUP BY 1), found AS (SELECT owner, key, MIN(COALESCE(v, 0)) "
    f"AS est FROM {q.cells_of(_owned_probes, SEEDS, BUCKETS, 'key, owner')} LEFT JOIN "
    f"{q.sketch('cold', SEEDS, BUCKETS, by='owner')} USING (owner, \"row\", bucket) "
    "GROUP BY owner, key) SELECT key, (COALESCE(cnt, est) + COALESCE(w, 0))::BIGINT AS est FROM found "
    "LEFT JOIN (SELECT owner, key, cnt FROM ranked WHERE n <= 16) USING (owner, key) "
    "LEFT JOIN waiting USING (key)",
)
def _delegated(s, d):
    line = table(s, d, "lineitem")
    rows = line.select(F.col("l_partkey").alias("key"), F.lit(1).cast("long").alias("weight"), "l_linenumber")
    return linear.delegated_query(
        rows.where("l_linenumber < 7").drop("l_linenumber"),
        rows.where("l_linenumber >= 7").drop("l_linenumber"),
        probes(s, d),
        SEEDS,
        BUCKETS,
        h.owner_of("key", PARTS),
    )


reg.add(
    "batched_point_queries",
    lambda s, d: linear.batched_point_queries(
        linear.count_min_build(cust(s, d), SEEDS, BUCKETS),
        table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")),
        SEEDS,
        BUCKETS,
    ),
    "SELECT o_orderkey, key, est FROM (SELECT o_orderkey, o_custkey AS key FROM orders) JOIN "
    + q.count_min_est(
        q.sketch(CUST, SEEDS, BUCKETS), "(SELECT DISTINCT o_custkey AS key FROM orders)", SEEDS, BUCKETS
    )
    + " USING (key)",
)


def _big_endian(column: str, start: int, size: int):
    return F.conv(F.hex(F.substring(column, start, size)), 16, 10).cast("long")


@reg.query(
    "count_min_built_in",
    "SELECT COUNT(*) AS total, ceil(-ln(1 - 0.95::DOUBLE) / ln(2))::BIGINT AS depth, "
    "ceil(2 / 0.01::DOUBLE)::BIGINT AS width FROM lineitem",
)
def _built_in(s, d):
    """What the header of the sketch says: after its version, the total, the depth and the width."""
    sketch = linear.built_in_count_min(parts(s, d), 0.01, 0.95, 42)
    return sketch.select(
        _big_endian("sketch", 5, 8).alias("total"),
        _big_endian("sketch", 13, 4).alias("depth"),
        _big_endian("sketch", 17, 4).alias("width"),
    )


# --- join sizes ------------------------------------------------------------------------


def _agms_sql(source: str, seeds, ids: str = '"row"') -> str:
    pick = ", ".join(f"s.{i.strip()}" for i in f"{ids}, col".split(","))
    return (
        f"(SELECT {pick}, SUM({q.sign(q.four('s.sa', 's.sb', 's.sc', 's.sd', 'x'))} * weight)"
        f"::BIGINT AS v FROM (SELECT *, {q.fold('key')} AS x FROM {source}), "
        f"{seeds.values_sql()} GROUP BY ALL)"
    )


def _dots(a: str, b: str, seeds, ids: str = '"row"', cell: str = "bucket") -> str:
    return (
        f"(SELECT {ids}, COALESCE(dot, 0)::DOUBLE AS dot FROM (SELECT DISTINCT {ids} FROM "
        f"{seeds.values_sql()}) LEFT JOIN (SELECT {ids}, SUM(a.v::HUGEINT * b.v) AS dot FROM {a} a JOIN "
        f"{b} b USING ({ids}, {cell}) GROUP BY ALL) USING ({ids}))"
    )


def _fast_count_sql(a: str, b: str, dots: str, buckets: int, ids: str = '"row"', by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {lead}SUM(value)::DOUBLE / (COUNT(*) * {buckets - 1})::DOUBLE AS estimate FROM "
        f"(SELECT {ids}, {buckets} * dot::HUGEINT - l1 * l2 AS value FROM {dots} JOIN (SELECT {ids}, "
        f"SUM(v) AS l1 FROM {a} GROUP BY ALL) USING ({ids}) JOIN (SELECT {ids}, SUM(v) AS l2 FROM {b} "
        f"GROUP BY ALL) USING ({ids})){group}"
    )


_FA = [q.sketch(x, JOIN_SEEDS, JOIN_BUCKETS, signed=True) for x in (CUST, CUST2)]
_CM = [q.sketch(x, JOIN_SEEDS, JOIN_BUCKETS) for x in (CUST, CUST2)]
_AG = [_agms_sql(x, AGMS_SEEDS) for x in (CUST, CUST2)]


def fast(s, d):
    return [j.fast_agms_build(x, JOIN_SEEDS, JOIN_BUCKETS) for x in (cust(s, d), cust2(s, d))]


def plain(s, d):
    return [j.fast_count_build(x, JOIN_SEEDS, JOIN_BUCKETS) for x in (cust(s, d), cust2(s, d))]


def agms(s, d):
    return [j.agms_build(x, AGMS_SEEDS) for x in (cust(s, d), cust2(s, d))]


reg.add(
    "agms_build",
    lambda s, d: agms(s, d)[0],
    f'SELECT "row", col, v FROM {_AG[0]}',
)
_agms_median = "SELECT MEDIAN(dot / 12) AS estimate FROM "
reg.add(
    "agms_join_size",
    lambda s, d: j.agms_join_size(*agms(s, d), AGMS_SEEDS),
    _agms_median + _dots(*_AG, AGMS_SEEDS, cell="col"),
)
reg.add(
    "agms_self_join_size",
    lambda s, d: j.agms_self_join_size(agms(s, d)[0], AGMS_SEEDS),
    _agms_median + _dots(_AG[0], _AG[0], AGMS_SEEDS, cell="col"),
)
reg.add(
    "fast_agms_build",
    lambda s, d: fast(s, d)[0],
    f'SELECT "row", bucket, v FROM {_FA[0]}',
)
reg.add(
    "fast_agms_join_size",
    lambda s, d: j.fast_agms_join_size(*fast(s, d), JOIN_SEEDS),
    f"SELECT MEDIAN(dot) AS estimate FROM {_dots(*_FA, JOIN_SEEDS)}",
)
reg.add(
    "fast_agms_self_join_size",
    lambda s, d: j.fast_agms_self_join_size(fast(s, d)[0], JOIN_SEEDS),
    f"SELECT MEDIAN(dot) AS estimate FROM {_dots(_FA[0], _FA[0], JOIN_SEEDS)}",
)
reg.add(
    "fast_count_build",
    lambda s, d: plain(s, d)[1],
    f'SELECT "row", bucket, v FROM {_CM[1]}',
)
reg.add(
    "fast_count_join_size",
    lambda s, d: j.fast_count_join_size(*plain(s, d), JOIN_SEEDS, JOIN_BUCKETS),
    _fast_count_sql(*_CM, _dots(*_CM, JOIN_SEEDS), JOIN_BUCKETS),
)
reg.add(
    "fast_count_self_join_size",
    lambda s, d: j.fast_count_self_join_size(plain(s, d)[0], JOIN_SEEDS, JOIN_BUCKETS),
    _fast_count_sql(_CM[0], _CM[0], _dots(_CM[0], _CM[0], JOIN_SEEDS), JOIN_BUCKETS),
)
reg.add(
    "count_min_join_size",
    lambda s, d: j.count_min_join_size(*plain(s, d), JOIN_SEEDS),
    f"SELECT MIN(dot) AS estimate FROM {_dots(*_CM, JOIN_SEEDS)}",
)
reg.add(
    "count_min_self_join_size",
    lambda s, d: j.count_min_self_join_size(plain(s, d)[0], JOIN_SEEDS),
    f"SELECT MIN(dot) AS estimate FROM {_dots(_CM[0], _CM[0], JOIN_SEEDS)}",
)


def orders_per_customer(s, d):
    nations = table(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    counts = cust(s, d).groupBy("key").agg(F.sum("weight").alias("cnt"))
    return counts.join(nations, "key")


_PER = (
    "(SELECT c_nationkey, COUNT(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey "
    "GROUP BY o_custkey, c_nationkey)"
)
reg.add(
    "combine_average",
    lambda s, d: j.average(orders_per_customer(s, d), "cnt", ("c_nationkey",)),
    f"SELECT c_nationkey, SUM(cnt)::DOUBLE / COUNT(*) AS estimate FROM {_PER} GROUP BY 1",
)
reg.add(
    "combine_median",
    lambda s, d: j.median(orders_per_customer(s, d), "cnt", ("c_nationkey",)),
    f"SELECT c_nationkey, MEDIAN(cnt)::DOUBLE AS estimate FROM {_PER} GROUP BY 1",
)
reg.add(
    "combine_minimum",
    lambda s, d: j.minimum(orders_per_customer(s, d), "cnt", ("c_nationkey",)),
    f"SELECT c_nationkey, MIN(cnt) AS estimate FROM {_PER} GROUP BY 1",
)
reg.add(
    "kth_smallest",
    lambda s, d: j.kth_smallest(orders_per_customer(s, d), "cnt", 3, ("c_nationkey",)),
    "SELECT c_nationkey, cnt AS estimate FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey "
    f"ORDER BY cnt) AS n FROM {_PER}) WHERE n = 3",
)



@reg.query(
    "kth_smallest_median",
    "SELECT 'all' AS scope, l_extendedprice AS estimate FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice) "
    "AS n, COUNT(*) OVER () // 2 AS half FROM lineitem) WHERE n = half UNION ALL SELECT l_returnflag, l_extendedprice "
    "FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS n FROM lineitem) "
    "WHERE n = 1500",
)
def _kth_median(s, d):
    """The middle price of all lines, and the 1 500-th of each flag."""
    prices = table(s, d, "lineitem").select("l_returnflag", "l_extendedprice")
    half = j.kth_smallest(prices, "l_extendedprice", prices.count() // 2)
    each = j.kth_smallest(prices, "l_extendedprice", 1500, ("l_returnflag",))
    return half.select(F.lit("all").alias("scope"), "estimate").union(each)


_R = "run, \"row\""
_RF = [q.sketch(x, RUN_SEEDS, JOIN_BUCKETS, signed=True, ids=_R) for x in (CUST, CUST2)]
_RC = [q.sketch(x, RUN_SEEDS, JOIN_BUCKETS, ids=_R) for x in (CUST, CUST2)]
_RA = [_agms_sql(x, RUN_AGMS_SEEDS, ids=_R) for x in (CUST, CUST2)]
_cm_dots = _dots(*_RC, RUN_SEEDS, _R)
reg.add(
    "compare_join_estimators",
    lambda s, d: j.compare_join_estimators(
        cust(s, d), cust2(s, d), RUN_SEEDS, RUN_AGMS_SEEDS, JOIN_BUCKETS
    ),
    "SELECT run, (SELECT COUNT(*)::DOUBLE FROM orders JOIN customer ON o_custkey = c_custkey) AS truth, "
    "agms, fast_agms, fast_count, count_min FROM "
    f"(SELECT run, MEDIAN(dot / 8) AS agms FROM {_dots(*_RA, RUN_AGMS_SEEDS, _R, 'col')} GROUP BY run) "
    f"JOIN (SELECT run, MEDIAN(dot) AS fast_agms FROM {_dots(*_RF, RUN_SEEDS, _R)} GROUP BY run) "
    "USING (run) JOIN (SELECT run, estimate AS fast_count FROM "
    f"({_fast_count_sql(*_RC, _cm_dots, JOIN_BUCKETS, _R, 'run')})) USING (run) "
    f"JOIN (SELECT run, MIN(dot) AS count_min FROM {_cm_dots} GROUP BY run) USING (run)",
)

BY_FLAG = q.stream("lineitem", "l_suppkey", extra="l_returnflag")
for _name, _signed in (("count_min_by_group", False), ("fast_agms_by_group", True)):
    reg.add(
        _name,
        lambda s, d, signed=_signed: linear.linear_sketch(
            key_stream(s, d, "lineitem", "l_suppkey", extra=("l_returnflag",)),
            SEEDS,
            BUCKETS,
            signed,
            by=("l_returnflag",),
        ),
        f'SELECT l_returnflag, "row", bucket, v FROM '
        f"{q.sketch(BY_FLAG, SEEDS, BUCKETS, signed=_signed, by='l_returnflag')}",
    )
