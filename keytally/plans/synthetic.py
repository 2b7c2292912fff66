"""Queries for the generators. The part table gives the domain and the lineitem table the mass,
so both grow with the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from keytally.plans import sqltext as q
from keytally.plans.registry import Registry
from keytally.sinks.sketch_store import stored
from keytally.sources import synthetic as g
from keytally.sources.key_streams import table
from keytally.sources.text_streams import read_key_stream_text, write_key_stream_text
from keytally.session import work_path

reg = Registry()

Z = 1.25
SEED = 3


def domain(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"))


def dom(s, d):
    return domain(s, d).agg(F.count(F.lit(1)).alias("n")).scalar()


def mass(s, d):
    return table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n")).scalar()


DOM = "(SELECT COUNT(*) FROM part)::DOUBLE"
MASS = "(SELECT COUNT(*) FROM lineitem)::DOUBLE"
H = f"(SELECT SUM(1 / pow(p_partkey + 1, {Z}::DOUBLE)) FROM part)"
ZIPF = (
    f"(SELECT p_partkey AS key, round_even({MASS} / (pow(p_partkey + 1, {Z}::DOUBLE) * {H}), 0)::BIGINT AS cnt "
    "FROM part)"
)
REVERSED = (
    f"(SELECT p_partkey AS key, round_even({MASS} / (pow({DOM} - p_partkey, {Z}::DOUBLE) * {H}), 0)::BIGINT AS "
    "cnt FROM part)"
)


def zipf(s, d):
    return g.freq_zipf(domain(s, d), dom(s, d), mass(s, d), Z)


reg.add(
    "freq_uniform",
    lambda s, d: g.freq_uniform(domain(s, d), dom(s, d), mass(s, d)),
    f"SELECT p_partkey AS key, round_even(GREATEST({DOM}, {MASS}) / {DOM}, 0)::BIGINT AS cnt FROM part",
)
reg.add(
    "freq_uniform_limited",
    lambda s, d: g.freq_uniform_limited(domain(s, d), dom(s, d), mass(s, d), 0.3),
    f"WITH n AS (SELECT round_even({DOM} * 0.3::DOUBLE, 0) AS n) SELECT p_partkey AS key, CASE WHEN p_partkey < n "
    f"THEN round_even(GREATEST(n, {MASS}) / n, 0) ELSE 0 END::BIGINT AS cnt FROM part, n",
)
UNIFORM = f"(SELECT p_partkey AS key, round_even(GREATEST({DOM}, {MASS}) / {DOM}, 0)::BIGINT AS cnt FROM part)"
LIMITED = (
    f"(SELECT p_partkey AS key, CASE WHEN p_partkey < n THEN round_even(GREATEST(n, {MASS}) / n, 0) ELSE 0 END::BIGINT "
    f"AS cnt FROM part, (SELECT round_even({DOM} * 0.3::DOUBLE, 0) AS n))"
)
reg.add("freq_zipf", zipf, f"SELECT key, cnt FROM {ZIPF}")
reg.add(
    "freq_zipf_shifted",
    lambda s, d: g.freq_zipf_shifted(domain(s, d), dom(s, d), mass(s, d), Z, 17.4),
    f"SELECT (key + 17) % (SELECT COUNT(*) FROM part) AS key, cnt FROM {ZIPF}",
)
reg.add(
    "freq_zipf_reversed",
    lambda s, d: g.freq_zipf_reversed(domain(s, d), dom(s, d), mass(s, d), Z),
    f"SELECT key, cnt FROM {REVERSED}",
)


def _permutation(seed: int, keys: str) -> str:
    return (
        f"(SELECT a.key, b.key AS new_key FROM (SELECT key, {q.row_index('key', seed + 1)} AS i FROM {keys}) a "
        f"JOIN (SELECT key, {q.row_index('key', seed + 2)} AS i FROM {keys}) b USING (i))"
    )


_all_keys = "(SELECT p_partkey AS key FROM part)"
_half_keys = (
    f"(SELECT p_partkey AS key FROM part WHERE {q.row_hash('p_partkey', SEED)} < {round(0.4 * 2**31)})"
)
reg.add(
    "shuffle_frequencies",
    lambda s, d: g.shuffle_frequencies(zipf(s, d), SEED),
    f"SELECT new_key AS key, cnt FROM {ZIPF} JOIN {_permutation(SEED, _all_keys)} USING (key)",
)
reg.add(
    "shuffle_frequencies_paired",
    lambda s, d: g.shuffle_frequencies_paired(
        zipf(s, d), g.freq_zipf_reversed(domain(s, d), dom(s, d), mass(s, d), Z), SEED
    ),
    f"SELECT new_key AS key, f.cnt, g.cnt AS cnt2 FROM {ZIPF} f JOIN {REVERSED} g USING (key) JOIN "
    f"{_permutation(SEED, _all_keys)} USING (key)",
)
_turned = f"(SELECT (SELECT COUNT(*) FROM part) - 1 - key AS key, cnt FROM {ZIPF})"
reg.add(
    "decorrelate",
    lambda s, d: g.decorrelate(zipf(s, d), dom(s, d), -0.6, SEED),
    f"SELECT COALESCE(new_key, key) AS key, cnt FROM {_turned} LEFT JOIN {_permutation(SEED, _half_keys)} USING (key)",
)
for _kind, _param, _p, _sql in (
    ("zipf", Z, 1.0, ZIPF),
    ("zipf_reversed", Z, 1.0, REVERSED),
    ("uniform", 1.0, 1.0, UNIFORM),
    ("uniform_limited", 0.3, 1.0, LIMITED),
    ("zipf_shifted", Z, 17.4, f"(SELECT (key + 17) % (SELECT COUNT(*) FROM part) AS key, cnt FROM {ZIPF})"),
):
    reg.add(
        f"generate_relation_{_kind}",
        lambda s, d, kind=_kind, param=_param, p=_p: g.generate_relation(
            domain(s, d), dom(s, d), mass(s, d), kind, param, p, SEED
        ).groupBy("key").agg(F.sum("weight").alias("cnt")),
        f"SELECT key, cnt FROM {_sql} WHERE cnt > 0",
    )


reg.add(
    "generate_relation_decorrelated",
    lambda s, d: g.generate_relation(domain(s, d), dom(s, d), mass(s, d), "zipf", Z, -0.6, SEED)
    .groupBy("key")
    .agg(F.sum("weight").alias("cnt")),
    f"SELECT key, cnt FROM (SELECT COALESCE(new_key, key) AS key, cnt FROM {_turned} LEFT JOIN "
    f"{_permutation(SEED, _half_keys)} USING (key)) WHERE cnt > 0",
)


@reg.query(
    "generate_relation",
    f"SELECT key, 1::BIGINT AS weight FROM (SELECT key, unnest(range(0, cnt)) FROM {ZIPF})",
)
def _relation(s, d):
    return g.generate_relation(domain(s, d), dom(s, d), mass(s, d), "zipf", Z)


def sizes(s, d):
    return table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n")).unionByName(
        table(s, d, "orders").agg(F.count(F.lit(1)).alias("n"))
    )


_grid = (
    "WITH z AS (SELECT unnest(range(0, 11)) * 0.25::DOUBLE + 0.5::DOUBLE AS skew), h AS (SELECT skew, SUM(1 / "
    "pow(p_partkey + 1, skew)) AS h FROM part, z GROUP BY skew), n AS (SELECT COUNT(*) AS n FROM lineitem UNION "
    "SELECT COUNT(*) FROM orders) SELECT skew, n, p_partkey AS key, round_even(n / (pow(p_partkey + 1, skew) * "
    "h), 0)::BIGINT AS cnt FROM part, h, n"
)


@reg.query("generate_dataset_grid", f"SELECT * FROM ({_grid}) WHERE cnt > 0")
def _dataset_grid(s, d):
    """Generated, shuffled, written a folder per skew and size as text, and counted back."""
    rows = g.shuffled_stream(g.grid_frequencies(domain(s, d), sizes(s, d)), SEED)
    path = work_path(s, "grid")
    write_key_stream_text(rows.sortWithinPartitions("skew", "n", "order"), path, ("skew", "n"))
    return (
        s.read.schema("value string, skew double, n long").text(path)
        .groupBy("skew", "n", F.col("value").cast("long").alias("key"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


THETA = 0.8
_u = q.uniform("event_id", SEED)


def event_ids(s, d):
    return table(s, d, "events").select("event_id")


def _zipf_sql() -> str:
    """Rejection-inversion as SQL: all tries of a row, of which the first that succeeds counts."""
    power = f"{1 - THETA}::DOUBLE"

    def area(x: str) -> str:
        return f"((pow({x}, {power}) - 1) / {power})"

    def edge(y: str) -> str:
        return f"pow(1 + {power} * ({y}), {1 / (1 - THETA)}::DOUBLE)"

    def step(k: str) -> str:
        return f"pow({k}, {-THETA}::DOUBLE)"

    near = f"(2 - {edge(area('2.5::DOUBLE') + ' - ' + step('2::DOUBLE'))})"
    low, high = f"({area('1.5::DOUBLE')} - 1)", area(f"({DOM} + 0.5::DOUBLE)")
    heights = " UNION ALL ".join(
        f"SELECT event_id, {t} AS t, {q.uniform('event_id', SEED + t)} AS u FROM events"
        for t in range(g.ZIPF_TRIES)
    )
    return (
        f"WITH h AS (SELECT event_id, t, {high} + u * ({low} - {high}) AS y FROM ({heights})), "
        f"x AS (SELECT *, {edge('y')} AS x FROM h), "
        f"k AS (SELECT *, least(greatest(floor(x + 0.5::DOUBLE), 1), {DOM}) AS k FROM x) "
        f"SELECT event_id, arg_min(k, t)::BIGINT AS draw FROM k WHERE k - x <= {near} "
        f"OR y >= {area('(k + 0.5::DOUBLE)')} - {step('k')} GROUP BY event_id"
    )


reg.add(
    "zipf_draws",
    lambda s, d: g.zipf_draws(event_ids(s, d), "event_id", dom(s, d), THETA, SEED),
    _zipf_sql(),
)
reg.add(
    "zipf_draws_by_table",
    lambda s, d: g.zipf_draws_by_table(event_ids(s, d), "event_id", domain(s, d), Z, SEED),
    f"WITH c AS (SELECT p_partkey AS id, SUM(1 / pow(p_partkey + 1, {Z}::DOUBLE)) OVER (ORDER BY p_partkey) / {H} AS "
    f"c FROM part) SELECT event_id, (SELECT COUNT(*) FROM c WHERE c.c < e.u) + 1 AS draw FROM (SELECT event_id, "
    f"{_u} AS u FROM events) e",
)
_v = q.uniform("event_id", SEED + 1)
_theta = f"({math.pi}::DOUBLE * (u - 0.5::DOUBLE))"


def _stable_sql(value: str) -> str:
    return (
        f"SELECT event_id, round({value}, 6) AS draw FROM (SELECT event_id, {_u} AS u, {_v} AS v FROM events)"
    )


for _alpha in (2.0, 1.0, 1.5):
    reg.add(
        f"stable_draws_{str(_alpha).replace('.', '_')}",
        lambda s, d, alpha=_alpha: g.stable_draws(event_ids(s, d), "event_id", alpha, SEED).select(
            "event_id", F.round("draw", 6).alias("draw")
        ),
        _stable_sql(
            f"sin({_alpha}::DOUBLE * {_theta}) * pow(cos({_theta}), {-1 / _alpha}::DOUBLE) * "
            f"pow(cos({1 - _alpha}::DOUBLE * {_theta}) / -ln(v), {(1 - _alpha) / _alpha}::DOUBLE)"
        ),
    )
