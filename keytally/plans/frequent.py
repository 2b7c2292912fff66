"""Queries for the counter summaries.

Approximate counts depend on the order rows arrive in, so what is checked is what they
promise: every frequent key is reported, and the bounds of every counter hold. Where the
summary has room for all keys, the counts are exact and compared as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from keytally.functions.hashing import key_to_int, owner_by_hash, owner_of
from keytally.functions.sizes import counters_for
from keytally.functions.seeds import seed_table
from keytally.operators import exact, majority
from keytally.operators import frequent as f
from keytally.operators.summaries import heads_of, merge_lower, merge_upper, owners_for, pending_deltas
from keytally.plans import sqltext as q
from keytally.plans.registry import Registry
from keytally.sinks.sketch_store import stored
from keytally.sinks.summary_bytes import from_bytes, to_bytes
from keytally.sources.key_streams import key_stream, table, token_stream, words_of

reg = Registry()

PHI = 0.005
COUNTERS = counters_for(eps=PHI / 5)
SHARDS = 4
EPS = PHI / 2
BETA = PHI / 10
LG_SIZE = 11


def covered(
    stream: DataFrame, result: DataFrame, phi: float, eps: float | None = None
) -> DataFrame:
    """(key, true_cnt, covered) of every key with at least phi * N: is it reported, with bounds
    that hold? With ``eps``, the bounds may be no wider than eps * N, and a reported key with less than
    (phi - eps) * N is a row more, not covered."""
    hist = exact.exact_histogram(stream)
    n = hist.agg(F.sum("cnt").alias("n")).scalar()
    holds = (F.col("lower") <= F.col("cnt")) & (F.col("cnt") <= F.col("upper"))
    wanted = F.col("cnt") >= F.lit(phi) * n
    if eps is not None:
        holds = holds & (F.col("upper") - F.col("lower") <= F.lit(eps) * n)
        too_rare = F.col("lower").isNotNull() & (F.col("cnt") < F.lit(phi - eps) * n)
        holds, wanted = holds & ~too_rare, wanted | too_rare
    return (
        hist.join(result.select("key", "lower", "upper"), "key", "left")
        .where(wanted)
        .select(
            "key", F.col("cnt").alias("true_cnt"), F.coalesce(holds, F.lit(False)).alias("covered")
        )
    )


def bound_faults(stream: DataFrame, rows: DataFrame, width: float = 1 / COUNTERS) -> DataFrame:
    """How many tracked keys have bounds that do not hold or are wider than a share ``width`` of N, and
    whether any was tracked."""
    truth = exact.exact_histogram(stream)
    n = truth.agg(F.sum("cnt").alias("n")).scalar()
    holds = (F.col("lower") <= F.col("cnt")) & (F.col("cnt") <= F.col("upper"))
    wide = F.col("upper") - F.col("lower") > F.lit(width) * n
    return rows.join(truth.withColumnRenamed("cnt", "true"), "key", "left").withColumn(
        "cnt", F.coalesce("true", F.lit(0))
    ).agg(
        F.count_if(~holds).alias("faults"),
        F.count_if(wide).alias("too_wide"),
        (F.count(F.lit(1)) > 0).alias("any_reported"),
    )


def truth_sql(source: str, phi: float) -> str:
    return (
        f"WITH h AS {q.hist(source)} SELECT key, cnt AS true_cnt, TRUE AS covered FROM h "
        f"WHERE cnt >= {phi}::DOUBLE * (SELECT SUM(cnt) FROM h)"
    )


TRUTH = truth_sql(q.TOKENS, PHI)
NO_FAULTS = "SELECT 0::BIGINT AS faults, 0::BIGINT AS too_wide, COUNT(*) > 0 AS any_reported FROM documents"
EVENT_COUNTS = (
    "SELECT event_type AS key, COUNT(*) AS est, COUNT(*) AS lower, COUNT(*) AS upper "
    "FROM events GROUP BY 1"
)
TOKEN_OWNER = "(('0x' || substr(md5(key), 1, 7))::BIGINT & 511) % 4"


def token_owner(shards: int = SHARDS):
    return owner_of(key_to_int("key"), shards)


def event_types(s, d):
    return key_stream(s, d, "events", "event_type")


def sharded(s, d, shards=None):
    """Shared by several queries: the tokens' summaries, stored, by as many owners as the scan asks for or by
    ``shards`` that the SQL deals words to as well."""
    words = token_stream(s, d)
    owner = token_owner(shards) if shards else owner_by_hash("key", owners_for(words))
    return stored(
        f.space_saving_sharded(words, COUNTERS, shards or owners_for(words), owner), "sharded"
    )


def local(s, d):
    return stored(f.space_saving(token_stream(s, d), COUNTERS), "local")


def flagship(s, d):
    """(shard, key, est, lower, upper) of the words that may make up PHI of all words."""
    return f.frequent_elements_global(sharded(s, d), PHI)


# --- Space-Saving ----------------------------------------------------------------------

reg.add(
    "space_saving",
    lambda s, d: bound_faults(token_stream(s, d), merge_upper(local(s, d))),
    NO_FAULTS,
)
reg.add(
    "space_saving_exact_case",
    lambda s, d: merge_upper(stored(f.space_saving(event_types(s, d), 64), "types")),
    EVENT_COUNTS,
)
reg.add(
    "frequent_elements",
    lambda s, d: covered(
        token_stream(s, d), f.frequent_elements_merged(local(s, d), PHI), PHI, EPS
    ),
    TRUTH,
)
reg.add(
    "space_saving_sharded",
    lambda s, d: bound_faults(token_stream(s, d), f.bounds(sharded(s, d))),
    NO_FAULTS,
)
reg.add(
    "frequent_elements_global",
    lambda s, d: covered(
        token_stream(s, d), f.frequent_elements_global(sharded(s, d), PHI), PHI, EPS
    ),
    TRUTH,
)


def split_tokens(s, d):
    """The words already counted and those still on their way: of the Spanish documents."""
    words = token_stream(s, d, extra=("lang",))
    return (
        words.where("NOT (lang <=> 'es')").select("key", "weight"),
        words.where("lang <=> 'es'").select("key", "weight"),
    )


@reg.query("include_pending_counts", TRUTH)
def _pending(s, d):
    arrived, pending = split_tokens(s, d)
    owners = owners_for(arrived)
    summary = stored(
        f.space_saving_sharded(arrived, COUNTERS, owners, owner_by_hash("key", owners)), "arrived"
    )
    # A key may be frequent only with what is pending, so every key is kept.
    floor = heads_of(summary).agg(F.max("floor").alias("floor")).scalar()
    known = f.bounds(summary)
    upper = f.include_pending(known.select("key", "est"), pending, floor)
    lower = f.include_pending(known.select("key", F.col("lower").alias("est")), pending)
    tokens = token_stream(s, d)
    rows = upper.withColumn("upper", F.col("est")).join(
        lower.withColumnRenamed("est", "lower"), "key"
    )
    return covered(tokens, f.at_least(rows, F.lit(PHI) * exact.size_of(tokens)), PHI, EPS)


reg.add(
    "include_pending_counts_exact_case",
    lambda s, d: f.include_pending(
        f.bounds(
            stored(
                f.space_saving_sharded(
                    event_types(s, d), 64, SHARDS, owner_by_hash("key", SHARDS)
                ),
                "types",
            )
        ).select("key", "est"),
        key_stream(s, d, "events", "event_type", weight=F.when(F.col("value") > 50, 1).otherwise(0)),
    ),
    "SELECT event_type AS key, (COUNT(*) + COUNT(*) FILTER (value > 50))::BIGINT AS est FROM events "
    "GROUP BY 1",
)
reg.add(
    "pending_weight",
    lambda s, d: f.pending_weight(pending_deltas(token_stream(s, d), token_owner())),
    f"SELECT SUM(weight)::BIGINT AS pending FROM {q.TOKENS}",
)
def merged_frequent(summary):
    """The merged counters that may be frequent."""
    rows = f.space_saving_merge(summary, COUNTERS)
    return f.at_least(rows, F.lit(PHI) * f.total_of(summary, "n"))


reg.add(
    "space_saving_merge",
    lambda s, d: covered(token_stream(s, d), merged_frequent(local(s, d)), PHI, EPS),
    TRUTH,
)


@reg.query("merge_tree_bounds", NO_FAULTS)
def _tree(s, d):
    """The summaries of 64 parts of the documents, merged four at a time; every bound holds and is narrow."""
    many = words_of(table(s, d, "documents").select("text").repartition(64))
    summary = stored(f.space_saving(many, COUNTERS), "many")
    return bound_faults(token_stream(s, d), f.space_saving_merge(summary, COUNTERS, fan_in=4), EPS)


@reg.query(
    "summary_bytes",
    f"SELECT {TOKEN_OWNER} AS shard, SUM(weight)::BIGINT AS n, TRUE AS same FROM {q.TOKENS} GROUP BY 1",
)
def _bytes(s, d):
    """The sharded summaries as bytes and back: nothing is lost, nothing is added."""
    summary = sharded(s, d, SHARDS)
    packed = stored(to_bytes(summary), "packed")
    again = from_bytes(packed, StringType())
    columns = summary.columns
    differs = again.select(columns).exceptAll(summary).union(summary.exceptAll(again.select(columns)))
    wrong = differs.select("shard").distinct().withColumn("differs", F.lit(True))
    return heads_of(again).join(wrong, "shard", "left").select(
        "shard", "n", F.col("differs").isNull().alias("same")
    )


@reg.query(
    "point_estimate",
    f"SELECT key, TRUE AS holds FROM {q.hist(q.TOKENS)}",
)
def _point(s, d):
    tokens = token_stream(s, d)
    owner = owner_by_hash("key", owners_for(tokens))
    answers = f.point_estimate(sharded(s, d), exact.exact_histogram(tokens), owner)
    est, error, cnt = F.col("est"), F.col("error"), F.col("cnt")
    holds = F.when(est == 0, cnt <= error).otherwise((est - error <= cnt) & (cnt <= est))
    return answers.select("key", holds.alias("holds"))


reg.add(
    "summary_weight_check",
    lambda s, d: f.summary_weight_check(sharded(s, d, SHARDS)),
    f"SELECT {TOKEN_OWNER} AS shard, SUM(weight)::BIGINT AS counters, SUM(weight)::BIGINT AS n "
    f"FROM {q.TOKENS} GROUP BY 1",
)

# --- weighted Frequent, increments ---------------------------------------------------------

reg.add(
    "weighted_frequent",
    lambda s, d: bound_faults(
        token_stream(s, d),
        merge_lower(stored(f.weighted_frequent(token_stream(s, d), COUNTERS), "frequent")),
    ),
    NO_FAULTS,
)
reg.add(
    "weighted_frequent_exact_case",
    lambda s, d: merge_lower(
        stored(
            f.weighted_frequent(key_stream(s, d, "lineitem", "l_quantity", "l_linenumber"), 64), "qty"
        )
    ).select(F.col("key").cast("long").alias("key"), "est", "lower", "upper"),
    "SELECT l_quantity::BIGINT AS key, SUM(l_linenumber)::BIGINT AS est, SUM(l_linenumber)::BIGINT "
    "AS lower, SUM(l_linenumber)::BIGINT AS upper FROM lineitem GROUP BY 1",
)
reg.add(
    "delta_emission",
    lambda s, d: _sent_faults(token_stream(s, d), deltas(s, d)),
    NO_FAULTS,
)


def _sent_faults(tokens, rows):
    """What was sent of a key falls short of its count by no more than the summaries may forget."""
    sent = rows.where("key IS NOT NULL").groupBy("key").agg(F.sum("delta").alias("est"))
    return bound_faults(tokens, _lower_rows(sent, _delta_slack(True), f.total_of(rows, "n")), EPS)


def deltas(s, d, flush=True):
    return stored(f.delta_emission(token_stream(s, d), COUNTERS, BETA, flush), "deltas")


def _lower_rows(rows: DataFrame, slack: float, n) -> DataFrame:
    """Under-counts with the upper bound their guarantee gives."""
    return rows.select(
        "key", F.col("est").alias("lower"), (F.col("est") + F.lit(slack) * n).alias("upper")
    )


def _delta_slack(flush: bool) -> float:
    return 2 / (COUNTERS + 1) + (0 if flush else BETA)


@reg.query("delta_merge", TRUTH)
def _delta_merge(s, d):
    rows, tokens = deltas(s, d), token_stream(s, d)
    merged = f.delta_merge(rows, COUNTERS)
    n, slack = f.total_of(rows, "n"), _delta_slack(True)
    found = f.at_least(merged, n * F.lit(PHI - slack))
    return covered(tokens, _lower_rows(found, slack, n), PHI, EPS)


@reg.query("drain_then_query", TRUTH)
def _drained(s, d):
    rows, tokens = deltas(s, d), token_stream(s, d)
    found = f.frequent_elements_lower(rows, COUNTERS, PHI, _delta_slack(True))
    slack = _delta_slack(True)
    return covered(tokens, _lower_rows(found, slack, f.total_of(rows, "n")), PHI, EPS)


@reg.query("frequent_elements_lower", TRUTH)
def _lower(s, d):
    rows, tokens = deltas(s, d, flush=False), token_stream(s, d)
    found = f.frequent_elements_lower(rows, COUNTERS, PHI, _delta_slack(False))
    slack = _delta_slack(False)
    return covered(tokens, _lower_rows(found, slack, f.total_of(rows, "n")), PHI, EPS)


# --- frequent items with error bounds ----------------------------------------------------


def items(s, d):
    return stored(f.frequent_items_sketch(token_stream(s, d), LG_SIZE), "items")


reg.add(
    "frequent_items_sketch",
    lambda s, d: bound_faults(token_stream(s, d), f.item_rows(items(s, d))),
    NO_FAULTS,
)


@reg.query("frequent_items_merge", TRUTH)
def _items_merge(s, d):
    words = token_stream(s, d, extra=("lang",))
    english = f.frequent_items_sketch(words.where("lang <=> 'en'"), LG_SIZE)
    others = f.frequent_items_sketch(words.where("NOT (lang <=> 'en')"), LG_SIZE - 1)
    both = stored(english.unionByName(others), "items")
    merged = stored(f.frequent_items_merge(both, LG_SIZE), "items")
    found = f.frequent_items(merged, f.NO_FALSE_NEGATIVES, F.lit(PHI) * f.total_of(merged, "n") - 1)
    return covered(token_stream(s, d), found, PHI, EPS)


@reg.query("item_bounds", f"SELECT key, TRUE AS holds FROM {q.hist(q.TOKENS)}")
def _item_bounds(s, d):
    probes = exact.exact_histogram(token_stream(s, d))
    rows = f.item_bounds(items(s, d), probes)
    cnt = F.col("cnt")
    holds = (F.col("lower") <= cnt) & (cnt <= F.col("upper")) & (
        F.col("upper") - F.col("lower") <= F.col("max_error")
    )
    return rows.select("key", holds.alias("holds"))


@reg.query("frequent_items_no_false_negatives", TRUTH)
def _nfn(s, d):
    sketch = items(s, d)
    found = f.frequent_items(sketch, f.NO_FALSE_NEGATIVES, F.lit(PHI) * f.total_of(sketch, "n") - 1)
    return covered(token_stream(s, d), found, PHI)


@reg.query(
    "frequent_items_no_false_positives",
    "SELECT 0::BIGINT AS false_positives FROM (SELECT COUNT(*) FROM documents)",
)
def _nfp(s, d):
    sketch, tokens = items(s, d), token_stream(s, d)
    bar = F.lit(PHI) * f.total_of(sketch, "n")
    found = f.frequent_items(sketch, f.NO_FALSE_POSITIVES, bar)
    truth = exact.exact_frequent_elements(tokens, PHI)
    return found.join(truth, "key", "left_anti").agg(F.count(F.lit(1)).alias("false_positives"))


reg.add(
    "sketch_statistics",
    lambda s, d: f.sketch_statistics(
        stored(f.frequent_items_sketch(event_types(s, d), 6), "types"), 6
    ),
    "SELECT FALSE AS is_empty, COUNT(DISTINCT event_type) AS active_items, COUNT(*) AS total_weight, "
    "0::BIGINT AS max_error, 3.5::DOUBLE / 64 AS epsilon, 3.5::DOUBLE / 64 * COUNT(*) AS apriori_error "
    "FROM events",
)
reg.add(
    "approx_top_k",
    lambda s, d: f.approx_top_k(event_types(s, d), 5),
    "SELECT event_type AS key, COUNT(*) AS est FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)

reg.add(
    "approx_top_k_combine",
    lambda s, d: f.approx_top_k_combined(
        f.approx_top_k_states(
            key_stream(s, d, "events", "event_type", extra=(F.expr("user_id % 7").alias("part"),)), ("part",)
        ),
        5,
    ),
    "SELECT event_type AS key, COUNT(*) AS est FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)

# --- per group ---------------------------------------------------------------------------


@reg.query(
    "frequent_elements_by_group",
    "WITH h AS (SELECT lang, key, COUNT(*) AS cnt FROM (SELECT lang, unnest(string_split_regex("
    "lower(text), '[^\\p{L}\\p{N}]+')) AS key FROM documents) WHERE key <> '' GROUP BY ALL) "
    "SELECT lang, key, cnt AS true_cnt, TRUE AS covered FROM h WHERE cnt >= 0.01::DOUBLE * "
    "(SELECT SUM(g.cnt) FROM h g WHERE g.lang = h.lang)",
)
def _by_group(s, d):
    words = token_stream(s, d, extra=("lang",))
    summary = stored(f.frequent_elements_by_group(words, ("lang",), COUNTERS), "groups")
    found = f.frequent_by_group(summary, ("lang",), 0.01)
    hist = exact.exact_histogram(words, ("lang",))
    sizes = hist.groupBy("lang").agg(F.sum("cnt").alias("n"))
    holds = (F.col("lower") <= F.col("cnt")) & (F.col("cnt") <= F.col("upper"))
    # a reported word that is too rare is a row more, and not covered
    too_rare = F.col("lower").isNotNull() & (F.col("cnt") < F.lit(0.01 - EPS) * F.col("n"))
    rows = hist.alias("h").join(sizes.alias("s"), F.col("h.lang").eqNullSafe(F.col("s.lang")))
    rows = rows.select("h.*", "s.n").alias("a").join(
        found.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.key") == F.col("b.key")), "left"
    )
    return rows.where((F.col("cnt") >= F.lit(0.01) * F.col("n")) | too_rare).select(
        "a.lang",
        "a.key",
        F.col("cnt").alias("true_cnt"),
        (F.coalesce(holds, F.lit(False)) & ~too_rare).alias("covered"),
    )


@reg.query(
    "frequent_by_many_groups",
    "SELECT l_orderkey, l_quantity::BIGINT AS key, COUNT(*) AS est, COUNT(*) AS lower, COUNT(*) AS upper "
    "FROM lineitem GROUP BY 1, 2",
)
def _many_groups(s, d):
    """A summary for every order: thousands of groups in a task; 64 counters have room for the lines of one."""
    quantity = F.col("l_quantity").cast("long")
    stream = key_stream(s, d, "lineitem", quantity, extra=("l_orderkey",))
    summary = stored(f.frequent_elements_by_group(stream, ("l_orderkey",), 64), "many-groups")
    return merge_upper(summary, ("l_orderkey",))


@reg.query(
    "frequent_by_group_exact_case",
    "SELECT l_returnflag, l_quantity::BIGINT AS key, COUNT(*) AS est, COUNT(*) AS lower, COUNT(*) AS "
    "upper FROM lineitem GROUP BY 1, 2",
)
def _by_group_exact(s, d):
    stream = key_stream(
        s, d, "lineitem", F.col("l_quantity").cast("long"), extra=("l_returnflag",)
    )
    summary = stored(
        f.frequent_elements_by_group(stream, ("l_returnflag",), 64, "frequent"), "groups"
    )
    return merge_lower(summary, ("l_returnflag",))


@reg.query(
    "frequent_items_by_group",
    "SELECT l_returnflag, l_quantity::BIGINT AS key, COUNT(*) AS est, COUNT(*) AS lower, COUNT(*) AS "
    "upper FROM lineitem GROUP BY 1, 2",
)
def _items_by_group(s, d):
    """Median-purged summaries per group; 64 counters have room for the 50 quantities."""
    stream = key_stream(
        s, d, "lineitem", F.col("l_quantity").cast("long"), extra=("l_returnflag",)
    )
    summary = stored(
        f.frequent_elements_by_group(stream, ("l_returnflag",), 64, "items"), "groups"
    )
    return merge_lower(summary, ("l_returnflag",))


# --- majority votes ----------------------------------------------------------------------

VOTE_SEEDS = seed_table(rows=4, seed=19)
VOTE_BUCKETS = 512
TOKEN_X = q.fold("('0x' || substr(md5(key), 1, 7))")
SUPP_PARTED = q.stream("lineitem", "l_suppkey", extra="l_orderkey % 4 AS part")


def _elect_sql(votes: str, ids: str, key: str = "key", amount: str = "cnt") -> str:
    return (
        f"(SELECT {ids}, arg_min({key}, (-{amount}, {key})) AS cand, "
        f"GREATEST(2 * MAX({amount}) - SUM({amount}), 1)::BIGINT AS cnt, MAX({amount})::BIGINT AS max_cnt, "
        f"SUM({amount})::BIGINT AS total FROM {votes} GROUP BY {ids})"
    )


def _votes(source: str, x: str, buckets: int = VOTE_BUCKETS, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return (
        f'(SELECT {lead}s."row", {q.bucket(buckets)} AS bucket, key, cnt FROM (SELECT *, {x} AS x FROM '
        f"{q.hist(source, by)}), {VOTE_SEEDS.values_sql()})"
    )


TOKEN_CELLS = _elect_sql(_votes(q.TOKENS, TOKEN_X), '"row", bucket')
SUPP_LOCAL = _elect_sql(
    _votes(SUPP_PARTED, q.fold("key"), 64, "part"), 'part, "row", bucket'
)
SUPP_MERGED = _elect_sql(
    f'(SELECT "row", bucket, cand AS key, SUM(cnt) AS cnt FROM {SUPP_LOCAL} GROUP BY ALL)',
    '"row", bucket',
)


def token_votes(s, d):
    return majority.majority_build(
        token_stream(s, d), VOTE_SEEDS, VOTE_BUCKETS, code=key_to_int("key")
    )


def supp_local(s, d):
    part = F.expr("l_orderkey % 4").alias("part")
    stream = key_stream(s, d, "lineitem", "l_suppkey", extra=(part,))
    return majority.majority_build(stream, VOTE_SEEDS, 64, by=("part",))


reg.add(
    "topkapi_build",
    token_votes,
    f'SELECT "row", bucket, cand, cnt, max_cnt, total FROM {TOKEN_CELLS}',
)
reg.add(
    "topkapi_merge",
    lambda s, d: majority.majority_merge(supp_local(s, d)),
    f'SELECT "row", bucket, cand, cnt, max_cnt, total FROM {SUPP_MERGED}',
)


@reg.query(
    "topkapi_top_k",
    f"WITH c AS {TOKEN_CELLS}, n AS (SELECT SUM(weight)::DOUBLE AS n FROM {q.TOKENS}), p AS (SELECT "
    f'cand AS key FROM c WHERE "row" = 0), r AS (SELECT key, s."row", {q.bucket(VOTE_BUCKETS)} AS bucket '
    f"FROM (SELECT key, {TOKEN_X} AS x FROM p), {VOTE_SEEDS.values_sql()}) SELECT r.key, MAX(cnt)::BIGINT "
    'AS est FROM r JOIN c ON r."row" = c."row" AND r.bucket = c.bucket AND r.key = c.cand GROUP BY r.key '
    "HAVING MAX(cnt) >= (SELECT n / 100 - n / 1000 FROM n) ORDER BY est DESC, key LIMIT 100",
)
def _topkapi(s, d):
    n = exact.size_of(token_stream(s, d)).cast("double")
    return majority.majority_top_k(
        token_votes(s, d),
        VOTE_SEEDS,
        VOTE_BUCKETS,
        100,
        majority.share_threshold(n, 100),
        key_to_int("key"),
    )


@reg.query(
    "topkapi_local_merge",
    f"WITH h AS {q.hist(q.TOKENS)} SELECT key, cnt AS true_cnt, TRUE AS covered FROM h WHERE cnt >= 0.01::DOUBLE * "
    "(SELECT SUM(cnt) FROM h)",
)
def _topkapi_local(s, d):
    """Sketches cast within the tasks, merged: words with one percent of all are found, with a score of
    no more than their count and no less than their lead over what else falls into their best cell."""
    words, buckets, code = token_stream(s, d), 4096, key_to_int("key")
    local = stored(majority.majority_local(words, VOTE_SEEDS, buckets, code), "votes")
    merged = majority.majority_merge(local)
    found = majority.majority_top_k(merged, VOTE_SEEDS, buckets, buckets, 1, code)
    exact_cells = majority.majority_build(words, VOTE_SEEDS, buckets, code=code)
    least = exact_cells.groupBy(F.col("cand").alias("key")).agg(
        F.max(2 * F.col("max_cnt") - F.col("total")).alias("least")
    )
    rows = found.join(least, "key").select("key", "est", "least")
    truth = exact.exact_frequent_elements(words, 0.01)
    holds = (F.col("est") <= F.col("cnt")) & (F.col("est") >= F.col("least"))
    return truth.join(rows, "key", "left").select(
        "key", F.col("cnt").alias("true_cnt"), F.coalesce(holds, F.lit(False)).alias("covered")
    )


def brand_votes(s, d):
    return majority.majority_build(key_stream(s, d, "part", "p_size", "p_partkey"), VOTE_SEEDS, 64)


reg.add(
    "majority_sketch",
    brand_votes,
    'SELECT "row", bucket, cand, cnt, max_cnt, total FROM '
    + _elect_sql(
        _votes(q.stream("part", "p_size", "p_partkey"), q.fold("key"), 64), '"row", bucket'
    ),
)
reg.add(
    "topkapi_top_k_unmerged",
    lambda s, d: majority.majority_top_k_unmerged(supp_local(s, d), 20),
    f'SELECT cand AS key, SUM(cnt)::BIGINT AS est FROM {SUPP_LOCAL} WHERE "row" = 0 GROUP BY 1 '
    "ORDER BY 2 DESC, 1 LIMIT 20",
)
_cust_cells, _cust2_cells = (
    _elect_sql(_votes(q.stream(t, c), q.fold("key"), 128), '"row", bucket')
    for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"))
)


def _vote_dots(a: str, b: str) -> str:
    return (
        "SELECT MIN(dot)::DOUBLE AS estimate FROM (SELECT SUM(a.cnt::HUGEINT * b.cnt) AS dot FROM "
        f'{a} a JOIN {b} b USING ("row", bucket) GROUP BY "row")'
    )


def _cust_votes(s, d):
    return [
        majority.majority_build(key_stream(s, d, t, c), VOTE_SEEDS, 128)
        for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"))
    ]


reg.add(
    "majority_sketch_join_size",
    lambda s, d: majority.majority_join_size(*_cust_votes(s, d), VOTE_SEEDS),
    _vote_dots(_cust_cells, _cust2_cells),
)
reg.add(
    "majority_sketch_self_join_size",
    lambda s, d: majority.majority_self_join_size(_cust_votes(s, d)[0], VOTE_SEEDS),
    _vote_dots(_cust_cells, _cust_cells),
)
