"""Queries for the streaming operators.

The events are laid out as FILES files of equal size and read one per micro-batch, so
every query runs over several micro-batches and the whole table.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from keytally.functions.hashing import key_to_int, owner_by_hash, owner_of
from keytally.functions.seeds import seed_table
from keytally.operators import exact
from keytally.operators import frequent as f
from keytally.operators import majority
from keytally.operators.summaries import heads_of
from keytally.plans import sqltext as q
from keytally.plans.frequent import COUNTERS, NO_FAULTS, bound_faults, covered, truth_sql
from keytally.plans.registry import Registry
from keytally.session import work_path
from keytally.sinks.sketch_store import stored
from keytally.sources.key_streams import key_stream, live_key_stream, table, words_of
from keytally.sources.live_text import list_files, register
from keytally.sources.text_streams import write_key_stream_text
from keytally.streaming import counters as sc
from keytally.streaming import linear as sl
from keytally.streaming import marks
from keytally.streaming.runner import progress_table

reg = Registry()

FILES = 5
SHARDS = 4
PHI = 0.01
SEEDS = seed_table(rows=4, seed=43)
BUCKETS = 64
BETA = PHI / 10
#: Keys whose counters an owner keeps, where every key has one.
KEYS_PER_OWNER = 1 << 15


def _laid_out(s, d, name: str, row_id: str):
    """A table as FILES files, rows dealt out by their id."""
    path = work_path(s, f"{name}-files")
    rows = table(s, d, name)
    rows.repartitionById(FILES, (F.col(row_id) % FILES).cast("int")).write.parquet(path)
    return path, rows.schema


def live_events(s, d, key: str, extra=()):
    path, schema = _laid_out(s, d, "events", "event_id")
    return live_key_stream(s, path, schema, key, extra=extra, files_per_trigger=1)


def live_words(s, d):
    path, schema = _laid_out(s, d, "documents", "doc_id")
    reader = s.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return words_of(reader.parquet(path))


def words(s, d):
    return words_of(table(s, d, "documents"))


USERS = q.stream("events", "user_id")


@reg.query("key_stream_streaming", f"SELECT key, cnt FROM {q.hist(USERS)}")
def _live(s, d):
    folder = work_path(s, "live")
    sl.run_histogram(live_events(s, d, "user_id"), folder, SHARDS)
    return sl.stream_histogram(s, folder, LongType())


def _live_summary(s, d, stream, owner, key_type, m=COUNTERS, partitions=SHARDS, **options):
    folder = work_path(s, "stream")
    sc.run_space_saving(stream, m, owner, folder, partitions=partitions, **options)
    return folder, sc.snapshot(s, folder, sc.summary_schema(key_type))


@reg.query("stream_space_saving", truth_sql(q.TOKENS, PHI))
def _stream_ss(s, d):
    owner = owner_of(key_to_int("key"), SHARDS)
    _, now = _live_summary(s, d, live_words(s, d), owner, StringType())
    return covered(words(s, d), f.frequent_elements_global(now, PHI), PHI, PHI / 2)


@reg.query("stream_space_saving_bounds", NO_FAULTS)
def _stream_bounds(s, d):
    owner = owner_of(key_to_int("key"), SHARDS)
    _, now = _live_summary(s, d, live_words(s, d), owner, StringType())
    return bound_faults(words(s, d), f.bounds(now))


def _room_for_all(stream):
    """(counters, owners) with room for every key of the stream."""
    keys = stream.select("key").distinct().count()
    return max(COUNTERS, keys), max(SHARDS, -(-keys // KEYS_PER_OWNER))


@reg.query(
    "stream_space_saving_exact_case",
    "SELECT user_id AS key, COUNT(*) AS est, COUNT(*) AS lower, COUNT(*) AS upper FROM events GROUP BY 1",
)
def _stream_exact(s, d):
    """With room for all users, however many there are, every count is exact."""
    m, owners = _room_for_all(key_stream(s, d, "events", "user_id"))
    _, now = _live_summary(
        s, d, live_events(s, d, "user_id"), owner_by_hash("key", owners), LongType(), m, owners
    )
    return f.bounds(now).drop("shard")


@reg.query(
    "stream_queries",
    "SELECT i::BIGINT AS batch, COUNT(*) AS answers FROM (SELECT DISTINCT event_type FROM events), "
    f"range({FILES}) r(i) GROUP BY 1",
)
def _stream_queries(s, d):
    """After every micro-batch, all event types are frequent."""
    folder, _ = _live_summary(
        s,
        d,
        live_events(s, d, "event_type"),
        owner_by_hash("key", SHARDS),
        StringType(),
        phi=0.1,
    )
    return sc.answers(s, folder, StringType()).groupBy("batch").agg(
        F.count(F.lit(1)).alias("answers")
    )


@reg.query(
    "flush_policy",
    f"SELECT i::BIGINT AS batch, ((i + 1) * n // {FILES})::BIGINT AS visible, (n - (i + 1) * n // {FILES})::BIGINT AS "
    f"waiting FROM (SELECT COUNT(*) AS n FROM events), range({FILES}) r(i)",
)
def _flush(s, d):
    folder, _ = _live_summary(
        s, d, live_events(s, d, "event_type"), owner_by_hash("key", SHARDS), StringType()
    )
    seen = sc.visible_weight(s, folder, sc.summary_schema(StringType()))
    total = exact.size_of(key_stream(s, d, "events", "event_type"))
    return seen.select("batch", "visible", (total - F.col("visible")).alias("waiting"))


# --- questions between rows ------------------------------------------------------------------

RATE, OWNERS, BIG = 1000, 3, 0.2
_MARKS = f"(SELECT unnest(range(1, n // {10**6 // RATE} + 1)) AS mark FROM (SELECT COUNT(*) AS n FROM events))"


def _in_order(s, d, name: str, order: str, parts: int = 3):
    """A table as files that arrive one after the other, by their rows' positions."""
    rows, path = table(s, d, name), work_path(s, f"{name}-in-order")
    last = rows.agg(F.max(order).alias("last")).first().last
    size = -(-(last + 1) // parts)
    for i in range(parts):
        part = rows.where(F.col(order).between(i * size, (i + 1) * size - 1))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, rows.schema


def _marked(s, d, key: str, m: int, phi: float) -> str:
    path, schema = _in_order(s, d, "events", "event_id")
    rows = s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    one = F.lit(1).cast("long").alias("weight")
    stream = rows.select(F.col(key).alias("key"), one, F.col("event_id").alias("at"))
    folder = work_path(s, "marks")
    owner = owner_by_hash("key", OWNERS)
    marks.run_marks(stream, m, phi, "at", RATE, owner, OWNERS, folder, OWNERS)
    return folder


@reg.query(
    "stream_phi_queries",
    f"SELECT mark, event_type AS key, COUNT(*) AS est, mark * {10**6 // RATE} AS n, TRUE AS timed FROM {_MARKS} JOIN "
    f"events ON event_id < mark * {10**6 // RATE} GROUP BY mark, event_type HAVING COUNT(*) >= "
    f"{BIG}::DOUBLE * mark * {10**6 // RATE}",
)
def _phi_queries(s, d):
    """A question per thousand rows: each is answered as of its row, with the time that took."""
    folder = _marked(s, d, "event_type", COUNTERS, BIG)
    rows = marks.frequent_at_marks(s, folder, StringType(), BIG, OWNERS)
    return rows.select("mark", "key", "est", "n", (F.col("latency_us") > 0).alias("timed"))


@reg.query(
    "stream_phi_query_bounds",
    f"SELECT mark, {OWNERS}::BIGINT AS owners, mark * {10**6 // RATE} AS n, 0::BIGINT AS faults, TRUE AS answered "
    f"FROM {_MARKS}",
)
def _phi_bounds(s, d):
    """With fewer counters than users: at every mark the bounds hold for the rows up to it, and none that
    reaches the share is missed."""
    phi, every = 0.01, 10**6 // RATE
    folder = _marked(s, d, "user_id", 40, phi)
    found = marks.frequent_at_marks(s, folder, LongType(), phi, OWNERS)
    seen = marks.marks_seen(s, folder, LongType())
    counts = table(s, d, "events").groupBy(
        F.floor(F.col("event_id") / every).cast("long").alias("step"), F.col("user_id").alias("key")
    ).agg(F.count(F.lit(1)).alias("cnt"))
    faults = marks.faults_at_marks(counts, found, seen, phi, every)
    return seen.join(faults, "mark", "left").select(
        "mark",
        "owners",
        "n",
        F.coalesce("faults", F.lit(0).cast("long")).alias("faults"),
        (F.col("latency_us") > 0).alias("answered"),
    )


@reg.query(
    "stream_operation_totals",
    f"SELECT COUNT(*) AS inserts, COUNT(*) // {10**6 // RATE} AS queries, 100 * (COUNT(*) // {10**6 // RATE})::DOUBLE / "
    f"(COUNT(*) + COUNT(*) // {10**6 // RATE}) AS query_percent FROM events",
)
def _stream_totals(s, d):
    """Rows and questions of a stream, from the events that the stream itself reports."""
    path, schema = _in_order(s, d, "events", "event_id")
    rows = s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    one = F.lit(1).cast("long").alias("weight")
    stream = rows.select(F.col("event_type").alias("key"), one, F.col("event_id").alias("at"))
    owner = owner_by_hash("key", OWNERS)
    progress = marks.run_marks(stream, 64, BIG, "at", RATE, owner, OWNERS, work_path(s, "totals"), OWNERS)
    totals = progress_table(s, progress).agg(
        F.sum("operations").alias("inserts"), F.sum("queries").alias("queries")
    )
    share = F.lit(100) * F.col("queries").cast("double") / (F.col("inserts") + F.col("queries"))
    return totals.withColumn("query_percent", share)


# --- integers as a live source, and owners that change ------------------------------------------

_USERS_TEXT = "SELECT user_id AS key, COUNT(*) AS cnt FROM events GROUP BY 1"


def _user_text(s, d) -> str:
    """The users of the events as text: the first half, by position, in one folder and the rest in the next."""
    path = work_path(s, "users-text")
    half = table(s, d, "events").agg((F.max("event_id") / 2).alias("half")).scalar()
    step = (F.col("event_id") > half).cast("int").alias("step")
    write_key_stream_text(key_stream(s, d, "events", "user_id", extra=(step,)), path, ("step",))
    return path


@reg.query(
    "key_text_source",
    f"SELECT 'batch' AS read_as, * FROM ({_USERS_TEXT}) UNION ALL SELECT 'stream', * FROM ({_USERS_TEXT})",
)
def _key_text(s, d):
    """Read by byte ranges as a batch, and as a stream in small micro-batches that is stopped and started again."""
    register(s)
    path, folder = _user_text(s, d), work_path(s, "users-live")
    batch = exact.exact_histogram(s.read.format("key_text").option("splitBytes", 4096).load(path))
    # seven times at the least the stream has to stop and wait
    most = max(1, sum(size for _, size in list_files(path)) // 7)
    live = s.readStream.format("key_text").option("splitBytes", 4096).option("triggerBytes", most)
    for _ in range(2):
        sl.run_histogram(live.load(path), folder, SHARDS, drain=True)
    stream = sl.stream_histogram(s, folder, LongType())
    return batch.select(F.lit("batch").alias("read_as"), "key", "cnt").union(
        stream.select(F.lit("stream").alias("read_as"), "key", "cnt")
    )


@reg.query(
    "stream_owner_change",
    "SELECT 0::BIGINT AS faults, 0::BIGINT AS missed, COUNT(*) AS weight, 7::BIGINT AS owners FROM events",
)
def _owner_change(s, d):
    """A stream stops with four owners and goes on, from where it was read to, with seven; all bounds hold."""
    register(s)
    path, first, second = _user_text(s, d), work_path(s, "four"), work_path(s, "seven")
    live = s.readStream.format("key_text").option("splitBytes", 1 << 20)
    progress = sc.run_space_saving(
        live.load(f"{path}/step=0"), 40, owner_by_hash("key", 4), first, partitions=4, drain=True
    )
    end = json.loads(progress[-1].sources[0].endOffset)
    # offsets name files below the folder that is read
    start = json.dumps({"file": f"step=0/{end['file']}", "at": end["at"]})
    owner = owner_by_hash("key", 7)
    warm = sc.dealt_anew(stored(sc.state_of(s, first), "state"), owner, 7)
    sc.run_space_saving(
        live.option("start", start).load(path), 40, owner, second, warm=warm, partitions=7, drain=True
    )
    now = stored(sc.snapshot(s, second, sc.summary_schema(LongType())), "seven-owners")
    truth = exact.exact_histogram(key_stream(s, d, "events", "user_id"))
    met = truth.join(f.bounds(now), "key", "full")
    wrong = (F.col("lower") > F.col("cnt")) | (F.col("upper") < F.col("cnt")) | F.col("cnt").isNull()
    floor = heads_of(now).agg(F.max("floor").alias("floor")).scalar()
    heads = heads_of(now).agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("owners"))
    faults = met.agg(
        F.count_if(F.coalesce(wrong, F.lit(False))).alias("faults"),
        F.count_if(F.col("est").isNull() & (F.col("cnt") > floor)).alias("missed"),
    )
    return faults.select(
        "faults",
        "missed",
        heads.select("weight").scalar().alias("weight"),
        heads.select("owners").scalar().alias("owners"),
    )


# --- increments over a stream --------------------------------------------------------------------


@reg.query(
    "stream_delta_flush",
    "SELECT event_type AS key, COUNT(*) AS est, (SELECT COUNT(*) FROM events) AS n, TRUE AS held_back FROM events GROUP BY 1",
)
def _delta_flush(s, d):
    """With a share of half, much is held back; after the flush the merged counts are exact."""
    folder, shard = work_path(s, "flushed"), owner_by_hash("key", SHARDS)
    live = live_events(s, d, "event_type")
    sc.run_deltas(live, COUNTERS, 0.5, shard, folder, SHARDS, shards=SHARDS)
    before = stored(sc.merged_deltas(s, folder, StringType()), "held-back")
    sc.run_deltas(live, COUNTERS, 0.5, shard, folder, SHARDS, shards=SHARDS, flush=True)
    after = sc.merged_deltas(s, folder, StringType())
    sent = before.agg(F.coalesce(F.sum("est"), F.lit(0)).alias("sent")).scalar()
    return after.withColumn("held_back", sent < F.col("n"))


@reg.query("stream_delta_merge", truth_sql(q.TOKENS, PHI))
def _stream_deltas(s, d):
    folder = work_path(s, "stream-deltas")
    shard = owner_of(key_to_int("key"), SHARDS)
    sc.run_deltas(live_words(s, d), COUNTERS, BETA, shard, folder, SHARDS)
    rows = sc.merged_deltas(s, folder, StringType())
    # Both summaries may lose 1 / (COUNTERS + 1) of the weight, the second one per micro-batch
    # no more than the first; a share BETA may be unsent.
    slack = 2 / (COUNTERS + 1) + BETA
    found = rows.where(F.col("est") >= F.col("n") * F.lit(PHI - slack))
    return covered(
        words(s, d),
        found.select(
            "key",
            F.col("est").alias("lower"),
            (F.col("est") + F.lit(slack) * F.col("n")).alias("upper"),
        ),
        PHI,
        slack + PHI / 10,
    )


for _name, _signed in (("stream_count_min", False), ("stream_fast_agms", True)):

    def _linear(s, d, signed=_signed):
        folder = work_path(s, "stream-cells")
        sl.run_linear_sketch(live_events(s, d, "user_id"), SEEDS, BUCKETS, folder, signed, partitions=SHARDS)
        return sl.stream_cells(s, folder)

    reg.add(
        _name,
        _linear,
        f'SELECT "row", bucket, v FROM {q.sketch(USERS, SEEDS, BUCKETS, signed=_signed)}',
    )


@reg.query(
    "stream_topkapi",
    "SELECT event_type AS key, COUNT(*) AS est FROM events GROUP BY 1",
)
def _stream_votes(s, d):
    """With a cell for each event type, the votes are the counts."""
    folder = work_path(s, "stream-votes")
    sl.run_majority_sketch(
        live_events(s, d, "event_type"), SEEDS, 4096, folder, code=key_to_int("key")
    )
    votes = sl.stream_votes(s, folder, StringType())
    return majority.majority_top_k(votes, SEEDS, 4096, 100, 1, code=key_to_int("key"))


@reg.query(
    "warm_start",
    "SELECT user_id AS key, 2 * COUNT(*) AS est, 2 * COUNT(*) AS lower, 2 * COUNT(*) AS upper FROM events GROUP BY 1",
)
def _warm(s, d):
    """A summary of the whole table to start from, then the table once more as a stream."""
    users = key_stream(s, d, "events", "user_id")
    m, owners = _room_for_all(users)
    owner = owner_by_hash("key", owners)
    first = f.space_saving_sharded(users, m, owners, owner)
    live = live_events(s, d, "user_id")
    _, now = _live_summary(s, d, live, owner, LongType(), m, owners, warm=first)
    return f.bounds(now).drop("shard")
