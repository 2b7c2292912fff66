"""Linear sketches: cells (row, bucket) -> summed weight, as plain grouped sums.

A sketch is a DataFrame of its non-empty cells; an absent cell is zero. Building one needs
a single shuffle of at most rows x buckets partial sums per task, whatever the stream holds,
so a hot key costs nothing extra. Merging is another grouped sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytally.functions.hashing import cw2b, cw4, cw4b, key_code
from keytally.functions.seeds import SeedTable
from keytally.operators.exact import exact_histogram

# Fixed value: the keys that a part counts exactly.
HOT_KEYS = 16
FILTER_SLACK = 5

_BUCKET_SEEDS = ("ha", "hb", "hc", "hd")
_SIGN_SEEDS = ("sa", "sb", "sc", "sd")


def _ids(seeds: SeedTable) -> tuple[str, ...]:
    return ("run", "row") if len({r[0] for r in seeds.rows}) > 1 else ("row",)


def _one_run(seeds: SeedTable) -> None:
    if "run" in _ids(seeds):
        raise ValueError("parts and owners are sketched with the seeds of one run")


def sign_column() -> Column:
    return cw4("sa", "sb", "sc", "sd", F.col("_x"))


def bucket_column(buckets: int, pairwise: bool = False) -> Column:
    if pairwise:
        return cw2b("ha", "hb", F.col("_x"), buckets)
    return cw4b("ha", "hb", "hc", "hd", F.col("_x"), buckets)


def hash_rows(
    df: DataFrame,
    seeds: SeedTable,
    buckets: int,
    signed: bool = False,
    code: Column | None = None,
    own_run: bool = False,
) -> DataFrame:
    """Each row of ``df`` once per sketch row, with its ``bucket`` and, if asked, its ``sign``.

    ``code`` is the integer a key is hashed by; see ``key_code``. With ``own_run`` a row meets
    the seeds of the run in its column ``run`` only.
    """
    need = (*_ids(seeds), *_BUCKET_SEEDS, *(_SIGN_SEEDS if signed else ()))
    coded = df.withColumn("_x", key_code(df, code))
    wide = seeds.attach_run(coded, "run", need) if own_run else seeds.attach(coded, only=need)
    extra = [sign_column().alias("sign")] if signed else []
    kept = [c for c in df.columns if not (own_run and c == "run")]
    return wide.select(*kept, *_ids(seeds), bucket_column(buckets).alias("bucket"), *extra)


def linear_sketch(
    stream: DataFrame,
    seeds: SeedTable,
    buckets: int,
    signed: bool = False,
    by: tuple[str, ...] = (),
    code: Column | None = None,
    preaggregate: bool = False,
    own_run: bool = False,
) -> DataFrame:
    """Cells (by..., row, bucket, v) of a Count-Min (unsigned) or Fast-AGMS (signed) sketch.

    ``preaggregate`` first sums the weights per key; worth its shuffle only where the stream
    has far fewer distinct keys than rows.
    """
    if preaggregate:
        stream = exact_histogram(stream, by).withColumnRenamed("cnt", "weight")
    rows = hash_rows(stream, seeds, buckets, signed, code, own_run)
    amount = F.col("sign") * F.col("weight") if signed else F.col("weight")
    return rows.groupBy(*by, *_ids(seeds), "bucket").agg(F.sum(amount).alias("v"))


def count_min_build(
    stream: DataFrame,
    seeds: SeedTable,
    buckets: int,
    by: tuple[str, ...] = (),
    code: Column | None = None,
    preaggregate: bool = False,
) -> DataFrame:
    """Count-Min cells."""
    return linear_sketch(stream, seeds, buckets, False, by, code, preaggregate)


def merge_cells(*sketches: DataFrame) -> DataFrame:
    """The sketch of the union of the streams: exact, cell by cell."""
    ids = [c for c in sketches[0].columns if c != "v"]
    union = reduce(DataFrame.unionByName, sketches)
    return union.groupBy(*ids).agg(F.sum("v").alias("v"))


def count_min_query(
    sketch: DataFrame,
    probes: DataFrame,
    seeds: SeedTable,
    buckets: int,
    code: Column | None = None,
) -> DataFrame:
    """The probes with ``est``: the least of a key's cells, never below its true weight.

    Every distinct key is joined with its cells, a row per sketch row; where the seeds hold several
    runs there is an answer, and a column ``run``, for each.
    """
    ids = _ids(seeds)
    runs = [c for c in ids if c == "run"]
    asked = hash_rows(probes.select("key").distinct(), seeds, buckets, code=code)
    cells = asked.join(sketch, [*ids, "bucket"], "left")
    found = cells.groupBy("key", *runs).agg(F.min(F.coalesce("v", F.lit(0))).alias("est"))
    return probes.join(found, "key")


def batched_point_queries(
    sketch: DataFrame, probes: DataFrame, seeds: SeedTable, buckets: int
) -> DataFrame:
    """Each distinct key is looked up once, then the answer is handed to all its askers."""
    return count_min_query(sketch, probes, seeds, buckets)


def _totals_before(totals: DataFrame, ids: list[str], chunk: int, last: int) -> DataFrame:
    """(ids, _chunk, _offset): the sum of ``_total`` over a cell's lower chunks, of which ``last`` is the highest.

    Chunks are cut into chunks of their own until one of these has them all, so that no window sees more
    than ``chunk`` rows.
    """
    up = F.floor(F.col("_chunk") / F.lit(chunk)).cast("long")
    rows = totals.withColumn("_up", up)
    before = (
        Window.partitionBy(*ids, "_up").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = rows.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    if last < chunk:
        return inside.select(*ids, "_chunk", "_offset")
    above = totals.groupBy(*ids, up.alias("_chunk")).agg(F.sum("_total").alias("_total"))
    offsets = _totals_before(above, ids, chunk, last // chunk).select(
        *ids, F.col("_chunk").alias("_up"), F.col("_offset").alias("_above")
    )
    return inside.join(offsets, [*ids, "_up"]).select(
        *ids, "_chunk", (F.col("_offset") + F.col("_above")).alias("_offset")
    )


def update_and_query(
    stream: DataFrame, seeds: SeedTable, buckets: int, order: str, chunk: int = 4096
) -> DataFrame:
    """The estimate of each event's key just after the event was added.

    ``order`` is a unique integer from 0 on. Running sums are cut into chunks of the order, the chunks' totals into
    chunks of chunks and so on, so the events of a hot cell spread over many windows, of which none
    sees more than ``chunk`` rows. How many levels that takes is told by the highest position.
    """
    if chunk < 2:
        raise ValueError("a chunk needs at least two positions")
    ids = [*_ids(seeds), "bucket"]
    highest = stream.agg(F.max(order).alias("last")).first().last or 0
    rows = hash_rows(stream, seeds, buckets).withColumn(
        "_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long")
    )
    totals = rows.groupBy(*ids, "_chunk").agg(F.sum("weight").alias("_total"))
    offsets = _totals_before(totals, ids, chunk, highest // chunk)
    inside = (
        Window.partitionBy(*ids, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    running = rows.withColumn("_inside", F.sum("weight").over(inside)).join(
        offsets, [*ids, "_chunk"]
    )
    runs = [c for c in ids if c == "run"]
    return running.groupBy(order, "key", *runs).agg(
        F.min(F.col("_offset") + F.col("_inside")).alias("est")
    )


def estimates_per_part(
    sketch: DataFrame, probes: DataFrame, seeds: SeedTable, buckets: int, part: str
) -> DataFrame:
    """(part, key, est) for every part whose sketch has all of the key's cells.

    A key is one row with a bucket per sketch row. Each of these meets the cells in a join of its own, which leaves
    a row per part and nothing to be grouped, so a task holds no table of its keys.
    """
    _one_run(seeds)
    cells = sketch.select(
        F.col(part).alias("_part"), (F.col("row") * buckets + F.col("bucket")).alias("_cell"), F.col("v").alias("_v")
    )
    keys = probes.select("key").distinct()
    at = [seeds.columns.index(n) for n in ("row", *_BUCKET_SEEDS)]
    own = [tuple(r[i] for i in at) for r in dict.fromkeys(seeds.rows)]
    wanted = [row * buckets + cw4b(*seed, F.col("_x"), buckets) for row, *seed in own]
    found = keys.withColumn("_x", key_code(keys)).select(
        "key", *[w.alias(f"_cell{i}") for i, w in enumerate(wanted)]
    )
    for i in range(len(own)):
        met = cells.select(*[F.col(c).alias(f"{c}_{i}") for c in cells.columns])
        here = F.col(f"_cell{i}") == F.col(f"_cell_{i}")
        if i:
            # a null part is a part of its own
            here = here & F.col("_part_0").eqNullSafe(F.col(f"_part_{i}"))
        found = found.join(met, here).drop(f"_cell{i}", f"_cell_{i}", *([f"_part_{i}"] if i else []))
    values = [F.col(f"_v_{i}") for i in range(len(own))]
    est = F.least(*values) if len(values) > 1 else values[0]
    return found.select(F.col("_part_0").alias(part), "key", est.alias("est"))


def _sum_over_parts(probes: DataFrame, per_part: DataFrame) -> DataFrame:
    sums = per_part.groupBy("key").agg(F.sum("est").alias("est"))
    return probes.join(sums, "key", "left").withColumn("est", F.coalesce("est", F.lit(0)))


def local_copies_query(
    stream: DataFrame, probes: DataFrame, seeds: SeedTable, buckets: int, part: str
) -> DataFrame:
    """One sketch per part of the stream; the answer sums the parts' own minima."""
    sketch = count_min_build(stream, seeds, buckets, by=(part,))
    return _sum_over_parts(probes, estimates_per_part(sketch, probes, seeds, buckets, part))


def owner_partitioned_query(
    stream: DataFrame, probes: DataFrame, seeds: SeedTable, buckets: int, owner: Column
) -> DataFrame:
    """One sketch per owner shard; a key is looked up in its owner's sketch only."""
    _one_run(seeds)
    sketch = count_min_build(stream.withColumn("owner", owner), seeds, buckets, by=("owner",))
    rows = hash_rows(probes.select("key").distinct().withColumn("owner", owner), seeds, buckets)
    found = (
        rows.join(sketch, ["owner", "row", "bucket"], "left")
        .groupBy("key")
        .agg(F.min(F.coalesce("v", F.lit(0))).alias("est"))
    )
    return probes.join(found, "key")


def hybrid_query(
    stream: DataFrame,
    probes: DataFrame,
    seeds: SeedTable,
    buckets: int,
    part: str,
    parts: int,
    slack: int,
) -> DataFrame:
    """Cells of each part are merged at reduced precision, in multiples of ``slack``; the answer adds
    the most that ``parts`` roundings take off a cell."""
    local = count_min_build(stream, seeds, buckets, by=(part,))
    shared = local.groupBy("row", "bucket").agg(F.sum(F.col("v") - F.col("v") % slack).alias("v"))
    found = count_min_query(shared, probes, seeds, buckets)
    return found.withColumn("est", F.col("est") + (slack - 1) * parts)


def hot_keys(hist: DataFrame, by: str, k: int = HOT_KEYS) -> DataFrame:
    """The k heaviest keys of each part, ties by key. Tasks keep k rows per part before the
    shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("cnt"), "key")
    return hist.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _augmented_parts(
    stream: DataFrame, seeds: SeedTable, buckets: int, part: str, k: int
) -> tuple[DataFrame, DataFrame]:
    hist = exact_histogram(stream, (part,))
    hot = hot_keys(hist, part, k)
    rest = hist.join(hot.select(part, "key"), [part, "key"], "left_anti")
    return hot, count_min_build(rest.withColumnRenamed("cnt", "weight"), seeds, buckets, by=(part,))


def augmented_query(
    stream: DataFrame,
    probes: DataFrame,
    seeds: SeedTable,
    buckets: int,
    part: str,
    k: int = HOT_KEYS,
) -> DataFrame:
    """Per part, the hottest keys are counted exactly and the rest sketched; answers are
    summed over the parts."""
    hot, sketch = _augmented_parts(stream, seeds, buckets, part, k)
    asked = probes.select("key").distinct()
    sketched = estimates_per_part(sketch, asked, seeds, buckets, part)
    exact = hot.join(asked, "key", "left_semi").select(part, "key", F.col("cnt").alias("est"))
    merged = sketched.join(hot.select(part, "key"), [part, "key"], "left_anti").unionByName(exact)
    return _sum_over_parts(probes, merged)


def slack_filter_query(
    stream: DataFrame,
    probes: DataFrame,
    seeds: SeedTable,
    buckets: int,
    part: str,
    parts: int,
    slack: int = FILTER_SLACK,
) -> DataFrame:
    """Counts of each part enter the sketch at reduced precision, in multiples of ``slack``, so that rare
    keys do not crowd it; the answer adds the most that ``parts`` roundings take off a key."""
    hist = exact_histogram(stream, (part,))
    written = hist.select("key", (F.col("cnt") - F.col("cnt") % slack).alias("weight"))
    sketch = count_min_build(written.where(F.col("weight") > 0), seeds, buckets)
    found = count_min_query(sketch, probes, seeds, buckets)
    return found.withColumn("est", F.col("est") + (slack - 1) * parts)


def delegated_query(
    stream: DataFrame,
    pending: DataFrame,
    probes: DataFrame,
    seeds: SeedTable,
    buckets: int,
    owner: Column,
    k: int = HOT_KEYS,
) -> DataFrame:
    """The owner of a key answers from its exact hot counts or else its sketch, plus the
    increments still on their way to it."""
    hot, sketch = _augmented_parts(stream.withColumn("owner", owner), seeds, buckets, "owner", k)
    asked = probes.select("key").distinct().withColumn("owner", owner)
    found = (
        hash_rows(asked, seeds, buckets)
        .join(sketch, ["owner", "row", "bucket"], "left")
        .groupBy("owner", "key")
        .agg(F.min(F.coalesce("v", F.lit(0))).alias("_sketched"))
    )
    waiting = pending.groupBy("key").agg(F.sum("weight").alias("_waiting"))
    answer = (
        found.join(hot, ["owner", "key"], "left")
        .join(waiting, "key", "left")
        .select(
            "key",
            (F.coalesce("cnt", "_sketched") + F.coalesce("_waiting", F.lit(0))).alias("est"),
        )
    )
    return probes.join(answer, "key")


def built_in_count_min(stream: DataFrame, eps: float, confidence: float, seed: int) -> DataFrame:
    """Spark's own Count-Min bytes, for exchange with other programs."""
    return stream.agg(
        F.count_min_sketch(F.col("key"), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch")
    )
