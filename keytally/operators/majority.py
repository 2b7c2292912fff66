"""Count-Min of majority votes: each cell keeps its leading key.

The order-free form is used: a cell's candidate is its heaviest key (ties to the smaller key) and
its score is what the candidate has over all other keys together, at least 1. For a key
with a strict majority that is what every update order leaves at the least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keytally.functions.hashing import cw4b, key_code
from keytally.functions.seeds import SeedTable
from keytally.operators.exact import exact_histogram
from keytally.operators.linear import hash_rows
from keytally.operators.summaries import spread, summed_in_task, vote_runner


def _elect(votes: DataFrame, ids: tuple[str, ...], key: str, votes_column: str) -> DataFrame:
    """One row per cell: the leading key, its score, its own votes and all votes."""
    # The smallest struct has the most votes and, among equals, the smallest key.
    lead = F.min(F.struct((-F.col(votes_column)).alias("v"), F.col(key).alias("k")))
    return (
        votes.groupBy(*ids)
        .agg(lead.alias("lead"), F.sum(votes_column).alias("total"))
        .select(
            *ids,
            F.col("lead.k").alias("cand"),
            F.greatest(-2 * F.col("lead.v") - F.col("total"), F.lit(1).cast("long")).alias("cnt"),
            (-F.col("lead.v")).alias("max_cnt"),
            "total",
        )
    )


def majority_build(
    stream: DataFrame,
    seeds: SeedTable,
    buckets: int,
    by: tuple[str, ...] = (),
    code: Column | None = None,
) -> DataFrame:
    """(by..., row, bucket, cand, cnt, max_cnt, total) per cell."""
    counts = exact_histogram(stream, by)
    votes = hash_rows(counts, seeds, buckets, code=code)
    return _elect(votes, (*by, "row", "bucket"), "key", "cnt")


def majority_local(
    stream: DataFrame,
    seeds: SeedTable,
    buckets: int,
    code: Column | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """(part, row, bucket, cand, cnt) of one sketch per input partition, without any shuffle.

    Each cell holds one candidate while its rows pass by. A key with a strict majority of a cell's
    votes within the partition ends up as its candidate, with no less than its lead as score;
    scores never exceed the true count.
    """
    rows = [
        cw4b(*(numbers[i] for i in range(4, 8)), F.col("_x"), buckets).alias(f"_b{row}")
        for _, row, _, *numbers in seeds.rows
    ]
    # Summed up first, a key is hashed once per run of rows; equal keys have equal buckets.
    sums = summed_in_task(spread(stream, tasks)).select(
        "key", "weight", key_code(stream, code).alias("_x")
    )
    coded = sums.select("key", "weight", *rows)
    schema = StructType.fromDDL("part long, row int, bucket long")
    schema = schema.add("cand", stream.schema["key"].dataType).add("cnt", "long")
    return coded.mapInArrow(vote_runner(seeds.depth, buckets, to_arrow_schema(schema)), schema)


def majority_merge(sketches: DataFrame) -> DataFrame:
    """Local sketches, told apart by any further column, as one: scores of equal candidates
    add up, then the cell is elected anew."""
    sums = sketches.groupBy("row", "bucket", "cand").agg(F.sum("cnt").alias("cnt"))
    return _elect(sums, ("row", "bucket"), "cand", "cnt")


def _candidates(
    sketch: DataFrame, seeds: SeedTable, buckets: int, code: Column | None
) -> DataFrame:
    """Row-0 candidates with the score of each of their cells that elected them too."""
    first = sketch.where(F.col("row") == 0).select(F.col("cand").alias("key"))
    cells = hash_rows(first, seeds, buckets, code=code)
    votes = sketch.select("row", "bucket", F.col("cand").alias("key"), "cnt")
    return cells.join(votes, ["row", "bucket", "key"])


def majority_top_k(
    sketch: DataFrame,
    seeds: SeedTable,
    buckets: int,
    k: int,
    threshold: Column | float | int,
    code: Column | None = None,
) -> DataFrame:
    """The k best row-0 candidates that reach the threshold in some row; est is the best score."""
    return (
        _candidates(sketch, seeds, buckets, code)
        .groupBy("key")
        .agg(F.max("cnt").alias("est"))
        .where(F.col("est") >= threshold)
        .orderBy(F.desc("est"), "key")
        .limit(k)
    )


def share_threshold(total: Column, k: int) -> Column:
    """N/K less a tenth: what a key of the top K is expected to reach."""
    return total / F.lit(k) - total / F.lit(10 * k)


def majority_top_k_unmerged(sketches: DataFrame, k: int) -> DataFrame:
    """Row-0 candidates of all local sketches, scores summed per key, the k best."""
    return (
        sketches.where(F.col("row") == 0)
        .groupBy(F.col("cand").alias("key"))
        .agg(F.sum("cnt").alias("est"))
        .orderBy(F.desc("est"), "key")
        .limit(k)
    )


def majority_join_size(left: DataFrame, right: DataFrame, seeds: SeedTable) -> DataFrame:
    """Least over the rows of the summed products of equal cells' scores."""
    from keytally.operators.join_size import count_min_join_size

    cells = [s.select("row", "bucket", F.col("cnt").alias("v")) for s in (left, right)]
    return count_min_join_size(*cells, seeds)


def majority_self_join_size(sketch: DataFrame, seeds: SeedTable) -> DataFrame:
    return majority_join_size(sketch, sketch, seeds)
