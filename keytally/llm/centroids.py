"""Centroid clustering (Lloyd's rounds) in whole numbers, by JVM expressions only.

Vectors become arrays of integers once and are stored. In each round the centroids are literal arrays in the
plan: ``zip_with`` and ``aggregate`` give the squared distances, ``array_min`` of (distance, number) structs chooses
the cluster, and one grouped sum per component gives the new centroids. A task sends one row of sums per
cluster, so a cluster of any size is spread over all tasks; the driver sees ``clusters`` rows of sums a round.

All arithmetic is exact, so results do not depend on the order or the number of partitions.

Defined results: a vector counts if it has exactly ``dimensions`` components, none of them null, NaN or infinite; others,
null vectors among them, give no row. Components beyond ``LARGEST`` (131 072 before scaling) are cut to it, so that squared
distances fit 64 bits; an inertia past 64 bits is null. A null id is hashed as ``null``; vectors of equal hash
start in the order of their components, and equal vectors may be two centroids, of which the smaller number takes
all. Fewer vectors than clusters give as many centroids as vectors; an empty table gives no rows. Repeated rows count
as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.sinks.sketch_store import stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
LARGEST = 1 << 27


def whole_vectors(table: DataFrame, dimensions: int, key: str, vector: str) -> DataFrame:
    """(key, v) of the vectors that count: v holds floor(``SCALE`` * x) of each component."""
    wide = F.col(vector).cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    limit = float(LARGEST)

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x * SCALE, F.lit(limit)), F.lit(-limit))).cast("long")

    # the filter is a condition of the expression too, as Spark may compute v before it filters
    fits = (F.size(wide) == dimensions) & ~bad
    return table.select(F.col(key), F.when(fits, F.transform(wide, whole)).alias("v")).filter("v is not null")


def start_order(key: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.sha2(text, 256)


def _literal(centroid: list[int]) -> str:
    return f"array({', '.join(f'{c}L' for c in centroid)})"


def squared_distance(centroid: list[int]) -> str:
    apart = f"zip_with(v, {_literal(centroid)}, (a, b) -> a - b)"
    return f"aggregate({apart}, 0L, (total, d) -> total + d * d)"


def nearest(centroids: list[list[int]]) -> Column:
    """The struct (distance, cluster) of the centroid nearest to ``v``; ties go to the smaller number."""
    options = [
        f"struct({squared_distance(c)} AS distance, {i} AS cluster)" for i, c in enumerate(centroids)
    ]
    return F.expr(f"array_min(array({', '.join(options)}))").alias("near")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; an empty cluster keeps its own."""
    sums = [F.expr(f"sum(v[{i}]) AS s{i}") for i in range(len(centroids[0]))]
    chosen = vectors.select("v", nearest(centroids))
    rows = chosen.groupBy(F.col("near.cluster").alias("cluster")).agg(F.count("*").alias("n"), *sums)
    out = list(centroids)
    for row in rows.collect():  # one row per cluster
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(len(centroids[0]))]
    return out


def cluster_vectors(
    table: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of every vector that counts."""
    vectors = stored(whole_vectors(table, dimensions, key, vector), "whole-vectors")
    first = vectors.orderBy(start_order(F.col(key), seed), "v").limit(clusters).select("v").collect()
    centroids = [list(row.v) for row in first]
    if not centroids:
        none = "cast(null as {}) as {}".format
        return vectors.select(
            key, F.expr(none("int", "cluster")), F.expr(none("long", "distance")),
            F.expr(none("long", "cluster_inertia")), F.expr(none("long", "inertia")),
            F.expr(none("string", "centroid_sha256")), F.col("v").alias("centroid"),
        )
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    placed = stored(
        vectors.select(key, nearest(centroids)).select(key, "near.*"),
        "placed-vectors",
    )
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {row.cluster: int(row.total) for row in placed.groupBy("cluster").agg(total.alias("total")).collect()}

    def small(value: int) -> Column:
        return F.lit(value if value < 1 << 63 else None).cast("long")

    def of_cluster(values: list[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    numbers = range(len(centroids))
    return placed.select(
        key,
        "cluster",
        "distance",
        of_cluster([small(sums.get(i, 0)) for i in numbers]).alias("cluster_inertia"),
        small(sum(sums.values())).alias("inertia"),
        of_cluster([F.lit(d) for d in digests]).alias("centroid_sha256"),
        of_cluster([F.expr(_literal(c)) for c in centroids]).alias("centroid"),
    )


def cluster_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB SQL of the query over ``embeddings``: each round is a step of its own."""
    n = DIMENSIONS
    steps = [f"""
vectors AS (
  SELECT vec_id, row_number() OVER () AS row,
    list_transform(embedding, lambda x : CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c
  FROM vectors QUALIFY cluster < {clusters}
)"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT row, vec_id, v, min({{'distance': CAST(list_sum(list_transform(range(1, {n + 1}),
      lambda i : (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT), 'cluster': cluster}}) AS near
  FROM vectors, c{i} GROUP BY ALL
)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY place) AS c FROM (
      SELECT cluster, place, (s - ((s % n) + n) % n) // n AS mean FROM (
        SELECT near.cluster AS cluster, place, CAST(sum(v[place]) AS BIGINT) AS s, count(*) AS n
        FROM a{i}, range(1, {n + 1}) r(place) GROUP BY ALL)) GROUP BY cluster) m USING (cluster)
)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, near.cluster AS cluster, near.distance AS distance,
  CAST(sum(near.distance) OVER (PARTITION BY near.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = near.cluster"""
