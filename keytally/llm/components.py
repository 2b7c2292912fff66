"""Connected components of a graph by alternating large and small stars, in joins and groupings.

Each round joins every edge with the smallest neighbour of its end, so that a node of any
degree is one grouped minimum and one join against unique keys, which Spark may split. Rounds are
written to the shared folder; only two totals per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytally.sinks.sketch_store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("v"), "m")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these; edges are (v, m < v)."""
    least = edges.groupBy("v").agg(F.min("m").alias("least"))
    linked = edges.join(least, "v")
    down = linked.filter("m > least").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return down.union(least.select("v", F.col("least").alias("m"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (a < b): root is the smallest node it reaches."""
    links = stored(edges.select(F.col("b").alias("v"), F.col("a").alias("m")), name)
    seen = None
    while True:
        star = _large_star(links.select(F.col("m").alias("a"), F.col("v").alias("b")))
        links = stored(_small_star(star), name)
        total = F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))
        now = links.agg(F.count("*"), total).first()
        if now == seen:
            break
        seen = now
    roots = links.select("m").distinct().select(F.col("m").alias("node"), F.col("m").alias("root"))
    return links.select(F.col("v").alias("node"), F.col("m").alias("root")).union(roots)
