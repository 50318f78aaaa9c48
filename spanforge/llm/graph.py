"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, save


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges ``(u, v)`` of long ids.

    ``component`` is the smallest id reachable. Loops and repeated edges are
    harmless, edges with a null end are ignored, no edges give no rows. Each
    round keeps at most as many edges as the one before, hangs every node lower
    (the number of rounds grows with the logarithm of the longest chain) and is
    written to the shared folder; only a count and a checksum reach the driver.
    """
    directed = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = save(directed.distinct(), "edges")
    mark = None
    while True:
        following = save(_small_star(_large_star(now)), "edges")
        seen = following.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        discard(now)
        now = following
        if seen == mark:
            break
        mark = seen
    children = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return children.union(roots)
