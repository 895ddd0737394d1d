"""Connected components of an edge table, by star operations on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipflow.session import stored

# Tables of numbers and hashes: they hardly compress, and reading many small files of them needs no native buffers.
PLAIN = {"compression": "uncompressed"}


def _to_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Each link (u, v) moved to the least of u and its neighbours.

    larger_only: links go from u to larger v (large star); else from u to v not larger, and u itself moves (small star).
    """
    if larger_only:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low")).withColumn("low", F.least("w", "low"))
        moved = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        least = links.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low"))
        moved = links.join(least, F.col("u") == F.col("w")).filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = moved.unionByName(least.select(F.col("w").alias("u"), F.col("low").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of links (a, b); no rows without links.

    Large and small stars alternate until every node hangs on the least of its component. Each half round is one
    aggregation and one join; a hub's links are joined, never gathered.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    rows = links.count()  # no round has more links
    current = stored(ends.filter("u > v").distinct(), "links", rows, **PLAIN)
    while True:
        after = stored(_to_least(_to_least(current, True), False), "links", rows, **PLAIN)
        # stars: no node that hangs on another has something hanging on it
        inner = after.join(after.select(F.col("v").alias("x")).distinct(), F.col("u") == F.col("x"), "left_semi")
        several = after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
        current = after
        if inner.isEmpty() and several.isEmpty():
            break
    hanging = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hanging.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
