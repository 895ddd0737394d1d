"""Dense ranks of distinct keys, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipflow.session import stored

RANGE_ROWS = 200_000


def ranked(keys: DataFrame, columns: list[str], rank: str) -> DataFrame:
    """Distinct keys with their place in the order of columns, from 1.

    Keys are dealt to ranges and stored; a key's rank is the size of the ranges before, and its place in its own.
    """
    ranges = max(1, -(-keys.count() // RANGE_ROWS))
    dealt = stored(keys.repartitionByRange(ranges, *columns).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    starts = starts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*columns)
    return (
        dealt.withColumn("_place", F.row_number().over(inside))
        .join(starts, "_range")
        .withColumn(rank, F.col("_before") + F.col("_place"))
        .drop("_range", "_place", "_before")
    )
