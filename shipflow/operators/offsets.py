"""Records that a topic had and the raw layer has not, by the offsets that are missing."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_OFFSETS = 20_000  # a task orders so many; a range is one row when the ends of ranges are compared
PLACE = ["kafka_topic", "kafka_partition"]


def offset_gaps(raw: DataFrame, first_offset: int | None = None, range_offsets: int = RANGE_OFFSETS) -> DataFrame:
    """One row per stretch of missing offsets, with the arrival times of the records around it.

    Offsets are cut into ranges of fixed length, so one partition of the topic is looked at by as many tasks as it
    has ranges; the last record of a range is carried over to the next one that has any. Of a record that was stored
    more than once the earliest arrival counts. With ``first_offset``, what is missing from there to the first
    record is a gap too, without a record before it: a reader that starts at the end of a topic never sees those.
    Rows without topic, partition or offset are left out. A compacted topic and the marks of transactions leave gaps
    that are no losses.
    """
    known = raw.select(*PLACE, F.col("kafka_offset").alias("at"), F.col("kafka_timestamp").alias("seen_at"))
    if first_offset is not None:
        known = known.filter(F.col("at") >= first_offset)
    places = known.dropna(subset=[*PLACE, "at"]).groupBy(*PLACE, "at").agg(F.min("seen_at").alias("seen_at"))
    places = places.withColumn("range", F.floor(F.col("at") / range_offsets))

    here = F.struct("at", "seen_at")
    inside = Window.partitionBy(*PLACE, "range").orderBy("at")
    within = places.select(*PLACE, here.alias("after"), F.lag(here).over(inside).alias("before")).filter("before IS NOT NULL")
    ranges = places.groupBy(*PLACE, "range").agg(F.min(here).alias("after"), F.max(here).alias("last"))
    across = ranges.select(*PLACE, "after", F.lag("last").over(Window.partitionBy(*PLACE).orderBy("range")).alias("before"))
    steps = within.unionByName(across)

    edge = F.lit(first_offset).cast("long") - 1  # null without a first offset: then nothing is missing before the first record
    last = F.coalesce(F.col("before.at"), edge)
    return steps.filter(F.col("after.at") - last > 1).select(
        *PLACE,
        (last + 1).alias("first_missing"),
        (F.col("after.at") - 1).alias("last_missing"),
        (F.col("after.at") - last - 1).alias("missing_count"),
        F.col("before.seen_at").alias("seen_before"),
        F.col("after.seen_at").alias("seen_after"),
    )
