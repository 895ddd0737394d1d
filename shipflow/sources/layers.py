"""Parquet layers partitioned by event_date."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shipflow import schemas as S
from shipflow.session import bytes_setting, configured, own_tables, shared_path

COMPRESSION = "zstd"
EVENT_BYTES = 128  # that an event takes in a shuffle


def read_layer(
    spark: SparkSession,
    path: str,
    schema: StructType,
    first_date: date | None = None,
    last_date: date | None = None,
) -> DataFrame:
    """A layer with its declared schema; a date range prunes partitions."""
    layer = spark.read.schema(schema).parquet(path)
    if first_date is not None:
        layer = layer.filter(F.col("event_date") >= F.lit(first_date))
    if last_date is not None:
        layer = layer.filter(F.col("event_date") <= F.lit(last_date))
    return layer


def read_raw(spark: SparkSession, path: str, **dates) -> DataFrame:
    return read_layer(spark, path, S.RAW, **dates)


def read_processed(spark: SparkSession, path: str, **dates) -> DataFrame:
    return read_layer(spark, path, S.PROCESSED, **dates)


def write_raw(raw: DataFrame, path: str, mode: str = "errorifexists", apart: Sequence[str] = ()) -> None:
    """Add to the raw layer or make it. Payloads are JSON text, of which Zstandard leaves half of what Snappy does.

    With ``apart``, columns besides those of the layer, one pass makes a layer for each of their values, ``path/name=value``.
    """
    raw.write.mode(mode).option("compression", COMPRESSION).partitionBy(*apart, "event_date").parquet(path)


def write_processed(events: DataFrame, path: str, only_touched_dates: bool = False) -> None:
    """Replace the layer, or with ``only_touched_dates`` just the dates that occur in ``events``.

    Events are stored by date where they are, then read back date by date: few files per date, and a date that is too
    large for one task is written by several. Nothing is shuffled; a stored event takes a quarter of a shuffled one.
    """
    with own_tables():
        write_sorted(_gathered(events), path, "overwrite", only_touched_dates)


def _gathered(events: DataFrame) -> DataFrame:
    """The events, stored, in partitions that each hold one date."""
    spark, path = events.sparkSession, shared_path(events.sparkSession, "by-date", recorded=True)
    events.write.option("compression", COMPRESSION).partitionBy("event_date").parquet(path)
    layer = spark.read.schema(events.schema).parquet(path).select(*events.columns)
    rows_per_task = max(1, bytes_setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes") // EVENT_BYTES)
    dates = layer.groupBy("event_date").agg(F.count("*").alias("n")).orderBy("event_date").collect()  # a row per calendar date
    parts = [layer.filter(F.col("event_date").eqNullSafe(F.lit(of.event_date))).coalesce(-(-of.n // rows_per_task)) for of in dates]
    return united(parts) if parts else layer


def united(parts: list[DataFrame]) -> DataFrame:
    """All parts in order, united by halves: each union is analysed again with all that is below it."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return united(parts[:half]).unionByName(united(parts[half:]))


def write_sorted(events: DataFrame, path: str, mode: str, only_touched_dates: bool = False) -> None:
    """Write the partitions as they are, each sorted: for events that lie by date already. Sorting inside the
    partitions, date first, is an order the writer keeps."""
    arranged = events.sortWithinPartitions("event_date", "shipment_id", *S.EVENT_ORDER)
    with configured(events.sparkSession, "spark.sql.unionOutputPartitioning", "false"):  # a task per partition of a union
        (
            arranged.write.mode(mode)
            .option("partitionOverwriteMode", "dynamic" if only_touched_dates else "static")
            .option("compression", COMPRESSION)
            .partitionBy("event_date")
            .parquet(path)
        )
