"""Shipment metrics kept up to date: a day's new events are added to stored states instead of recomputing all."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shipflow import schemas as S
from shipflow.operators import metrics
from shipflow.sources.state_log import StateLog, latest

KEY = "shipment_id"
FOLD_EVERY = 30


def state_schema(spark: SparkSession) -> StructType:
    """Columns of the states, as they come from events."""
    nothing = spark.range(0).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in S.PROCESSED])
    return metrics.metric_states(nothing).schema


def state_log(spark: SparkSession, path: str) -> StateLog:
    """States of shipments, one per shipment and slice of events."""
    return StateLog(spark, f"{path}/states", state_schema(spark))


def metrics_log(spark: SparkSession, path: str) -> StateLog:
    """Metrics of the shipments that a slice has touched; the last one of a shipment holds."""
    kinds = metrics.metrics_of_states(state_log(spark, f"{path}/none").read()).schema
    return StateLog(spark, f"{path}/metrics", kinds)


def touched_states(log: StateLog, number: int) -> DataFrame:
    """All states of the shipments in generation ``number``, up to it.

    Their least and greatest id are looked up first, so files and row groups of shipments outside are not read.
    """
    touched = log.one(number).select(KEY)
    ends = touched.agg(F.min(KEY).alias("low"), F.max(KEY).alias("high")).first()
    known = log.read(before=number + 1)
    if ends.low is not None:
        known = known.filter(F.col(KEY).between(ends.low, ends.high))
    return known.join(touched, KEY, "left_semi")


def add_events(events: DataFrame, path: str, number: int, fold_every: int = FOLD_EVERY) -> DataFrame:
    """Add processed events that no slice before has had; the metrics of the shipments they touch, from all slices.

    ``number`` is that of the slice. The same slice under the same number again replaces its first attempt, so a
    run that was cut short is simply repeated. An event that changes later needs the states of its shipment rebuilt:
    sums cannot be taken back. Events without a shipment are left out.
    """
    spark = events.sparkSession
    states, published = state_log(spark, path), metrics_log(spark, path)
    new = metrics.metric_states(events.filter(F.col(KEY).isNotNull()))
    states.append(new.sortWithinPartitions(KEY), number)
    published.append(metrics.metrics_of_states(metrics.merge_states(touched_states(states, number))), number)
    if number % fold_every == fold_every - 1:
        states.fold(lambda rows: metrics.merge_states(rows).sortWithinPartitions(KEY))
        published.fold(lambda rows: latest(rows, KEY))
    return published.one(number)


def current_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all shipments as of the last slice."""
    return latest(metrics_log(spark, path).read(), KEY).select(*S.METRICS_COLUMNS)
