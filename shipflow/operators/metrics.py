"""Per-shipment metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.functions import labels, times
from shipflow.functions.earliest import Earliest

FIRST_ATTRIBUTES = (
    "dispatch_id",
    "driver_id",
    "vehicle_id",
    "origin_region_id",
    "destination_region_id",
    "origin_hub_id",
    "destination_hub_id",
    "promised_delivery_at",
)


def shipment_first_attrs(events: DataFrame) -> DataFrame:
    """First non-null value of each attribute in event order."""
    earliest = Earliest(FIRST_ATTRIBUTES, S.EVENT_ORDER)
    return (
        events.groupBy("shipment_id").agg(*earliest.aggregates()).select("shipment_id", *earliest.values())
    )


AVERAGED = ("delay_probability", "traffic_congestion_level", "weather_severity", "hub_congestion_level")


def _figures() -> list[Column]:
    """What needs no state beyond itself, but for the means."""
    delivered_at = F.when(F.col("event_status") == "DELIVERED", F.col("event_timestamp"))
    return [
        F.min("event_timestamp").alias("first_event_time"),
        F.max(delivered_at).alias("delivered_time"),
        F.count("*").alias("event_count"),
        F.max("event_sequence").alias("final_event_sequence"),
        F.max("delay_probability").alias("max_delay_probability"),
        F.count("exception_type").alias("exception_count"),
        F.max("risk_classification").alias("final_risk_classification"),
    ]


def shipment_metrics(events: DataFrame) -> DataFrame:
    """One row per shipment, 24 columns.

    ``final_risk_classification`` is the lexicographic maximum of the label (MEDIUM > LOW > HIGH),
    as dashboards built on this table expect; ``risk_modes`` has the alternatives.
    """
    earliest = Earliest(FIRST_ATTRIBUTES, S.EVENT_ORDER)
    means = [F.avg(name).alias(f"avg_{name}") for name in AVERAGED]
    return _finished(events.groupBy("shipment_id").agg(*earliest.aggregates(), *_figures(), *means))


def _finished(grouped: DataFrame) -> DataFrame:
    """The table's columns from what is known of each shipment."""
    late_by = times.minutes_between(F.col("promised_delivery_at"), F.col("delivered_time"))
    took = times.minutes_between(F.col("first_event_time"), F.col("delivered_time"))
    return (
        grouped.select("*", *Earliest(FIRST_ATTRIBUTES, S.EVENT_ORDER).values())
        .withColumns(
            {
                "total_delivery_minutes": took,
                "delay_minutes": late_by,
                "is_delayed": F.coalesce(late_by > 0, F.lit(False)),
                "created_at": F.current_timestamp(),
            }
        )
        .select(*S.METRICS_COLUMNS)
    )


def metric_states(events: DataFrame) -> DataFrame:
    """Per shipment what ``merge_states`` can add to the states of its other events."""
    earliest = Earliest(FIRST_ATTRIBUTES, S.EVENT_ORDER)
    sums = [F.sum(name).alias(f"sum_{name}") for name in AVERAGED]
    counts = [F.count(name).alias(f"n_{name}") for name in AVERAGED]
    return events.groupBy("shipment_id").agg(*earliest.aggregates(), *_figures(), *sums, *counts)


def merge_states(states: DataFrame) -> DataFrame:
    """One state per shipment from the states of disjoint parts of its events, in any order."""
    added = ["event_count", "exception_count", *[f"{kind}_{name}" for name in AVERAGED for kind in ("sum", "n")]]
    highest = ["delivered_time", "final_event_sequence", "max_delay_probability", "final_risk_classification"]
    return states.groupBy("shipment_id").agg(
        *Earliest(FIRST_ATTRIBUTES, S.EVENT_ORDER).merges(),
        F.min("first_event_time").alias("first_event_time"),
        *[F.max(name).alias(name) for name in highest],
        *[F.sum(name).alias(name) for name in added],
    )


def metrics_of_states(states: DataFrame) -> DataFrame:
    """The 24 columns from one state per shipment."""
    means = {f"avg_{name}": F.try_divide(F.col(f"sum_{name}"), F.col(f"n_{name}")) for name in AVERAGED}
    return _finished(states.withColumns(means))


def risk_modes(events: DataFrame) -> DataFrame:
    """Three readings of the final risk: lexicographic maximum, worst severity, last event."""
    risk = F.col("risk_classification")
    return (
        events.groupBy("shipment_id")
        .agg(
            F.max(risk).alias("lexical_risk"),
            F.max(F.struct(labels.risk_severity(risk).alias("severity"), risk.alias("label"))).alias("_worst"),
            F.max(F.when(risk.isNotNull(), F.struct(*S.EVENT_ORDER, risk.alias("label")))).alias("_last"),
        )
        .select(
            "shipment_id",
            "lexical_risk",
            F.col("_worst.label").alias("worst_risk"),
            F.col("_last.label").alias("last_risk"),
        )
    )
