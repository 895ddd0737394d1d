"""The delivery flow, rebuilt from the order of the events."""

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipflow import constants as C
from shipflow import schemas as S
from shipflow.functions import times
from shipflow.functions.earliest import Earliest
from shipflow.operators import sequence
from shipflow.operators.dims import bounded

KEY = "shipment_id"


def _ordered(events: DataFrame, *columns: str) -> DataFrame:
    return events.select(KEY, *S.EVENT_ORDER, *columns)


def stage_transitions(events: DataFrame, **limits) -> DataFrame:
    """Each event with the status before it and the minutes spent there."""
    groups = sequence.cut_groups(_ordered(events, "event_status"), KEY, S.EVENT_ORDER, **limits)
    stepped = sequence.with_previous(groups, ["event_status", "event_timestamp"]).rows
    return stepped.select(
        KEY,
        "event_id",
        "event_sequence",
        F.col("previous.event_status").alias("from_status"),
        F.col("event_status").alias("to_status"),
        times.minutes_between(F.col("previous.event_timestamp"), F.col("event_timestamp")).alias("dwell_minutes"),
    )


def sequence_anomalies(events: DataFrame, **limits) -> DataFrame:
    """Events earlier than the one before them, or with steps missing before them."""
    groups = sequence.cut_groups(_ordered(events), KEY, S.EVENT_ORDER, **limits)
    stepped = sequence.with_previous(groups, ["event_sequence", "event_timestamp"]).rows
    missing = F.col("event_sequence") - F.coalesce("previous.event_sequence", F.lit(0)) - 1
    goes_back = F.col("event_timestamp") < F.col("previous.event_timestamp")
    return stepped.select(
        KEY,
        "event_id",
        F.col("previous.event_sequence").alias("previous_sequence"),
        "event_sequence",
        F.coalesce(goes_back, F.lit(False)).alias("time_goes_back"),
        F.greatest(missing, F.lit(0)).alias("missing_steps"),
    ).filter(F.col("time_goes_back") | (F.col("missing_steps") > 0))


def hub_path(events: DataFrame, **limits) -> DataFrame:
    """Hubs in the order a shipment was seen at them, one row per hop, repeats in a row merged."""
    seen = _ordered(events, "current_hub_id").filter(F.col("current_hub_id").isNotNull())
    groups = sequence.cut_groups(seen, KEY, S.EVENT_ORDER, **limits)
    stepped = sequence.with_previous(groups, ["current_hub_id"])
    is_hop = F.col("previous").isNull() | (F.col("previous.current_hub_id") != F.col("current_hub_id"))
    hops = replace(stepped, rows=stepped.rows.filter(is_hop))
    return sequence.with_position(hops, "hop_number").rows.select(
        KEY, "hop_number", F.col("current_hub_id").alias("hub_id"), F.col("event_timestamp").alias("seen_at")
    )


def status_conformance(events: DataFrame, order: Sequence[str] = S.EVENT_ORDER, **limits) -> DataFrame:
    """Each event against the status order: expected, skipped, repeated, backward or unknown.

    The state of a shipment is the furthest status it has reached, none at first. A status moves the state to itself
    if it lies further; then it is expected if it is the next one, and skips those between otherwise. The status of
    the state is repeated, one before it is backward, and neither moves the state. A status outside the order is
    unknown and changes nothing. As a move keeps the further of two statuses, the moves of a piece of a long shipment
    add up to one: to the furthest status in it.
    """
    groups = sequence.cut_groups(_ordered(events, "event_status"), KEY, order, **limits)
    rank = F.array_position(F.array(*[F.lit(status) for status in C.STATUSES]), F.col("event_status"))
    known = F.when(rank > 0, rank)
    stepped = sequence.with_highest_before(groups, known, "_furthest").rows
    furthest = F.coalesce("_furthest", F.lit(0))
    return stepped.select(
        KEY,
        "event_id",
        "event_status",
        F.get(F.array(*[F.lit(status) for status in C.STATUSES]), F.col("_furthest").cast("int") - 1).alias("furthest_status"),
        F.when(known.isNull(), "unknown")
        .when(rank == furthest + 1, "expected")
        .when(rank > furthest, "skipped")
        .when(rank == furthest, "repeated")
        .otherwise("backward")
        .alias("conformance"),
        F.coalesce(F.greatest(known - furthest - 1, F.lit(0)), F.lit(0)).cast("int").alias("skipped_statuses"),
    )


def current_status(events: DataFrame, key: str = KEY) -> DataFrame:
    """Last status of each shipment (or dispatch), in event order."""
    last = F.max(F.struct(*S.EVENT_ORDER, "event_status"))
    return (
        events.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(last.alias("_last"))
        .select(
            key,
            F.col("_last.event_status").alias("current_status"),
            F.col("_last.event_timestamp").alias("status_at"),
        )
    )


SHIPMENT_ATTRIBUTES = (
    "origin_region_id",
    "destination_region_id",
    "origin_hub_id",
    "destination_hub_id",
    "cargo_type",
    "cargo_weight_kg",
    "shipping_costs",
    "lead_time_days",
    "promised_delivery_at",
)
DISPATCH_ATTRIBUTES = (KEY, "driver_id", "vehicle_id")


def _entity(events: DataFrame, key: str, attributes, status: str, opening: tuple[str, str]) -> DataFrame:
    """One row per key: first attributes, time of the opening status, last status."""
    earliest = Earliest(attributes, S.EVENT_ORDER)
    opening_status, opening_time = opening
    opened_at = F.when(F.col("event_status") == opening_status, F.col("event_timestamp"))
    return (
        events.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            *earliest.aggregates(),
            F.min(opened_at).alias(opening_time),
            F.max(F.struct(*S.EVENT_ORDER, "event_status")).alias("_last"),
        )
        .select(key, *earliest.values(), opening_time, F.col("_last.event_status").alias(status))
    )


def shipment_table(events: DataFrame, hubs: DataFrame) -> DataFrame:
    """The shipment table (16 columns); the hub dimension gives the coordinates."""
    shipments = _entity(events, KEY, SHIPMENT_ATTRIBUTES, "shipment_status", ("CREATED", "created_at"))
    hubs = bounded(hubs)
    for end in ("origin", "destination"):
        places = hubs.select(
            F.col("hub_id").alias(f"{end}_hub_id"),
            F.col("latitude").alias(f"{end}_latitude"),
            F.col("longitude").alias(f"{end}_longitude"),
        )
        shipments = shipments.join(places, f"{end}_hub_id", "left")
    return shipments.select(*S.SHIPMENT_COLUMNS)


def dispatch_table(events: DataFrame) -> DataFrame:
    """The dispatch table (6 columns)."""
    dispatches = _entity(
        events, "dispatch_id", DISPATCH_ATTRIBUTES, "dispatch_status", ("ASSIGNED", "assigned_at")
    )
    return dispatches.select(*S.DISPATCH_COLUMNS)


def shipment_dispatch(shipments: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Shipments with their dispatches.

    Both sides may be large, so the join is left to Spark. Given stored tables it can also split a
    shipment that holds many of the dispatches.
    """
    return shipments.join(dispatches, KEY).select(
        KEY,
        "dispatch_id",
        "driver_id",
        "vehicle_id",
        "origin_hub_id",
        "destination_hub_id",
        "cargo_type",
        "created_at",
        "assigned_at",
        times.minutes_between(F.col("created_at"), F.col("assigned_at")).alias("minutes_to_assign"),
        "shipment_status",
        "dispatch_status",
    )
