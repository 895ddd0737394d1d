"""Lanes between hubs: weights, routes, distances, coordinates, promised times."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipflow import constants as C
from shipflow.functions import labels, times
from shipflow.functions.numbers import round_even
from shipflow.operators.dims import bounded, look_up

DEFAULT_WEIGHT = 1.0


def lane_weight(origin_region: Column, destination_region: Column) -> Column:
    weight = F.when(origin_region.eqNullSafe(destination_region), C.LANE_WEIGHT_SAME_REGION)
    for region, value in C.LANE_WEIGHT_INTO.items():
        weight = weight.when(destination_region == region, value)
    return weight.otherwise(C.LANE_WEIGHT_OTHER)


def lane_weights(shipments: DataFrame, region_weights: DataFrame, hub_weights: DataFrame) -> DataFrame:
    """Region, hub and lane weight of each shipment; unknown places weigh 1."""
    weighed = look_up(
        shipments, bounded(region_weights), "destination_region_id", "region_id", {"region_weight": "_region"}
    )
    weighed = look_up(weighed, bounded(hub_weights), "destination_hub_id", "hub_id", {"hub_weight": "_hub"})
    return weighed.select(
        "shipment_id",
        F.coalesce("_region", F.lit(DEFAULT_WEIGHT)).alias("region_weight"),
        F.coalesce("_hub", F.lit(DEFAULT_WEIGHT)).alias("hub_weight"),
        lane_weight(F.col("origin_region_id"), F.col("destination_region_id")).alias("lane_weight"),
    ).withColumn("total_weight", F.col("region_weight") * F.col("hub_weight") * F.col("lane_weight"))


def planned_route(shipments: DataFrame, central_hubs: DataFrame) -> DataFrame:
    """Hubs a shipment is planned over, each once; centres only between different regions."""
    central_hubs = bounded(central_hubs)
    for end in ("origin", "destination"):
        shipments = look_up(
            shipments, central_hubs, f"{end}_region_id", "region_id", {"central_hub_id": f"_{end}_centre"}
        )
    crosses = ~F.col("origin_region_id").eqNullSafe(F.col("destination_region_id"))
    stops = F.array(
        "origin_hub_id",
        F.when(crosses, F.col("_origin_centre")),
        F.when(crosses, F.col("_destination_centre")),
        "destination_hub_id",
    )
    route = F.array_distinct(F.array_compact(stops))
    return shipments.select(
        "shipment_id",
        route.alias("route"),
        F.greatest(F.size(route) - 1, F.lit(1)).alias("route_total_steps"),
    )


def lane_distance(shipments: DataFrame) -> DataFrame:
    """Distance proxy of each shipment from the coordinates of its hubs."""
    gap = F.abs(F.col("origin_latitude") - F.col("destination_latitude")) + F.abs(
        F.col("origin_longitude") - F.col("destination_longitude")
    )
    distance = F.when(gap.isNotNull(), F.greatest(F.lit(1.0), gap * 10))
    return shipments.select(
        "shipment_id", "origin_hub_id", "destination_hub_id", round_even(distance, 2).alias("distance_factor")
    )


def hop_coordinates(events: DataFrame, hubs: DataFrame) -> DataFrame:
    """Coordinates of the current and the next hub."""
    hubs = bounded(hubs)
    placed = events.select("event_id", "current_hub_id", "next_hub_id")
    for end in ("current", "next"):
        placed = look_up(
            placed,
            hubs,
            f"{end}_hub_id",
            "hub_id",
            {"latitude": f"{end}_latitude", "longitude": f"{end}_longitude"},
        )
    columns = [f"{end}_{axis}" for end in ("current", "next") for axis in ("latitude", "longitude")]
    return placed.select("event_id", "current_hub_id", "next_hub_id", *columns)


def risk_banding(events: DataFrame, bands: tuple[float, float] = C.EVENT_RISK_BANDS) -> DataFrame:
    """Risk band from the probability next to the label the event carries."""
    band = labels.risk_band(F.col("delay_probability"), bands)
    return events.select(
        "event_id",
        "delay_probability",
        band.alias("risk_band"),
        "risk_classification",
        band.eqNullSafe(F.col("risk_classification")).alias("agrees"),
    )


def sla_check(shipments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Promised time recomputed from creation and lead time, against the stated one and the delivery."""
    expected = times.plus_days(F.col("created_at"), F.col("lead_time_days"))
    delivered = metrics.select("shipment_id", "delivered_time")
    return (
        shipments.select("shipment_id", "created_at", "lead_time_days", "promised_delivery_at")
        .withColumn("expected_promise_at", expected)
        .join(delivered, "shipment_id", "left")
        .select(
            "shipment_id",
            "created_at",
            "lead_time_days",
            "promised_delivery_at",
            "expected_promise_at",
            times.minutes_between(F.col("expected_promise_at"), F.col("promised_delivery_at")).alias(
                "promise_shift_minutes"
            ),
            "delivered_time",
            (F.col("delivered_time") <= F.col("promised_delivery_at")).alias("kept_stated_promise"),
            (F.col("delivered_time") <= F.col("expected_promise_at")).alias("kept_expected_promise"),
        )
    )
