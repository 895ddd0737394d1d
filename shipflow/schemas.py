"""Declared schemas and column orders of every layer."""

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "BINARY": T.BinaryType(),
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """Struct from ``name TYPE, ...``; unlike the DDL parser it needs no session at import time."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# What a Kafka source delivers; file sources must have the same columns.
ENVELOPE = _struct(
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
)

PAYLOAD_DDL = """
    event_id STRING, shipment_id STRING, dispatch_id STRING, driver_id STRING, vehicle_id STRING,
    origin_region_id STRING, destination_region_id STRING, origin_hub_id STRING, destination_hub_id STRING,
    current_hub_id STRING, next_hub_id STRING,
    cargo_type STRING, cargo_weight_kg DOUBLE, shipping_costs DOUBLE, lead_time_days DOUBLE,
    promised_delivery_at {time}, event_status STRING, event_sequence INT,
    event_timestamp {time}, processing_timestamp {time},
    latitude DOUBLE, longitude DOUBLE, route_step INT, route_total_steps INT,
    traffic_congestion_level DOUBLE, weather_severity DOUBLE, hub_congestion_level DOUBLE,
    eta_variation_minutes DOUBLE, delay_probability DOUBLE, risk_classification STRING, exception_type STRING
"""

# JSON value of an event: times are ISO text without zone.
PAYLOAD = _struct(PAYLOAD_DDL.format(time="STRING"))
PAYLOAD_COLUMNS = PAYLOAD.fieldNames()
TIME_COLUMNS = ("event_timestamp", "processing_timestamp", "promised_delivery_at")

RAW = _struct(
    "event_id STRING, kafka_key STRING, kafka_topic STRING, kafka_partition INT, kafka_offset BIGINT, "
    "kafka_timestamp TIMESTAMP, raw_payload STRING, ingested_at TIMESTAMP, event_date DATE"
)

# Column orders of the layers and tables.
RAW_COLUMNS = """
    event_id event_date kafka_key kafka_topic kafka_partition kafka_offset kafka_timestamp raw_payload ingested_at
""".split()
SHIPMENT_COLUMNS = """
    shipment_id origin_region_id destination_region_id origin_hub_id destination_hub_id
    origin_latitude origin_longitude destination_latitude destination_longitude
    cargo_type cargo_weight_kg shipping_costs lead_time_days created_at promised_delivery_at shipment_status
""".split()
DISPATCH_COLUMNS = "dispatch_id shipment_id driver_id vehicle_id assigned_at dispatch_status".split()
METRICS_COLUMNS = """
    shipment_id dispatch_id driver_id vehicle_id
    origin_region_id destination_region_id origin_hub_id destination_hub_id
    first_event_time delivered_time total_delivery_minutes promised_delivery_at delay_minutes is_delayed
    event_count final_event_sequence avg_delay_probability max_delay_probability
    avg_traffic_congestion_level avg_weather_severity avg_hub_congestion_level
    exception_count final_risk_classification created_at
""".split()

PROCESSED = _struct(
    PAYLOAD_DDL.format(time="TIMESTAMP")
    + ", event_hour INT, is_created BOOLEAN, is_assigned BOOLEAN, is_pickup BOOLEAN, is_in_transit BOOLEAN,"
    " is_arrived_hub BOOLEAN, is_out_for_delivery BOOLEAN, is_delivered BOOLEAN, is_exception BOOLEAN,"
    " is_event_delayed BOOLEAN, processed_at TIMESTAMP, event_date DATE"
)
ARRIVAL_ORDER = ("kafka_timestamp", "kafka_partition", "kafka_offset")
EVENT_ORDER = ("event_sequence", "event_timestamp", "event_id")

# Columns of the reference file -> names used after cleaning.
REFERENCE_COLUMNS = {
    "timestamp": "dataset_timestamp",
    "vehicle_gps_latitude": "source_latitude",
    "vehicle_gps_longitude": "source_longitude",
    "eta_variation_hours": "eta_variation_hours",
    "traffic_congestion_level": "traffic_congestion_level",
    "weather_condition_severity": "weather_severity",
    "port_congestion_level": "hub_congestion_level",
    "delay_probability": "delay_probability",
    "risk_classification": "risk_classification",
    "shipping_costs": "shipping_costs",
    "lead_time_days": "lead_time_days",
    "driver_behavior_score": "driver_behavior_score",
    "fatigue_monitoring_score": "fatigue_monitoring_score",
    "disruption_likelihood_score": "disruption_likelihood_score",
    "delivery_time_deviation": "delivery_time_deviation",
}
REFERENCE_TEXT = _struct(", ".join(f"{name} STRING" for name in REFERENCE_COLUMNS))
REFERENCE_CLEAN = _struct(
    "dataset_timestamp TIMESTAMP, source_latitude DOUBLE, source_longitude DOUBLE, "
    "traffic_congestion_level DOUBLE, weather_severity DOUBLE, hub_congestion_level DOUBLE, "
    "eta_variation_minutes DOUBLE, delay_probability DOUBLE, risk_classification STRING, "
    "shipping_costs DOUBLE, lead_time_days DOUBLE, driver_behavior_score DOUBLE, "
    "fatigue_monitoring_score DOUBLE, disruption_likelihood_score DOUBLE, delivery_time_deviation DOUBLE"
)

# Constraints of the dimension and transaction tables.
PRIMARY_KEYS = {
    "region": "region_id",
    "hub": "hub_id",
    "driver": "driver_id",
    "vehicle": "vehicle_id",
    "shipment": "shipment_id",
    "dispatch": "dispatch_id",
    "shipment_metrics": "shipment_id",
}
FOREIGN_KEYS = (  # child table, column, parent table
    ("hub", "region_id", "region"),
    ("driver", "region_id", "region"),
    ("vehicle", "region_id", "region"),
    ("shipment", "origin_region_id", "region"),
    ("shipment", "destination_region_id", "region"),
    ("shipment", "origin_hub_id", "hub"),
    ("shipment", "destination_hub_id", "hub"),
    ("dispatch", "shipment_id", "shipment"),
    ("dispatch", "driver_id", "driver"),
    ("dispatch", "vehicle_id", "vehicle"),
)
NOT_NULL = {
    "region": ("region_name", "region_group"),
    "hub": ("hub_name", "region_id", "latitude", "longitude", "hub_type"),
    "driver": ("driver_name", "region_id", "license_type", "driver_status"),
    "vehicle": ("vehicle_type", "capacity_kg", "region_id", "vehicle_status"),
    "shipment": [c for c in SHIPMENT_COLUMNS if c not in ("shipment_id", "shipping_costs", "lead_time_days")],
    "dispatch": ("shipment_id", "driver_id", "vehicle_id", "assigned_at", "dispatch_status"),
}
