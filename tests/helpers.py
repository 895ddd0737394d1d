"""Small hand-made events."""

import datetime as dt
import json

from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.functions import times

START = dt.datetime(2024, 3, 1, 8, 0, 0)


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def payload(**fields) -> dict:
    event = dict.fromkeys(S.PAYLOAD_COLUMNS)
    event.update(
        event_id="E1",
        shipment_id="S1",
        dispatch_id="D1",
        driver_id="DRV_0001",
        vehicle_id="VEH_0001",
        origin_region_id="REG_01",
        destination_region_id="REG_04",
        origin_hub_id="HUB_002",
        destination_hub_id="HUB_006",
        promised_delivery_at=at(600).isoformat(),
        event_status="CREATED",
        event_sequence=1,
        event_timestamp=at(0).isoformat(),
        delay_probability=0.1,
        eta_variation_minutes=5.0,
        risk_classification="LOW",
    )
    event.update(fields)
    return event


def raw_rows(*texts):
    """Raw layer rows in order of arrival."""
    return [
        (None, None, "k", "t", 0, offset, at(offset), text if text is None or isinstance(text, str) else json.dumps(text), at(0))
        for offset, text in enumerate(texts)
    ]


def raw_frame(spark, *texts):
    columns = ", ".join(f"{name} {S.RAW[name].dataType.simpleString()}" for name in S.RAW_COLUMNS)
    frame = spark.createDataFrame(raw_rows(*texts), columns)
    read = F.from_json("raw_payload", "event_id string, event_timestamp string")
    return frame.withColumns({"event_id": read["event_id"], "event_date": F.to_date(times.to_time(read["event_timestamp"]))})


def events_frame(spark, *events, columns=None):
    """Processed-like events: payload with real timestamps."""
    from shipflow.operators import cleanse

    raw = raw_frame(spark, *events)
    return cleanse.flag_events(cleanse.valid_events(raw).drop(*S.ARRIVAL_ORDER))
