import pytest
from helpers import at, payload, raw_frame
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.operators import cleanse


def kept(spark, *texts):
    return {row.event_id: row for row in cleanse.processed_events(raw_frame(spark, *texts)).collect()}


def test_unusable_events_are_dropped(spark):
    events = kept(
        spark,
        "not json",
        None,
        payload(event_id=None),
        payload(event_id="no shipment", shipment_id=None),
        payload(event_id="no status", event_status=None),
        payload(event_id="bad time", event_timestamp="garbage"),
        payload(event_id="no time", event_timestamp=None),
        payload(event_id="good"),
    )
    assert set(events) == {"good"}


def test_badly_typed_field_is_null_by_itself(spark):
    event = kept(spark, payload(event_id="x", event_sequence="seven", cargo_weight_kg=2.5))["x"]
    assert event.event_sequence is None
    assert event.cargo_weight_kg == 2.5


def test_first_usable_copy_survives(spark):
    events = kept(
        spark,
        payload(event_id="x", event_timestamp="garbage", driver_id="broken"),
        payload(event_id="x", driver_id="first"),
        payload(event_id="x", driver_id="second"),
    )
    assert events["x"].driver_id == "first"


def test_times_and_flags(spark):
    event = kept(spark, payload(event_status="OUT_FOR_DELIVERY", event_timestamp="2024-03-01T23:59:59.5"))["E1"]
    assert str(event.event_date) == "2024-03-01" and event.event_hour == 23
    flags = {name for name in event.asDict() if name.startswith("is_") and event[name]}
    assert flags == {"is_out_for_delivery"}


@pytest.mark.parametrize(
    ("fields", "delayed"),
    [
        ({}, False),
        ({"delay_probability": 0.5}, True),
        ({"delay_probability": 0.49}, False),
        ({"eta_variation_minutes": 30.0}, True),
        ({"exception_type": "BAD_WEATHER"}, True),
        ({"delay_probability": None, "eta_variation_minutes": None}, False),
        ({"delay_probability": None, "eta_variation_minutes": 31.0}, True),
        ({"delay_probability": float("nan")}, True),
    ],
)
def test_delayed_flag(spark, fields, delayed):
    assert kept(spark, payload(**fields))["E1"].is_event_delayed is delayed


def test_rejects_and_kept_rows_add_up(spark):
    raw = raw_frame(
        spark,
        "not json",
        payload(event_id=None),
        payload(event_id="a", shipment_id=None),
        payload(event_id="b", event_status=None),
        payload(event_id="c", event_timestamp="garbage"),
        *[payload(event_id="much copied") for _ in range(20)],
        payload(event_id="d"),
    )
    rejects = {row.reject_reason: row.row_count for row in cleanse.reject_summary(raw).collect()}
    assert rejects == {
        "MISSING_EVENT_ID": 2,
        "MISSING_SHIPMENT_ID": 1,
        "MISSING_EVENT_STATUS": 1,
        "INVALID_EVENT_TIMESTAMP": 1,
        "DUPLICATE_EVENT_ID": 19,
    }
    assert sum(rejects.values()) + cleanse.processed_events(raw).count() == raw.count()


def test_result_does_not_depend_on_partitioning(spark):
    raw = raw_frame(spark, *[payload(event_id=f"E{i % 7}", driver_id=f"copy {i}") for i in range(60)])
    one, many = (cleanse.processed_events(raw.repartition(n)).select("event_id", "driver_id") for n in (1, 9))
    assert sorted(one.collect()) == sorted(many.collect())
    assert {row.driver_id for row in one.collect()} == {f"copy {i}" for i in range(7)}


def test_processed_columns_match_the_declared_layer(spark):
    events = cleanse.processed_events(raw_frame(spark, payload()))
    assert {f.name: f.dataType for f in events.schema} == {f.name: f.dataType for f in S.PROCESSED}


def test_shuffle_carries_one_copy_per_task_and_parses_once(spark, tmp_path):
    raw_frame(spark, payload()).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    plan = cleanse.processed_events(raw)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
    assert plan.count("from_json") == 1
    assert "rangepartitioning" not in plan and "Python" not in plan


def test_pruned_decode_of_null_and_bad_text(spark):
    decoded = cleanse.decode(raw_frame(spark, None, "[1", payload()), fields=("event_id", "event_status"))
    assert sorted(map(tuple, decoded.collect()), key=repr) == [("E1", "CREATED"), (None, None), (None, None)]


def test_arrival_time_decides_before_offset(spark):
    raw = raw_frame(spark, payload(driver_id="late"), payload(driver_id="early")).withColumn(
        "kafka_timestamp", F.when(F.col("kafka_offset") == 0, F.lit(at(9))).otherwise(F.lit(at(1)))
    )
    assert cleanse.processed_events(raw).first().driver_id == "early"
