import math

from helpers import at, events_frame, payload

from shipflow.operators import metrics


def delivered(**fields):
    return payload(**({"event_id": "E7", "event_status": "DELIVERED", "event_sequence": 7} | fields))


def measured(spark, *events, **options):
    return {row.shipment_id: row for row in metrics.shipment_metrics(events_frame(spark, *events), **options).collect()}


def test_delivery_and_delay_minutes_on_whole_seconds(spark):
    row = measured(
        spark,
        payload(event_timestamp="2024-03-01T08:00:00.900000"),
        delivered(event_timestamp="2024-03-01T20:00:30.100000"),
    )["S1"]
    assert row.total_delivery_minutes == 720.5
    assert row.delay_minutes == 120.5 and row.is_delayed is True
    assert row.event_count == 2 and row.final_event_sequence == 7


def test_early_and_missing_deliveries_are_not_delayed(spark):
    rows = measured(
        spark,
        payload(),
        delivered(event_timestamp=at(30).isoformat()),
        payload(event_id="U1", shipment_id="S2"),
    )
    assert rows["S1"].delay_minutes == -570 and rows["S1"].is_delayed is False
    assert rows["S2"].delivered_time is None and rows["S2"].total_delivery_minutes is None
    assert rows["S2"].delay_minutes is None and rows["S2"].is_delayed is False


def test_first_attributes_skip_nulls_in_event_order(spark):
    events = [
        payload(event_id="E1", event_sequence=3, driver_id="third", vehicle_id="v3"),
        payload(event_id="E2", event_sequence=2, driver_id="second", vehicle_id=None),
        payload(event_id="E3", event_sequence=1, driver_id=None, vehicle_id=None),
    ]
    for arrangement in (events, events[::-1]):
        row = metrics.shipment_first_attrs(events_frame(spark, *arrangement)).first()
        assert row.driver_id == "second" and row.vehicle_id == "v3"


def test_attribute_missing_everywhere_is_null(spark):
    row = metrics.shipment_first_attrs(events_frame(spark, payload(driver_id=None))).first()
    assert row.driver_id is None and row.vehicle_id == "VEH_0001"


def test_missing_sequence_sorts_first_and_time_breaks_ties(spark):
    row = metrics.shipment_first_attrs(
        events_frame(
            spark,
            payload(event_id="a", event_sequence=1, driver_id="later", event_timestamp=at(5).isoformat()),
            payload(event_id="b", event_sequence=1, driver_id="earlier", event_timestamp=at(1).isoformat()),
        )
    ).first()
    assert row.driver_id == "earlier"
    row = metrics.shipment_first_attrs(
        events_frame(spark, payload(event_id="a"), payload(event_id="b", event_sequence=None, driver_id="unnumbered"))
    ).first()
    assert row.driver_id == "unnumbered"


def test_measures_skip_nulls(spark):
    row = measured(
        spark,
        payload(event_id="a", delay_probability=0.2, weather_severity=None),
        payload(event_id="b", delay_probability=None, weather_severity=None),
        payload(event_id="c", delay_probability=0.6, exception_type="VEHICLE_ISSUE"),
    )["S1"]
    assert row.avg_delay_probability == 0.4 and row.max_delay_probability == 0.6
    assert row.avg_weather_severity is None and row.exception_count == 1


def test_final_risk_is_the_lexicographic_maximum(spark):
    events = [
        payload(event_id="a", event_sequence=1, risk_classification="MEDIUM"),
        payload(event_id="b", event_sequence=2, risk_classification="HIGH"),
        payload(event_id="c", event_sequence=3, risk_classification="LOW"),
    ]
    assert measured(spark, *events)["S1"].final_risk_classification == "MEDIUM"
    modes = metrics.risk_modes(events_frame(spark, *events)).first()
    assert (modes.lexical_risk, modes.worst_risk, modes.last_risk) == ("MEDIUM", "HIGH", "LOW")


def test_means_are_of_the_values_as_they_are(spark):
    small = events_frame(spark, *[payload(event_id=f"E{i}", delay_probability=0.0004) for i in range(2)])
    assert metrics.shipment_metrics(small).first().avg_delay_probability == 0.0004
    nan = float("nan")
    odd = events_frame(spark, payload(event_id="a", weather_severity=nan), payload(event_id="b", weather_severity=1.0))
    row = metrics.shipment_metrics(odd).first()
    assert math.isnan(row.avg_weather_severity) and row.event_count == 2


def test_metrics_need_no_global_sort(spark):
    frame = metrics.shipment_metrics(events_frame(spark, payload()))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("hashpartitioning(shipment_id") == 1
