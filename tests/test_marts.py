from helpers import at, events_frame, payload

from pyspark.sql import functions as F

from shipflow.operators import kpi, marts


def some_events(spark):
    events = []
    for i in range(120):
        events.append(
            payload(
                event_id=f"E{i}",
                event_timestamp=at(i * 45).isoformat(),
                destination_region_id=None if i % 17 == 0 else f"REG_0{i % 3 + 1}",
                destination_hub_id=f"HUB_00{i % 4 + 1}",
                risk_classification=("LOW", "MEDIUM", "HIGH")[i % 3],
                delay_probability=None if i % 11 == 0 else i % 100 / 100,
                traffic_congestion_level=i % 10 / 2,
                hub_congestion_level=i % 7 / 4,
                weather_severity=None if i % 5 == 0 else i % 9 / 8,
                eta_variation_minutes=i % 40 + 0.25,
            )
        )
    return events_frame(spark, *events)


def test_region_mart_by_hand(spark):
    mart = marts.mart_region_delay(
        events_frame(
            spark,
            payload(event_id="a", delay_probability=0.9, risk_classification="HIGH", eta_variation_minutes=10.0),
            payload(event_id="b", delay_probability=0.2, eta_variation_minutes=20.0),
            payload(event_id="c", delay_probability=None, eta_variation_minutes=None),
        )
    )
    row = mart.first()
    assert mart.count() == 1
    assert (row.total_event_count, row.delayed_event_count, row.high_risk_count) == (3, 1, 1)
    assert row.delay_rate == 0.3333
    assert row.avg_delay_probability == 0.55 and row.avg_eta_variation_minutes == 15.0


def test_each_mart_counts_every_event(spark):
    events = some_events(spark)
    for mart, name in (
        (marts.mart_region_delay(events), "total_event_count"),
        (marts.mart_hub_performance(events), "total_event_count"),
        (marts.mart_risk_summary(events), "event_count"),
    ):
        assert mart.groupBy().sum(name).first()[0] == 120


def test_grouping_sets_equal_the_single_marts(spark, rows):
    events = some_events(spark)
    split = marts.split_marts(marts.mart_grouping_sets(marts.mart_base(events)))
    for name in marts.MARTS:
        single = marts.build_mart(name, events)
        assert split[name].columns == single.columns
        close = lambda df: rows(df.select([F.round(c, 9) if c.startswith("avg_") else c for c in df.columns if c != "created_at"]))
        assert close(split[name]) == close(single)


def test_rates_over_all_dates_come_from_counts(spark):
    mart = spark.createDataFrame(
        [("2024-01-01", "R", 1, 1), ("2024-01-02", "R", 9, 0)],
        "event_date string, destination_region_id string, total_event_count long, delayed_event_count long",
    )
    assert kpi.kpi_rate(mart, "destination_region_id").first().delay_rate == 0.1


def test_kpi_denominators(spark):
    metrics = spark.createDataFrame(
        [(at(0), 60.0, 30.0, True), (at(0), 120.0, -10.0, False), (None, None, None, False), (None, None, None, False)],
        "delivered_time timestamp, total_delivery_minutes double, delay_minutes double, is_delayed boolean",
    )
    row = kpi.kpi_summary(metrics).first()
    assert (row.shipment_count, row.delivered_count, row.delayed_count) == (4, 2, 1)
    assert (row.avg_delivery_minutes, row.avg_delay_minutes, row.avg_late_minutes) == (90.0, 10.0, 30.0)
    assert (row.delay_rate, row.delivered_delay_rate) == (0.25, 0.5)


def test_kpi_without_deliveries(spark):
    metrics = spark.createDataFrame(
        [(None, None, None, False)],
        "delivered_time timestamp, total_delivery_minutes double, delay_minutes double, is_delayed boolean",
    )
    row = kpi.kpi_summary(metrics).first()
    assert row.avg_delivery_minutes is None and row.delivered_delay_rate is None


def test_risk_shares(spark):
    mart = spark.createDataFrame(
        [("LOW", 2), ("LOW", 1), ("HIGH", 1)], "risk_classification string, event_count long"
    )
    shares = {row.risk_classification: row.event_share for row in kpi.kpi_risk_share(mart).collect()}
    assert shares == {"LOW": 0.75, "HIGH": 0.25}
