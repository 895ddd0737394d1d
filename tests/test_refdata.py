import pytest

from shipflow import schemas as S
from shipflow.functions import numbers
from shipflow.operators import refdata
from shipflow.sources import reference_csv

GOOD = {
    "timestamp": "2024-01-05 10:00:00",
    "vehicle_gps_latitude": "37.5",
    "vehicle_gps_longitude": "127.0",
    "eta_variation_hours": "0.5",
    "traffic_congestion_level": "3.25",
    "weather_condition_severity": "0.75",
    "port_congestion_level": "7",
    "delay_probability": "0.5",
    "risk_classification": "Low Risk",
    "shipping_costs": "100.5",
    "lead_time_days": "3",
    "driver_behavior_score": "0.1",
    "fatigue_monitoring_score": "0.2",
    "disruption_likelihood_score": "0.3",
    "delivery_time_deviation": "-1.5",
}


def text_frame(spark, *changes):
    rows = [tuple((GOOD | change).values()) for change in changes]
    return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in GOOD))


def cleaned(spark, *changes):
    return refdata.clean_reference(refdata.type_reference(text_frame(spark, *changes))).collect()


def test_a_good_row(spark):
    row = cleaned(spark, {})[0]
    assert row.__fields__ == S.REFERENCE_CLEAN.fieldNames()
    assert str(row.dataset_timestamp) == "2024-01-05 10:00:00"
    assert row.eta_variation_minutes == 30.0 and row.risk_classification == "LOW"
    assert row.delivery_time_deviation == -1.5


@pytest.mark.parametrize(
    ("text", "limited"),
    [("12", 10.0), ("-3", 0.0), ("n/a", 0.0), (None, 0.0), ("", 0.0), ("NaN", 0.0), (" 4.5 ", 4.5), ("inf", 10.0), ("5f", 0.0)],
)
def test_congestion(spark, text, limited):
    row = cleaned(spark, {"traffic_congestion_level": text, "port_congestion_level": text})[0]
    assert row.traffic_congestion_level == limited and row.hub_congestion_level == limited


@pytest.mark.parametrize(
    ("text", "probability"),
    [("0.7", 0.7), ("1", 1.0), ("1.5", 0.015), ("70", 0.7), ("250", 1.0), ("-0.2", 0.0), (None, 0.0), ("x", 0.0)],
)
def test_probability(spark, text, probability):
    assert cleaned(spark, {"delay_probability": text})[0].delay_probability == probability


@pytest.mark.parametrize(
    ("label", "probability", "risk"),
    [
        (" medium ", "0.9", "MEDIUM"),
        ("High Risk", "0.0", "HIGH"),
        ("low/medium/high", "0.0", "HIGH"),
        ("Moderate", "0.7", "HIGH"),
        ("Moderate", "0.4", "MEDIUM"),
        (None, "0.39", "LOW"),
        ("", "70", "HIGH"),
    ],
)
def test_risk(spark, label, probability, risk):
    row = cleaned(spark, {"risk_classification": label, "delay_probability": probability})[0]
    assert row.risk_classification == risk


def test_minutes_are_rounded_like_pandas(spark):
    hours = ["0.0333", "1.0075", "0.00225", None, "bad", "2.5"]
    minutes = sorted(row.eta_variation_minutes for row in cleaned(spark, *[{"eta_variation_hours": h} for h in hours]))
    import numpy as np

    want = sorted(float(np.round((float(h) if h not in (None, "bad") else 0.0) * 60, 2)) for h in hours)
    assert minutes == want


def test_missing_costs_become_the_median(spark):
    costs = ["10", "20", None, "40", "x", "30"]
    rows = cleaned(spark, *[{"shipping_costs": c, "lead_time_days": None} for c in costs])
    assert sorted(row.shipping_costs for row in rows) == [10.0, 20.0, 25.0, 25.0, 30.0, 40.0]
    assert {row.lead_time_days for row in rows} == {None}


def test_unreadable_time_is_null(spark):
    assert cleaned(spark, {"timestamp": "yesterday"})[0].dataset_timestamp is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="risk_classification, shipping_costs"):
        refdata.type_reference(text_frame(spark, {}).drop("shipping_costs", "risk_classification"))


def test_csv_both_ways(spark, tmp_path, rows):
    source, target = str(tmp_path / "in.csv"), str(tmp_path / "out")
    names = list(reversed(GOOD)) + ["surplus"]  # any column order, columns not asked for
    lines = [",".join(names)] + [
        ",".join([*(str(v) if v is not None else "" for v in reversed((GOOD | change).values())), "s"])
        for change in ({}, {"risk_classification": None}, {"shipping_costs": None, "timestamp": "2024-01-05 10:00:00.25"})
    ]
    (tmp_path / "in.csv").write_text("\n".join(lines), encoding="utf-8")
    clean = refdata.clean_reference(refdata.type_reference(reference_csv.read_text(spark, source)))
    reference_csv.write_clean(clean, target)
    assert rows(reference_csv.read_clean(spark, target)) == rows(clean)
    header = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8").splitlines()[0]
    assert header.split(",") == S.REFERENCE_CLEAN.fieldNames()


def test_csv_without_a_column_fails_before_any_row(spark, tmp_path):
    (tmp_path / "in.csv").write_text("timestamp\n2024-01-05", encoding="utf-8")
    with pytest.raises(ValueError, match="vehicle_gps_latitude"):
        reference_csv.read_text(spark, str(tmp_path / "in.csv"))


def test_part_files_with_another_column_order_are_refused(spark, tmp_path):
    names = list(GOOD)
    for part, columns in (("a.csv", names), ("b.csv", names[::-1])):
        lines = [",".join(columns), ",".join(GOOD[name] for name in columns)]
        (tmp_path / part).write_text("\n".join(lines), encoding="utf-8")
    with pytest.raises(Exception, match="header"):
        reference_csv.read_text(spark, str(tmp_path)).collect()


def test_nan_cells_of_the_clean_file_are_missing(spark, tmp_path):
    names = S.REFERENCE_CLEAN.fieldNames()
    cells = {"risk_classification": "LOW", "dataset_timestamp": "2024-01-05 10:00:00.000000", "shipping_costs": "7.5"}
    lines = [",".join(names), ",".join(cells.get(name, "NaN") for name in names)]
    (tmp_path / "clean.csv").write_text("\n".join(lines), encoding="utf-8")
    row = reference_csv.read_clean(spark, str(tmp_path / "clean.csv")).first()
    assert row.shipping_costs == 7.5 and row.lead_time_days is None and row.delay_probability is None


def test_defaults(spark):
    text = text_frame(spark, {"delay_probability": "x", "lead_time_days": None}, {"delay_probability": "nan"})
    defaults = {"delay_probability": 0.3, "lead_time_days": 2.25, "shipping_costs": 17500.0}
    first, second = refdata.with_defaults(text, defaults).collect()
    with pytest.raises(ValueError, match="missing columns: absent"):
        refdata.with_defaults(text, {"absent": 1.0})
    assert (first.delay_probability, first.lead_time_days, first.shipping_costs) == (0.3, 2.25, 100.5)
    assert second.delay_probability != second.delay_probability and second.lead_time_days == 3.0


def test_number_functions(spark):
    from pyspark.sql import functions as F

    texts = ["1.5", " 2 ", "-3e2", ".5", "5.", "nan", "inf", "0x1p3", "1d", "1_000", "", None, "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(numbers.to_number(F.col("t")), numbers.number_or(F.col("t"), 9.0)).collect()]
    parsed = [1.5, 2.0, -300.0, 0.5, 5.0, None, float("inf"), None, None, None, None, None, None]
    assert [g[0] for g in got] == parsed
    defaulted = [g[1] for g in got]
    assert defaulted[5] != defaulted[5]
    assert [d for i, d in enumerate(defaulted) if i != 5] == [9.0 if p is None else p for i, p in enumerate(parsed) if i != 5]
    limits = spark.createDataFrame([(None,), (-1.0,), (0.5,), (float("nan"),)], "x double")
    got = [r[0] for r in limits.select(numbers.clamp(F.col("x"), 0, 1)).collect()]
    assert got[:3] == [None, 0.0, 0.5]
    assert limits.select(numbers.nan_to_null(F.col("x"))).collect()[3][0] is None
