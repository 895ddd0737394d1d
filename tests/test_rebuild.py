"""The whole layer rebuilt without a shuffle of events."""

import datetime as dt
import random

import pytest
from helpers import payload, raw_frame

from shipflow.operators import cleanse
from shipflow.plans import batch, rebuild
from shipflow.sources import layers


def records(n: int) -> list:
    """Copies on one date and on several, unusable ones before usable ones, ties of arrival come from repeated rows."""
    of = random.Random(3)
    faults = ({"shipment_id": None}, {"event_status": None}, {"event_timestamp": "?"}, {"event_id": None}, {}, {}, {}, {}, {})
    rows = []
    for _ in range(n):
        number, day = of.randrange(n // 2), of.randrange(1, 5)
        rows.append(payload(**{"event_id": f"e{number}", "shipment_id": f"s{number % 7}", "event_timestamp": f"2024-03-0{day}T08:00:00", "event_sequence": of.randrange(9)} | of.choice(faults)))
    return rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by_date", [True, False])
@pytest.mark.parametrize("rows_per_task", [10**6, 15])
def test_the_layer_is_that_of_the_shuffled_way(spark, tmp_path, rows, monkeypatch, by_date, rows_per_task):
    raw_path, path = str(tmp_path / "raw layer"), str(tmp_path / "processed")
    raw = raw_frame(spark, *records(120)).repartition(3)
    raw.write.partitionBy("event_date").parquet(raw_path) if by_date else raw.write.parquet(raw_path)
    seen = []
    write = layers.write_sorted

    def watched(events, *args):
        seen.append((plan(events), events.rdd.getNumPartitions()))
        write(events, *args)

    monkeypatch.setattr(layers, "write_sorted", watched, raising=False)
    monkeypatch.setattr(rebuild, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(rebuild, "TASKS_AT_ONCE", 6)
    batch.build_processed(spark, raw_path, path)
    expected = cleanse.processed_events(layers.read_raw(spark, raw_path))
    got = layers.read_processed(spark, path)
    assert rows(got.select(*expected.columns).drop("processed_at")) == rows(expected.drop("processed_at"))
    assert got.select("processed_at").distinct().count() == 1 and 30 < got.count() < 60
    assert seen and all("Exchange" not in text for text, _ in seen)
    if by_date and rows_per_task == 10**6:
        assert [n for _, n in seen] == [4]  # a task, and so a file, per date
        assert len(got.inputFiles()) == 4


def test_a_layer_without_usable_dates_is_emptied(spark, tmp_path):
    raw_path, path = str(tmp_path / "raw"), str(tmp_path / "processed")
    for text in (payload(), payload(event_timestamp="?")):
        raw_frame(spark, text).write.mode("overwrite").partitionBy("event_date").parquet(raw_path)
        batch.build_processed(spark, raw_path, path)
        assert layers.read_processed(spark, path).count() == (text["event_timestamp"] != "?")


def test_tasks_hold_one_date_and_few_rows():
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    files = [(second, "d", 3), (first, "a", 4), (first, "b", 5), (first, "c", 25)]
    tasks, first_task = rebuild.tasks_of(files, 10)
    assert [(t.files, t.first, t.end) for t in tasks] == [
        (("a", "b"), 0, None), (("c",), 0, 10), (("c",), 10, 20), (("c",), 20, 30), (("d",), 0, None),
    ]
    assert first_task == {"a": 0, "b": 0, "c": 1, "d": 4}


def test_layers_are_listed_once_for_all_tasks(spark, tmp_path, rows, monkeypatch):
    """Not by a reader per task, and names of any kind are found."""
    raw_path, path = str(tmp_path / "it's a layer %20"), str(tmp_path / "processed")
    raw_frame(spark, *records(60)).write.partitionBy("event_date").parquet(raw_path)
    raw = layers.read_raw(spark, raw_path)
    expected = rows(cleanse.processed_events(raw).drop("processed_at"))
    reader, readers = type(spark).read.fget, []
    monkeypatch.setattr(type(spark), "read", property(lambda self: readers.append(1) or reader(self)))
    rebuild.rebuild(spark, raw, raw_path, path, rows_per_task=10)
    assert len(readers) == 1
    got = layers.read_processed(spark, path)
    assert rows(got.select(*cleanse.processed_events(raw).columns).drop("processed_at")) == expected


def test_single_partitions_are_joined_as_they_are_in_a_large_layer(spark, tmp_path, monkeypatch):
    raw_path, path, seen = str(tmp_path / "raw"), str(tmp_path / "processed"), []
    raw_frame(spark, *records(60)).write.partitionBy("event_date").parquet(raw_path)
    write = layers.write_sorted
    monkeypatch.setattr(layers, "write_sorted", lambda events, *args: seen.append(plan(events)) or write(events, *args))
    before = spark.conf.get("spark.sql.maxSinglePartitionBytes")
    spark.conf.set("spark.sql.maxSinglePartitionBytes", "1")  # any layer is large
    try:
        batch.build_processed(spark, raw_path, path)
        assert spark.conf.get("spark.sql.maxSinglePartitionBytes") == "1"
    finally:
        spark.conf.set("spark.sql.maxSinglePartitionBytes", before)
    assert seen and all("Join" in text and "Exchange" not in text for text in seen)
