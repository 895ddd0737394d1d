"""What grows with the tables: widths of shuffles, files of the layers, columns that are stored."""

import datetime as dt
from pathlib import Path

from helpers import at, payload, raw_frame
from shipflow.plans import batch, checked
from shipflow.sources import compaction, layers
from shipflow.streaming import ingest
from shipflow_queries import queries, tables

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_dealt_while_they_are_narrow(spark, monkeypatch):
    assert "RoundRobin" not in plan(tables.envelope(spark, SMALL))
    few = tables.envelope(spark, SMALL)
    monkeypatch.setattr(tables, "RECORDS_PER_TASK", 500, raising=False)
    many = tables.envelope(spark, SMALL)
    assert many.rdd.getNumPartitions() >= 12 > few.rdd.getNumPartitions()
    assert sorted(many.collect()) == sorted(few.collect())


def test_a_compaction_shuffles_and_sorts_no_row_and_has_a_task_per_group(spark, tmp_path, monkeypatch):
    raw = ingest.to_raw(tables.envelope(spark, SMALL))
    path, seen = str(tmp_path / "raw"), []
    for _ in range(2):
        raw.limit(400).write.mode("append").partitionBy("event_date").parquet(path)
    write = layers.write_raw

    def watched(rows, *args):
        seen.append((plan(rows), rows.rdd.getNumPartitions()))
        write(rows, *args)

    monkeypatch.setattr(layers, "write_raw", watched, raising=False)
    compacted = compaction.CompactedRaw(spark, path, str(tmp_path / "compacted"))
    n_groups = len(compacted.groups(compacted.files(), compaction.TARGET_BYTES))
    assert n_groups > 4 and compacted.compact() > n_groups
    assert [tasks for _, tasks in seen] == [n_groups]
    assert all("Exchange" not in text and "Sort" not in text for text, _ in seen)
    assert compacted.read().count() == 800 and len(compacted.files()) == n_groups


def test_only_columns_that_are_read_are_stored(spark, monkeypatch):
    kept = []
    write = queries.stored

    def watched(df, name, **options):
        kept.append(set(df.columns))
        return write(df, name, **options)

    monkeypatch.setattr(queries, "stored", watched)
    assert queries.QUERIES["shipment_dispatch"](spark, SMALL).count() > 0
    assert "shipment_id" in kept[0] and not kept[0] & {"is_created", "event_hour", "weather_severity"}


def test_copies_of_an_event_meet_as_lines(spark):
    text = plan(tables.unique_events(spark, SMALL))
    assert "concat(DSP_" in text.split("Window [")[0] and "concat(DSP_" not in text.split("Window [", 1)[1]
    assert sorted(tables.unique_events(spark, SMALL).collect(), key=repr) == sorted(
        queries.cleanse.first_arrivals(tables.event_copies(spark, SMALL)).select(*queries.S.PAYLOAD_COLUMNS).collect(), key=repr
    )


def test_slices_store_only_columns_that_metrics_read(spark, monkeypatch):
    kept = []
    write = queries.stored

    def watched(df, name, **options):
        kept.append(set(df.columns))
        return write(df, name, **options)

    monkeypatch.setattr(queries, "stored", watched)
    assert queries.QUERIES["shipment_metrics_incremental"](spark, SMALL).count() > 0
    assert "shipment_id" in kept[0] and not kept[0] & {"is_created", "event_hour", "cargo_type", "latitude"}


def test_processed_events_moves_an_event_once_from_bounded_tasks(spark, monkeypatch):
    """Lines are dealt before they are events; events only meet after each task has dropped its own later copies."""
    text = plan(queries.QUERIES["processed_events"](spark, SMALL))
    assert "RoundRobin" not in text
    flags, events, lines = text.split("Exchange hashpartitioning(")
    assert "WindowGroupLimit" in events and "from_json" in events
    assert "from_json" not in flags + lines and "concat(SHP_" in events and "concat(SHP_" not in flags + lines
    monkeypatch.setattr(tables, "RECORDS_PER_TASK", 500, raising=False)
    usable = queries.cleanse.valid_events(ingest.to_raw(tables.envelope(spark, SMALL)))
    assert usable.rdd.getNumPartitions() >= 12  # that sort events on the way to the shuffle


def test_a_bounded_run_decodes_and_shuffles_records_of_its_events_only(spark, tmp_path, monkeypatch):
    raw, processed, plans, seen = str(tmp_path / "raw"), str(tmp_path / "processed"), {}, []
    of_day = [payload(event_id=f"e{i}", event_timestamp=at(i * 12).isoformat()) for i in range(1200)]
    raw_frame(spark, *of_day).write.partitionBy("event_date").parquet(raw)
    batch.build_processed(spark, raw, processed)
    store, compare = batch.stored, batch.changed_dates

    def watched(df, name, **options):
        plans[name] = plan(df)
        return store(df, name, **options)

    def compared(before, after):
        seen.append((before.columns, before.count()))
        return compare(before, after)

    monkeypatch.setattr(batch, "stored", watched)
    monkeypatch.setattr(batch, "changed_dates", compared)
    day = dt.date(2024, 3, 2)
    assert batch.rebuild_dates(spark, raw, processed, first_date=day, last_date=day) == []
    assert seen == [(["event_id", "event_date", "a", "b"], 120)]
    text = plans["decided"]  # records of other events go before they are decoded, and what is joined is decoded
    assert text.index("LeftSemi") < text.index("from_json") < text.index("bitmap")


def test_records_are_written_by_few_tasks_whatever_the_shuffles_have(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = tables.envelope(spark, SMALL)
        assert records.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_events_are_laid_out_by_date_without_a_shuffle(spark, tmp_path, monkeypatch, rows):
    path, seen, paths = str(tmp_path / "processed"), [], []
    of_days = [payload(event_id=f"e{i}", event_timestamp=at(i * 480).isoformat()) for i in range(9)]
    events = queries.cleanse.flag_events(queries.cleanse.valid_events(raw_frame(spark, *of_days)).drop(*queries.S.ARRIVAL_ORDER))
    events = events.selectExpr("*", "timestamp'2024-01-01' AS processed_at").repartition(3)
    events = events.unionByName(events.limit(1).selectExpr("* EXCEPT (event_date)", "CAST(NULL AS DATE) AS event_date"))
    write, new_path = layers.write_sorted, layers.shared_path if hasattr(layers, "shared_path") else None

    def watched(arranged, *args):
        seen.append((plan(arranged), arranged.rdd.getNumPartitions()))
        write(arranged, *args)

    def noted(*args, **more):
        paths.append(new_path(*args, **more))
        return paths[-1]

    monkeypatch.setattr(layers, "write_sorted", watched)
    monkeypatch.setattr(layers, "shared_path", noted, raising=False)
    layers.write_processed(events, path)
    assert all("Exchange" not in text for text, _ in seen) and len(seen) == 1
    layer = layers.read_processed(spark, path)
    assert rows(layer.select(*events.columns)) == rows(events) and len(layer.inputFiles()) == 5  # four days and none
    assert len(paths) == 1 and not Path(paths[0].removeprefix("file:")).exists()  # what was stored on the way is gone


def test_a_checked_build_shuffles_no_event(spark, tmp_path, monkeypatch, rows):
    processed, seen, raw = str(tmp_path / "processed"), [], ingest.to_raw(tables.envelope(spark, SMALL)).limit(900).localCheckpoint()
    write = layers.write_sorted

    def watched(events, *args):
        seen.append(plan(events))
        write(events, *args)

    monkeypatch.setattr(layers, "write_sorted", watched)
    balance = checked.build_checked(spark, raw, str(tmp_path / "checked"), processed)
    assert seen and all("Exchange" not in text for text in seen)
    balance.check()
    expected = queries.cleanse.processed_events(raw).drop("processed_at")
    assert rows(layers.read_processed(spark, processed).select(*expected.columns)) == rows(expected)
    assert balance.kept == expected.count() and balance.duplicates > 0 and balance.rejected > 0
