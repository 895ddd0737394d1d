"""Logs of mergeable rows, the status that follows a stream, metrics by slices, bounded runs of the batch."""

import datetime as dt
import random
import threading

import pytest
from helpers import at, events_frame, payload, raw_frame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shipflow import constants as C
from shipflow import schemas as S
from shipflow import session
from shipflow.operators import cleanse, flow, metrics
from shipflow.plans import batch, incremental
from shipflow.sources import layers, topic
from shipflow.sources.files import Folder, plain_path
from shipflow.sources.state_log import StateLog, latest
from shipflow.streaming import ingest, status

COUNTS = StructType().add("k", "string").add("n", "long")


def summed(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


# ---- stored tables and folders


def test_recorders_can_be_nested_and_do_not_meet_between_threads(spark):
    one = spark.range(3)
    seen = {}

    def work(name):
        with session.recorded() as paths:
            session.stored(one, name)
            seen[name] = paths

    with session.recorded() as outer:
        with session.recorded() as inner:
            session.stored(one, "inner")
        session.stored(one, "outer")
        threads = [threading.Thread(target=work, args=(f"t{i}",)) for i in range(3)]
        for thread in threads:
            thread.start()
        for thread in threads:
            thread.join()
    assert (len(outer), len(inner)) == (2, 1) and set(inner) <= set(outer)
    assert {name: len(paths) for name, paths in seen.items()} == {"t0": 1, "t1": 1, "t2": 1}
    assert len({path for paths in seen.values() for path in paths} | set(outer)) == 5


def test_own_tables_go_when_the_work_ends(spark):
    with pytest.raises(RuntimeError), session.own_tables():
        path = session.stored(spark.range(3), "gone").inputFiles()[0].rsplit("/", 1)[0]
        assert Folder(spark, path).exists()
        raise RuntimeError
    assert not Folder(spark, path).exists()


def test_folders(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/a b+c%")
    assert folder.names() == [] and not folder.exists()
    spark.range(2).withColumn("d", F.lit("x y")).coalesce(1).write.partitionBy("d").parquet(folder.path)
    frame = spark.read.parquet(folder.path)
    assert folder.names() == ["_SUCCESS", "d=x y"]
    file = plain_path(frame.inputFiles()[0])
    assert folder.size_of(file) > 0 and spark.read.parquet(file).count() == 2
    folder.delete("d=x y")
    folder.delete("d=x y")
    assert folder.names() == ["_SUCCESS"]
    with pytest.raises(ValueError):
        folder.delete("")


# ---- the log


def test_log_merges_generations(spark, tmp_path, rows):
    log = StateLog(spark, str(tmp_path / "log"), COUNTS)
    assert log.read().count() == 0 and log.read().columns == ["k", "n", "generation"]
    parts = [[("a", 1), ("b", 2)], [("a", 10)], [("c", 5), ("b", 1)]]
    for number, part in enumerate(parts):
        log.append(spark.createDataFrame(part, COUNTS), number)
    assert rows(summed(log.read())) == [("a", 11), ("b", 3), ("c", 5)]
    assert rows(summed(log.read(before=2))) == [("a", 11), ("b", 2)]
    assert rows(log.one(1)) == [("a", 10)]
    log.append(spark.createDataFrame([("c", 7)], COUNTS), 2)  # the last one can be written again
    assert rows(summed(log.read())) == [("a", 11), ("b", 2), ("c", 7)]
    with pytest.raises(ValueError, match="comes before"):
        log.append(spark.createDataFrame([], COUNTS), 1)


def test_log_ignores_what_was_cut_short(spark, tmp_path, rows):
    log = StateLog(spark, str(tmp_path / "log"), COUNTS)
    log.append(spark.createDataFrame([("a", 1)], COUNTS), 0)
    log.append(spark.createDataFrame([("a", 2)], COUNTS), 1)
    (tmp_path / "log" / "generation=1" / "_SUCCESS").unlink()
    assert rows(summed(log.read())) == [("a", 1)]
    log.append(spark.createDataFrame([("a", 4)], COUNTS), 1)
    assert rows(summed(log.read())) == [("a", 5)]


def test_log_folds(spark, tmp_path, rows):
    log = StateLog(spark, str(tmp_path / "log"), COUNTS)
    log.fold(summed)
    for number in range(4):
        log.append(spark.createDataFrame([("a", 1), (f"k{number}", number)], COUNTS), number)
    before = rows(summed(log.read()))
    log.fold(summed)
    assert log.generations() == (3, []) and rows(log.read().drop("generation")) == before
    assert log.generations(before=3) == (None, [0, 1, 2])  # a repeated last generation reads what it read at first
    log.append(spark.createDataFrame([("a", 1)], COUNTS), 4)
    assert log.generations() == (3, [4]) and dict(rows(summed(log.read())))["a"] == 5
    log.drop_folded()
    assert log.folder.names() == ["base=3", "generation=3", "generation=4"]
    assert dict(rows(summed(log.read())))["a"] == 5


def test_latest_row_of_each_key(spark, tmp_path, rows):
    log = StateLog(spark, str(tmp_path / "log"), COUNTS)
    for number, part in enumerate([[("a", 1), ("b", 2)], [("a", None)], [("b", 7)]]):
        log.append(spark.createDataFrame(part, COUNTS), number)
    assert rows(latest(log.read(), "k")) == [("a", None), ("b", 7)]


# ---- status that follows a stream


def copies(count=400, seed=5):
    """Copies of events in random arrival order; some events change their shipment from copy to copy."""
    draw = random.Random(seed)
    texts = []
    for _ in range(count):
        event = draw.randrange(count // 3)
        owner = draw.randrange(25) if event % 20 == 0 else event % 25
        step = draw.randint(1, 7)
        texts.append(
            payload(event_id=f"E{event}", shipment_id=f"S{owner}", event_sequence=step if draw.random() > 0.05 else None,
                    event_status=C.STATUSES[step - 1], event_timestamp=at(draw.randint(0, 500)).isoformat())
        )
    return [*texts, "not json", None]


@pytest.mark.parametrize("fold_every", [2])
def test_status_by_batches_is_that_of_the_batch(spark, tmp_path, rows, fold_every):
    raw = raw_frame(spark, *copies()).withColumn("kafka_timestamp", F.timestamp_seconds(F.pmod(F.xxhash64("kafka_offset"), F.lit(1000))))
    expected = lambda part: rows(flow.current_status(cleanse.processed_events(part)))
    seen, path = raw.limit(0), str(tmp_path / "status")
    for number in range(4):
        part = raw.filter(F.col("kafka_offset") % 4 == number)
        seen = seen.unionByName(part)
        for _ in range(2):  # a batch that is run again changes nothing
            status.merge_batch(part, path, number, fold_every)
        assert rows(status.current_statuses(spark, path)) == expected(seen)


def test_late_events_do_not_move_a_status_back(spark, tmp_path, rows):
    path = str(tmp_path / "status")
    event = lambda step, **more: payload(event_id=f"E{step}", event_sequence=step, event_status=C.STATUSES[step - 1], **more)
    status.merge_batch(raw_frame(spark, event(5)), path, 0)
    status.merge_batch(raw_frame(spark, event(2), event(3)), path, 1)
    assert [row[1] for row in rows(status.current_statuses(spark, path))] == ["ARRIVED_HUB"]
    touched = status.status_log(spark, path)
    status.merge_batch(raw_frame(spark, payload(event_id="other", shipment_id="S2")), path, 2)
    assert [row[0] for row in rows(touched.one(2))] == ["S2"]  # S1 is neither read back nor written


def test_a_shipment_can_lose_its_only_event(spark, tmp_path, rows):
    path = str(tmp_path / "status")
    late = raw_frame(spark, payload(event_id="E", shipment_id="S1")).withColumn("kafka_timestamp", F.lit(at(10)))
    early = raw_frame(spark, payload(event_id="E", shipment_id="S2")).withColumn("kafka_timestamp", F.lit(at(1)))
    status.merge_batch(late, path, 0)
    assert [row[0] for row in rows(status.current_statuses(spark, path))] == ["S1"]
    status.merge_batch(early, path, 1)
    assert [row[0] for row in rows(status.current_statuses(spark, path))] == ["S2"]


def test_status_stream_goes_on_after_restarts(spark, tmp_path, rows):
    texts = copies(60)
    raw = raw_frame(spark, *texts)
    records = raw.select(
        F.col("kafka_key").cast("binary").alias("key"), F.col("raw_payload").cast("binary").alias("value"),
        F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"), F.col("kafka_timestamp").alias("timestamp"),
    )
    arrivals, path, checkpoint = (str(tmp_path / name) for name in ("arrivals", "status", "checkpoint"))
    for third in range(3):
        records.filter(F.col("offset") % 3 == third).coalesce(1).write.mode("append").parquet(arrivals)
        for _ in range(2):
            status.follow(topic.file_stream(spark, arrivals, 1), path, checkpoint, ingest.UNTIL_CAUGHT_UP).awaitTermination()
    assert rows(status.current_statuses(spark, path)) == rows(flow.current_status(cleanse.processed_events(raw)))


# ---- metrics by slices


def days_of_events(spark, days=5, per_day=60, seed=3):
    draw = random.Random(seed)
    rows = [
        payload(
            event_id=f"E{day}-{i}", shipment_id=f"S{draw.randrange(30) + 10 * day:03d}", event_sequence=draw.choice([None, 1, 2, 7]),
            event_timestamp=at(1440 * day + draw.randrange(600)).isoformat(), event_status=draw.choice(C.STATUSES),
            delay_probability=draw.choice([None, draw.random()]), risk_classification=draw.choice(["LOW", "MEDIUM", "HIGH", None]),
            driver_id=draw.choice([None, "DRV_0001", "DRV_0002"]), weather_severity=draw.choice([None, 3.0]),
            exception_type=draw.choice([None, "BAD_WEATHER"]),
        )
        for day in range(days)
        for i in range(per_day)
    ]
    return events_frame(spark, *rows)


def compared(df, rows):
    return rows(df.withColumns({name: F.round(name, 9) for name in df.columns if name.startswith("avg_")}).drop("created_at"))


@pytest.mark.parametrize("fold_every", [2])
def test_slices_add_up_to_the_full_run(spark, tmp_path, rows, fold_every):
    events, path = days_of_events(spark).cache(), str(tmp_path / "metrics")
    for number in range(5):
        part = events.filter(F.col("event_date") == dt.date(2024, 3, 1 + number))
        for _ in range(2):  # run again
            published = incremental.add_events(part, path, number, fold_every)
        touched = part.select("shipment_id").distinct()
        so_far = events.filter(F.col("event_date") <= dt.date(2024, 3, 1 + number))
        full = metrics.shipment_metrics(so_far)
        assert compared(published, rows) == compared(full.join(touched, "shipment_id", "left_semi"), rows)
        assert compared(incremental.current_metrics(spark, path), rows) == compared(full, rows)


def test_only_touched_shipments_are_read_back(spark, tmp_path):
    events, path = days_of_events(spark, days=3), str(tmp_path / "metrics")
    for number in range(3):
        incremental.add_events(events.filter(F.dayofmonth("event_date") == 1 + number), path, number)
    log = incremental.state_log(spark, path)
    held = incremental.touched_states(log, 2)
    touched = {row.shipment_id for row in log.one(2).collect()}
    assert {row.shipment_id for row in held.collect()} == touched < {row.shipment_id for row in log.read().collect()}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(shipment_id), GreaterThanOrEqual(shipment_id,S0" in plan


def test_slices_without_events_or_shipments(spark, tmp_path, rows):
    path = str(tmp_path / "metrics")
    none = days_of_events(spark, days=1).limit(0)
    assert incremental.add_events(none, path, 0).count() == 0
    lost = events_frame(spark, payload()).withColumn("shipment_id", F.lit(None).cast("string"))
    assert incremental.add_events(lost, path, 1).count() == 0
    assert incremental.add_events(events_frame(spark, payload()), path, 2).count() == 1
    assert incremental.current_metrics(spark, path).count() == 1


# ---- bounded runs


DAY = lambda n: dt.date(2024, 3, n)


def copy_of(spark, event_id, day, arrival, **more):
    frame = raw_frame(spark, payload(event_id=event_id, event_timestamp=f"2024-03-{day:02d}T08:00:00", **more))
    return frame.withColumns({"kafka_timestamp": F.lit(at(arrival)), "kafka_offset": F.lit(arrival).cast("long")})


def add(frame, path):
    frame.write.mode("append").partitionBy("event_date").parquet(path)


def held(spark, path, rows):
    return rows(layers.read_processed(spark, path).drop("processed_at"))


def test_a_bounded_run_clears_dates_that_lose_their_last_event(spark, tmp_path, rows):
    raw, bounded, full = (str(tmp_path / name) for name in ("raw", "bounded", "full"))
    for event, day, arrival in (("a", 1, 10), ("b", 2, 20), ("c", 2, 30), ("d", 4, 35)):
        add(copy_of(spark, event, day, arrival), raw)
    batch.build_processed(spark, raw, bounded)
    untouched = {file.name: file.stat().st_mtime_ns for file in (tmp_path / "bounded" / "event_date=2024-03-04").glob("*.parquet")}
    add(copy_of(spark, "a", 3, 1), raw)  # the copy on day 3 came first: day 1 loses its only event
    add(copy_of(spark, "e", 3, 40), raw)
    assert batch.rebuild_dates(spark, raw, bounded, first_date=DAY(3), last_date=DAY(3)) == [DAY(1), DAY(3)]
    batch.build_processed(spark, raw, full)
    assert held(spark, bounded, rows) == held(spark, full, rows)
    assert sorted(p.name for p in (tmp_path / "bounded").glob("event_date=*")) == [f"event_date=2024-03-0{n}" for n in (2, 3, 4)]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "bounded" / "event_date=2024-03-04").glob("*.parquet")} == untouched
    assert batch.rebuild_dates(spark, raw, bounded, first_date=DAY(3), last_date=DAY(3)) == []


def test_a_bounded_run_sees_records_that_are_gone(spark, tmp_path, rows):
    import shutil

    raw, bounded, full = (str(tmp_path / name) for name in ("raw", "bounded", "full"))
    for event, day, arrival in (("a", 1, 10), ("a", 2, 5), ("b", 2, 20), ("c", 1, 30)):
        add(copy_of(spark, event, day, arrival), raw)
    batch.build_processed(spark, raw, bounded)
    shutil.rmtree(tmp_path / "raw" / "event_date=2024-03-02")  # a falls back to its copy on day 1
    assert batch.rebuild_dates(spark, raw, bounded, first_date=DAY(2), last_date=DAY(2)) == [DAY(1), DAY(2)]
    batch.build_processed(spark, raw, full)
    assert held(spark, bounded, rows) == held(spark, full, rows)
    with pytest.raises(ValueError, match="no rows in: raw"):
        batch.build_processed(spark, raw, bounded, DAY(20), DAY(21))


def test_bounded_runs_in_any_order_equal_the_full_one(spark, tmp_path, rows):
    draw = random.Random(9)
    raw, bounded, full = (str(tmp_path / name) for name in ("raw", "bounded", "full"))
    arrivals = list(range(60))
    draw.shuffle(arrivals)
    parts = [[(f"e{draw.randrange(25)}", draw.randint(1, 6), arrivals.pop()) for _ in range(20)] for _ in range(3)]
    for i, part in enumerate(parts):
        frames = [copy_of(spark, *row, event_sequence=row[2] % 7) for row in part]
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        add(whole, raw)
        if i == 0:
            batch.build_processed(spark, raw, bounded)
        else:
            days = sorted({row[1] for row in part})
            batch.build_processed(spark, raw, bounded, DAY(days[0]), DAY(days[-1]))
        batch.build_processed(spark, raw, full)
        assert held(spark, bounded, rows) == held(spark, full, rows)
