"""Topic, streaming ingest, stored layers, JDBC options, the batch."""

import datetime as dt
import json

import pytest
from helpers import at, events_frame, payload, raw_frame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow import session
from shipflow.operators import cleanse
from shipflow.plans import batch
from shipflow.sources import jdbc, layers, topic
from shipflow.streaming import ingest


def envelope(spark, texts, first_offset=0):
    rows = [
        (b"S1", text.encode() if text is not None else None, "delivery_events", 0, first_offset + i, at(i))
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, S.ENVELOPE)


def texts(count=10):
    good = [json.dumps(payload(event_id=f"E{i}", event_timestamp=at(i * 700).isoformat())) for i in range(count)]
    return [*good, "not json", json.dumps(payload(event_id="late", event_timestamp="???")), None]


def test_encoded_events_decode_to_themselves(spark):
    events = cleanse.valid_events(
        raw_frame(spark, payload(cargo_type="신선식품", event_timestamp="2024-03-01T08:00:00.25", latitude=37.5665, route_step=2))
    ).drop(*S.ARRIVAL_ORDER)
    record = topic.encode_events(events).first()
    decoded = json.loads(record.value)
    assert record.key == "S1" and list(decoded) == S.PAYLOAD_COLUMNS
    assert decoded["cargo_type"] == "신선식품" and decoded["exception_type"] is None
    assert dt.datetime.fromisoformat(decoded["event_timestamp"]) == dt.datetime(2024, 3, 1, 8, 0, 0, 250000)
    again = cleanse.type_times(cleanse.decode(topic.encode_events(events).select(F.col("value").alias("raw_payload"))))
    assert again.collect() == events.collect()


def run_stream(spark, folder, max_files=1):
    stream = topic.file_stream(spark, f"{folder}/arrivals", max_files)
    query = ingest.ingest(stream, f"{folder}/raw", f"{folder}/checkpoint", ingest.UNTIL_CAUGHT_UP)
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_restart_adds_nothing_twice(spark, tmp_path, rows):
    folder = str(tmp_path)
    first = envelope(spark, texts())
    first.repartition(3).write.parquet(f"{folder}/arrivals")
    query = run_stream(spark, folder)
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 3  # one file each
    layer = layers.read_raw(spark, f"{folder}/raw").select(*S.RAW_COLUMNS).drop("ingested_at")
    assert rows(layer) == rows(ingest.to_raw(first).drop("ingested_at"))

    run_stream(spark, folder)
    assert layers.read_raw(spark, f"{folder}/raw").count() == 13

    envelope(spark, texts(2), first_offset=100).coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
    run_stream(spark, folder)
    assert layers.read_raw(spark, f"{folder}/raw").count() == 13 + 5


def test_late_and_unreadable_times(spark, tmp_path):
    folder = str(tmp_path)
    envelope(spark, texts()).write.parquet(f"{folder}/arrivals")
    run_stream(spark, folder, max_files=10)
    layer = layers.read_raw(spark, f"{folder}/raw")
    assert layer.filter("event_date IS NULL").count() == 3
    assert (tmp_path / "raw" / "event_date=__HIVE_DEFAULT_PARTITION__").is_dir()
    assert layer.select("event_date").distinct().count() == 1 + 5


def test_kafka_source_options(spark):
    options = topic.kafka_read_options("broker:9092", "delivery_events")
    assert options["startingOffsets"] == "latest" and "maxOffsetsPerTrigger" not in options
    assert topic.kafka_read_options("h:1", "t", max_offsets=5000)["maxOffsetsPerTrigger"] == "5000"
    try:
        topic.kafka_stream(spark, "broker:9092", "delivery_events")
    except AnalysisException as error:  # the connector is not on every session
        assert "kafka" in str(error).lower()


def many_days(spark, days=4, per_day=50):
    return cleanse.processed_events(
        raw_frame(
            spark,
            *[
                payload(
                    event_id=f"E{d}-{i}",
                    shipment_id=f"S{i * 7 % per_day}",
                    event_sequence=i % 7 + 1,
                    event_timestamp=at(d * 1440 + i).isoformat(),
                )
                for d in range(days)
                for i in range(per_day)
            ],
        )
    )


def test_processed_layer_is_sorted_and_reads_back(spark, tmp_path, rows):
    path = str(tmp_path / "processed")
    events = many_days(spark).drop("processed_at").withColumn("processed_at", F.lit(at(0)))
    layers.write_processed(events, path)
    layer = layers.read_processed(spark, path)
    assert rows(layer.select(*events.columns)) == rows(events)
    files = [f for f in (tmp_path / "processed").rglob("*.parquet")]
    assert len(files) == 4  # one per date
    for file in files:
        read = [tuple(r) for r in spark.read.parquet(str(file)).select("shipment_id", *S.EVENT_ORDER).collect()]
        assert read == sorted(read)


def test_large_date_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "processed")
    events = many_days(spark, days=1, per_day=4000).repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        layers.write_processed(events, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "processed").rglob("*.parquet"))) > 2
    assert layers.read_processed(spark, path).count() == 4000


def test_date_range_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "processed")
    layers.write_processed(many_days(spark), path)
    day = dt.date(2024, 3, 2)
    layer = layers.read_processed(spark, path, first_date=day, last_date=day)
    assert layer.count() == 50
    plan = layer.select("delay_probability")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "ReadSchema: struct<delay_probability:double>" in plan


def test_only_touched_dates_are_replaced(spark, tmp_path):
    path = str(tmp_path / "processed")
    layers.write_processed(many_days(spark, days=3), path)
    day = dt.date(2024, 3, 2)
    layers.write_processed(many_days(spark, days=2, per_day=5).filter(F.col("event_date") == day), path, only_touched_dates=True)
    counts = {r.event_date: r["count"] for r in layers.read_processed(spark, path).groupBy("event_date").count().collect()}
    assert counts == {dt.date(2024, 3, 1): 50, day: 5, dt.date(2024, 3, 3): 50}


def test_jdbc_options(spark):
    database = jdbc.Database("jdbc:postgresql://db:5432/logistics", "u", "p")
    options = jdbc.load_options(database, "mart_region_delay", connections=4)
    assert options["truncate"] == "true" and options["numPartitions"] == "4"
    assert options["dbtable"] == "mart_region_delay" and options["driver"] == "org.postgresql.Driver"
    whole = jdbc.read_options(database, "driver")
    assert "numPartitions" not in whole
    parts = jdbc.read_options(database, "driver", "number", 1, 300, 8)
    assert (parts["partitionColumn"], parts["lowerBound"], parts["upperBound"], parts["numPartitions"]) == ("number", "1", "300", "8")


def test_a_load_moves_only_result_rows(spark):
    counted = spark.range(1000).groupBy("id").count()
    loaded = jdbc.to_load(counted, 3)
    assert loaded.rdd.getNumPartitions() == 3
    plan = loaded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Repartition 3, true")
    assert dict(loaded.dtypes)["count"] == "bigint"


def test_batch_can_be_run_again(spark, tmp_path, rows):
    raw, processed = str(tmp_path / "raw"), str(tmp_path / "processed")
    ingest.to_raw(envelope(spark, texts() + texts(3))).write.partitionBy("event_date").parquet(raw)

    def run():
        published = {}
        batch.run_batch(spark, raw, processed, lambda df, name: published.update({name: rows(df.drop("created_at"))}))
        return published

    first = run()
    assert set(first) == {"shipment_metrics", "mart_region_delay", "mart_hub_performance", "mart_risk_summary"}
    assert layers.read_processed(spark, processed).count() == 10
    assert sum(row[2] for row in first["mart_risk_summary"]) == 10
    assert run() == first


def test_bounded_run_equals_the_full_one(spark, tmp_path, rows):
    raw, full, bounded = (str(tmp_path / name) for name in ("raw", "full", "bounded"))
    day = lambda n, **more: payload(event_timestamp=f"2024-03-0{n}T08:00:00", **more)
    events = [day(1, event_id="a"), day(2, event_id="a"), day(2, event_id="b"), day(3, event_id="b"), day(3, event_id="c")]
    records = topic.encode_events(events_frame(spark, *events), keep=["event_id", "event_timestamp"])
    # b arrives first with its later date; a with its earlier one
    order = F.when(F.col("event_id") == "b", -F.unix_timestamp("event_timestamp")).otherwise(F.unix_timestamp("event_timestamp"))
    records = records.selectExpr("CAST(key AS BINARY) key", "CAST(value AS BINARY) value", "'t' topic", "0 AS partition", "event_id", "event_timestamp")
    records = records.withColumn("offset", order).withColumn("timestamp", F.timestamp_seconds(order)).drop("event_id", "event_timestamp")
    ingest.to_raw(records).write.partitionBy("event_date").parquet(raw)
    batch.build_processed(spark, raw, full)
    for n in (1, 2, 3):
        batch.build_processed(spark, raw, bounded, dt.date(2024, 3, n), dt.date(2024, 3, n))
    pick = lambda path: rows(layers.read_processed(spark, path).select("event_id", "event_date"))
    assert pick(bounded) == pick(full) == rows(spark.createDataFrame([("a", dt.date(2024, 3, 1)), ("b", dt.date(2024, 3, 3)), ("c", dt.date(2024, 3, 3))], "i string, d date"))


def test_raw_records_are_filtered_before_they_are_decoded(spark, tmp_path):
    path = str(tmp_path / "raw")
    ingest.to_raw(envelope(spark, texts())).write.partitionBy("event_date").parquet(path)
    plan = cleanse.valid_events(layers.read_raw(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(event_id)" in plan
    plan = ingest.to_raw(envelope(spark, texts()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan


def test_batch_guards(spark, tmp_path):
    path = str(tmp_path / "raw")
    with pytest.raises(ValueError, match="must not replace"):
        batch.build_processed(spark, path, path + "/")
    spark.createDataFrame([], S.RAW).write.parquet(path)
    with pytest.raises(ValueError, match="no rows in: raw"):
        batch.build_processed(spark, path, str(tmp_path / "processed"))


def test_shared_path_follows_the_session(spark):
    root = spark.conf.get(session.CHECKPOINT_DIR, None)
    path = session.shared_path(spark, "x")
    assert path != session.shared_path(spark, "x")
    if root:
        assert path.startswith(root.rstrip("/") + "/")


def test_shuffles_grow_with_the_input(spark):
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    for size, expected in ((1000, int(before)), (100 * 2**30, 400), (100 * 2**40, 409_600)):
        with session.sized_shuffles(spark, size) as partitions:
            assert partitions == expected == int(spark.conf.get(setting))
        assert spark.conf.get(setting) == before
