"""Registered queries: (spark, sf_dir) -> DataFrame over the whole test tables."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.operators import cleanse, dims, flow, kpi, lanes, marts, medians, metrics, offsets, quality, refdata
from shipflow.plans import batch, checked, incremental
from shipflow.session import shared_path, stored
from shipflow.sources import compaction, layers, reference_csv, topic
from shipflow.streaming import ingest, status
from shipflow_queries import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SLICES = ((date(2024, 1, 1), date(2024, 1, 10)), (date(2024, 1, 11), date(2024, 1, 20)), (date(2024, 1, 21), date(9999, 1, 1)))
LATE_DAYS = (date(2024, 1, 10), date(2024, 1, 12))
APPROXIMATION = 0.001  # rank error of medians
DECIMALS = 9  # of compared means: sums of doubles differ in the last bits with the order of rows


def _compared(df: DataFrame) -> DataFrame:
    """The frame with its means rounded, as the oracle has them, and without the time of the run."""
    means = {name: F.round(name, DECIMALS) for name in df.columns if name.startswith("avg_")}
    return df.withColumns(means).drop("created_at")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- topic, raw layer, decoding


@query
def event_encode(spark, sf_dir):
    """Keys, names and nulls of the JSON text, and its fields read back."""
    records = topic.encode_events(tables.unique_events(spark, sf_dir))
    names = F.json_object_keys("value")
    described = records.select(
        "key",
        F.array_join(names, ",").alias("names"),
        F.regexp_count("value", F.lit(r'":null[,}]')).alias("null_fields"),
        F.col("value").alias("raw_payload"),
    )
    return cleanse.decode(described, keep=["key", "names", "null_fields"])


@query
def raw_envelope(spark, sf_dir):
    raw = ingest.to_raw(tables.envelope(spark, sf_dir))
    return raw.withColumn("is_json", _is_json(F.col("raw_payload"))).drop("raw_payload", "ingested_at")


@query
def json_decode(spark, sf_dir):
    return cleanse.decode(ingest.to_raw(tables.envelope(spark, sf_dir)))


def _is_json(payload):
    """Whether the payload is an object with the 31 fields, at most two of them left out by a fault."""
    return F.coalesce(F.size(F.json_object_keys(payload)) >= len(S.PAYLOAD_COLUMNS) - 2, F.lit(False))


def _streamed(envelope: DataFrame, max_files: int) -> DataFrame:
    """Store the records as files, stream them into a raw layer until caught up, read the layer."""
    spark = envelope.sparkSession
    arrivals, raw, checkpoint = (shared_path(spark, name) for name in ("arrivals", "raw", "checkpoint"))
    envelope.write.option("compression", layers.COMPRESSION).parquet(arrivals)
    stream = topic.file_stream(spark, arrivals, max_files)
    ingest.ingest(stream, raw, checkpoint, ingest.UNTIL_CAUGHT_UP).awaitTermination()
    return layers.read_raw(spark, raw)


@query
def stream_raw_ingest(spark, sf_dir):
    layer = _streamed(tables.envelope(spark, sf_dir), max_files=8)
    layer = layer.select(*S.RAW_COLUMNS).withColumn("is_json", _is_json(F.col("raw_payload")))
    return layer.drop("raw_payload", "ingested_at")


@query
def stream_late_routing(spark, sf_dir):
    layer = _streamed(tables.activity_envelope(spark, sf_dir), max_files=1)
    return layer.groupBy("event_date").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.to_date("kafka_timestamp") != F.col("event_date")).alias("misplaced_rows"),
        F.max("event_id").alias("last_event_id"),
    )


@query
def raw_compacted(spark, sf_dir):
    """The raw layer through two compactions, between which the stream goes on."""
    arrivals, raw, checkpoint = (shared_path(spark, name) for name in ("arrivals", "raw", "checkpoint"))
    records = tables.envelope(spark, sf_dir)
    compacted = compaction.CompactedRaw(spark, raw, shared_path(spark, "compacted"))
    for half in range(2):
        of_half = records.filter(F.pmod(F.xxhash64("offset"), F.lit(2)) == half)
        of_half.write.mode("append").option("compression", layers.COMPRESSION).parquet(arrivals)
        n_files = len(spark.read.schema(S.ENVELOPE).parquet(arrivals).inputFiles())  # of this half, and of the first
        stream = topic.file_stream(spark, arrivals, max_files=max(1, -(-n_files // (3 * (half + 1)))))  # three batches
        ingest.ingest(stream, raw, checkpoint, ingest.UNTIL_CAUGHT_UP).awaitTermination()
        compacted.compact()
    layer = compacted.read().withColumn("is_json", _is_json(F.col("raw_payload")))
    return layer.drop("raw_payload", "ingested_at")


@query
def offset_gaps(spark, sf_dir):
    return offsets.offset_gaps(tables.lossy_records(spark, sf_dir), first_offset=0)


# ---- processed layer


@query
def processed_events(spark, sf_dir):
    raw = ingest.to_raw(tables.envelope(spark, sf_dir))
    return cleanse.processed_events(raw).drop("processed_at")


@query
def processed_roundtrip(spark, sf_dir):
    raw = ingest.to_raw(tables.envelope(spark, sf_dir))
    path = shared_path(spark, "processed")
    layers.write_processed(cleanse.processed_events(raw), path)
    return layers.read_processed(spark, path).drop("processed_at")


@query
def dedup_events(spark, sf_dir):
    return tables.unique_events(spark, sf_dir)


@query
def reject_summary(spark, sf_dir):
    return cleanse.reject_summary(ingest.to_raw(tables.envelope(spark, sf_dir)))


def _checked(spark, sf_dir) -> tuple[str, checked.Balance]:
    path = shared_path(spark, "checked")
    raw = ingest.to_raw(tables.envelope(spark, sf_dir))
    return path, checked.build_checked(spark, raw, path, shared_path(spark, "processed"))


@query
def rejected_records(spark, sf_dir):
    path, _ = _checked(spark, sf_dir)
    rejected = checked.rejected_records(spark, path).withColumn("is_json", _is_json(F.col("raw_payload")))
    return rejected.drop("raw_payload", "ingested_at")


@query
def record_balance(spark, sf_dir):
    """Where the records went, by the counts observed while they were written, and of the layer."""
    _, balance = _checked(spark, sf_dir)
    balance.check()
    counts = {"raw": balance.raw, "rejected": balance.rejected, "duplicates": balance.duplicates, "kept": balance.kept}
    return spark.range(1).select(*[F.lit(n).cast("long").alias(f"{name}_count") for name, n in counts.items()])


@query
def event_flags(spark, sf_dir):
    flags = [name for name in S.PROCESSED.fieldNames() if name.startswith("is_")]
    return tables.processed(spark, sf_dir).select("event_id", "event_date", "event_hour", *flags)


# ---- shipment metrics


@query
def shipment_metrics(spark, sf_dir):
    return _compared(metrics.shipment_metrics(tables.processed(spark, sf_dir)))


@query
def shipment_metrics_incremental(spark, sf_dir):
    """Three slices of days, each added to the states of those before; the last metrics of each shipment."""
    columns = METRIC_COLUMNS | {"event_date", "shipment_id", "event_status", *S.EVENT_ORDER}
    events, path = _layer(spark, sf_dir, *columns), shared_path(spark, "incremental")
    for number, (first, last) in enumerate(SLICES):
        incremental.add_events(events.filter(F.col("event_date").between(first, last)), path, number)
    return _compared(incremental.current_metrics(spark, path))


@query
def shipment_first_attrs(spark, sf_dir):
    return metrics.shipment_first_attrs(tables.processed(spark, sf_dir))


@query
def shipment_risk_modes(spark, sf_dir):
    return metrics.risk_modes(tables.processed(spark, sf_dir))


# ---- marts


@query
def mart_region_delay(spark, sf_dir):
    return _compared(marts.mart_region_delay(tables.processed(spark, sf_dir)))


@query
def mart_hub_performance(spark, sf_dir):
    return _compared(marts.mart_hub_performance(tables.processed(spark, sf_dir)))


@query
def mart_risk_summary(spark, sf_dir):
    return _compared(marts.mart_risk_summary(tables.processed(spark, sf_dir)))


@query
def mart_grouping_sets(spark, sf_dir):
    return _compared(marts.mart_grouping_sets(marts.mart_base(tables.processed(spark, sf_dir))))


@query
def mart_region_named(spark, sf_dir):
    mart = marts.mart_region_delay(tables.processed(spark, sf_dir))
    return _compared(dims.mart_region_named(mart, dims.regions(spark)))


@query
def mart_hub_named(spark, sf_dir):
    mart = marts.mart_hub_performance(tables.processed(spark, sf_dir))
    return _compared(dims.mart_hub_named(mart, dims.hubs(spark)))


@query
def region_group_delay(spark, sf_dir):
    mart = marts.mart_hub_performance(tables.processed(spark, sf_dir))
    return dims.region_group_delay(mart, dims.hubs(spark), dims.regions(spark))


# ---- dimensions and constraints


@query
def eligible_fleet(spark, sf_dir):
    driver = stored(tables.drivers(spark, sf_dir), "driver")
    vehicle = stored(tables.vehicles(spark, sf_dir), "vehicle")
    return dims.eligible_fleet(driver, vehicle)


@query
def dim_insert_if_absent(spark, sf_dir):
    driver = tables.drivers(spark, sf_dir)
    existing = driver.filter(F.substring("driver_id", 5, 4).cast("int") <= 200).withColumn(
        "driver_status", F.lit("REST")
    )
    batch_rows = driver.unionByName(driver.withColumn("driver_name", F.concat("driver_name", F.lit(" again"))))
    return dims.insert_if_absent(existing, batch_rows, "driver_id", ["driver_name"])


@query
def dim_append(spark, sf_dir):
    """A stored dimension after the same rows were appended twice."""
    driver, path = tables.drivers(spark, sf_dir), shared_path(spark, "driver")
    driver.filter(F.substring("driver_id", 5, 4).cast("int") <= 200).withColumn("driver_status", F.lit("REST")).write.parquet(path)
    for _ in range(2):
        dims.append_if_absent(spark, path, driver, "driver_id")
    return spark.read.schema(driver.schema).parquet(path)


def _shipments(spark, sf_dir) -> DataFrame:
    return flow.shipment_table(tables.processed(spark, sf_dir), dims.hubs(spark))


def _constrained(spark, sf_dir, events: DataFrame) -> dict[str, DataFrame]:
    """All tables with declared constraints; every 50th driver is missing."""
    driver = tables.drivers(spark, sf_dir)
    return {
        "region": dims.regions(spark),
        "hub": dims.hubs(spark),
        "driver": driver.filter(F.substring("driver_id", 5, 4).cast("int") % 50 != 0),
        "vehicle": tables.vehicles(spark, sf_dir),
        "shipment": flow.shipment_table(events, dims.hubs(spark)),
        "dispatch": flow.dispatch_table(events),
    }


def _referring(spark, sf_dir) -> dict[str, DataFrame]:
    """Shipments are child and parent here, so the columns of the two tables are stored once."""
    events = stored(tables.unique_events(spark, sf_dir).select(*sorted(FLOW_COLUMNS)), "events")
    return _constrained(spark, sf_dir, events)


@query
def fk_violations(spark, sf_dir):
    return quality.fk_violations(_referring(spark, sf_dir))


@query
def fk_violations_filtered(spark, sf_dir):
    """The same with parents that no child names dropped before the join."""
    return quality.fk_violations(_referring(spark, sf_dir), large_parents=True)


# What shipments and dispatches are made from, and what metrics need besides.
FLOW_COLUMNS = {"dispatch_id", "event_status", *S.EVENT_ORDER, *flow.SHIPMENT_ATTRIBUTES, *flow.DISPATCH_ATTRIBUTES}
METRIC_COLUMNS = {*metrics.FIRST_ATTRIBUTES, *metrics.AVERAGED, "exception_type", "risk_classification"}


def _layer(spark, sf_dir, *columns: str) -> DataFrame:
    """The processed events as a stored layer, which is where these queries start; of its columns those that they read."""
    return stored(tables.processed(spark, sf_dir).select(*sorted(columns)), "layer", compression=layers.COMPRESSION)


@query
def pk_violations(spark, sf_dir):
    events = _layer(spark, sf_dir, *(FLOW_COLUMNS | METRIC_COLUMNS))
    checked = _constrained(spark, sf_dir, events) | {
        "shipment_metrics": metrics.shipment_metrics(events),
        "event": tables.event_copies(spark, sf_dir),
    }
    return quality.pk_violations(checked, S.PRIMARY_KEYS | {"event": "event_id"})


@query
def not_null_violations(spark, sf_dir):
    return quality.not_null_violations(_constrained(spark, sf_dir, _layer(spark, sf_dir, *FLOW_COLUMNS)))


@query
def shipment_dispatch(spark, sf_dir):
    events = _layer(spark, sf_dir, *FLOW_COLUMNS)
    return flow.shipment_dispatch(flow.shipment_table(events, dims.hubs(spark)), flow.dispatch_table(events))


@query
def fleet_performance(spark, sf_dir):
    measured = metrics.shipment_metrics(tables.processed(spark, sf_dir))
    return dims.fleet_performance(measured, tables.drivers(spark, sf_dir), tables.vehicles(spark, sf_dir))


# ---- delivery flow


def _ordered_events(spark, sf_dir) -> DataFrame:
    """What the ordered operators read, stored because they read it more than once."""
    columns = ["shipment_id", *S.EVENT_ORDER, "event_status", "current_hub_id"]
    return stored(tables.unique_events(spark, sf_dir).select(*columns), "ordered-events")


@query
def stage_transitions(spark, sf_dir):
    return flow.stage_transitions(_ordered_events(spark, sf_dir))


@query
def sequence_anomalies(spark, sf_dir):
    return flow.sequence_anomalies(_ordered_events(spark, sf_dir))


@query
def hub_path(spark, sf_dir):
    return flow.hub_path(_ordered_events(spark, sf_dir))


@query
def current_status(spark, sf_dir):
    return flow.current_status(tables.unique_events(spark, sf_dir))


@query
def current_status_stream(spark, sf_dir):
    """The same from the faulty topic records as they arrive, over two restarts; each start finds a third of them more."""
    arrivals, path, checkpoint = (shared_path(spark, name) for name in ("arrivals", "status", "checkpoint"))
    records = tables.envelope(spark, sf_dir)
    for third in range(3):
        of_third = records.filter(F.pmod(F.xxhash64("offset"), F.lit(3)) == third)
        of_third.write.mode("append").option("compression", layers.COMPRESSION).parquet(arrivals)
        status.follow(topic.file_stream(spark, arrivals), path, checkpoint, ingest.UNTIL_CAUGHT_UP).awaitTermination()
    return status.current_statuses(spark, path)


@query
def status_conformance(spark, sf_dir):
    """Statuses in the order of their times, some of them untidy."""
    columns = ["shipment_id", *S.EVENT_ORDER, "event_status"]
    events = stored(tables.untidy_statuses(tables.unique_events(spark, sf_dir)).select(*columns), "ordered-events")
    return flow.status_conformance(events, order=("event_timestamp", "event_sequence", "event_id"))


@query
def shipment_table(spark, sf_dir):
    return _shipments(spark, sf_dir)


@query
def dispatch_table(spark, sf_dir):
    return flow.dispatch_table(tables.processed(spark, sf_dir))


# ---- lanes


@query
def lane_weights(spark, sf_dir):
    return lanes.lane_weights(_shipments(spark, sf_dir), dims.region_weights(spark), dims.hub_weights(spark))


@query
def planned_route(spark, sf_dir):
    routes = lanes.planned_route(_shipments(spark, sf_dir), dims.central_hubs(spark))
    return routes.withColumn("route", F.concat_ws(">", "route"))


@query
def lane_distance(spark, sf_dir):
    return lanes.lane_distance(_shipments(spark, sf_dir))


@query
def hop_coordinates(spark, sf_dir):
    return lanes.hop_coordinates(tables.unique_events(spark, sf_dir), dims.hubs(spark))


@query
def risk_banding(spark, sf_dir):
    return lanes.risk_banding(tables.unique_events(spark, sf_dir))


@query
def sla_check(spark, sf_dir):
    events = _layer(spark, sf_dir, *(FLOW_COLUMNS | METRIC_COLUMNS))
    return lanes.sla_check(flow.shipment_table(events, dims.hubs(spark)), metrics.shipment_metrics(events))


# ---- dashboard figures


@query
def kpi_summary(spark, sf_dir):
    return _compared(kpi.kpi_summary(metrics.shipment_metrics(tables.processed(spark, sf_dir))))


@query
def kpi_region_rate(spark, sf_dir):
    return kpi.kpi_rate(marts.mart_region_delay(tables.processed(spark, sf_dir)), "destination_region_id")


@query
def kpi_hub_rate(spark, sf_dir):
    return kpi.kpi_rate(marts.mart_hub_performance(tables.processed(spark, sf_dir)), "destination_hub_id")


@query
def kpi_risk_share(spark, sf_dir):
    return kpi.kpi_risk_share(marts.mart_risk_summary(tables.processed(spark, sf_dir)))


@query
def kpi_risk_delay(spark, sf_dir):
    return kpi.kpi_risk_delay(metrics.shipment_metrics(tables.processed(spark, sf_dir)))


@query
def kpi_risk_correlation(spark, sf_dir):
    return kpi.risk_delay_correlation(metrics.shipment_metrics(tables.processed(spark, sf_dir)))


@query
def kpi_hourly(spark, sf_dir):
    return kpi.kpi_hourly(tables.processed(spark, sf_dir))


# ---- reference file


@query
def refdata_clean(spark, sf_dir):
    typed = stored(refdata.type_reference(tables.reference_text(spark, sf_dir)), "reference-typed")
    return refdata.clean_reference(typed)


@query
def refdata_clean_approx(spark, sf_dir):
    """Whether the sketched medians that fill the file lie within the rank error asked for, and what they fill."""
    typed = stored(refdata.type_reference(tables.reference_text(spark, sf_dir)), "reference-typed")
    guesses = stored(medians.approximate_medians(typed, refdata.IMPUTED, APPROXIMATION), "guesses")
    errors = medians.rank_errors(typed, guesses, refdata.IMPUTED)
    clean = refdata.clean_reference(typed, APPROXIMATION)
    left = clean.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in refdata.IMPUTED])
    left = left.unpivot([], list(refdata.IMPUTED), "column_name", "null_count")
    return errors.join(left, "column_name").select(
        "column_name", "value_count", (F.col("rank_error") <= APPROXIMATION).alias("within_bound"), "null_count"
    )


@query
def refdata_roundtrip(spark, sf_dir):
    source, target = shared_path(spark, "reference-source"), shared_path(spark, "reference-clean")
    tables.reference_text(spark, sf_dir).write.option("header", True).csv(source)
    typed = stored(refdata.type_reference(reference_csv.read_text(spark, source)), "reference-typed")
    reference_csv.write_clean(refdata.clean_reference(typed), target)
    return reference_csv.read_clean(spark, target)


@query
def refdata_risk_normalized(spark, sf_dir):
    """How labels and probabilities of the file map to the three classes."""
    text = tables.reference_text(spark, sf_dir)
    clean = refdata.limit_signals(refdata.type_reference(text).withColumn("label", F.col("risk_classification")))
    return clean.groupBy("label", "risk_classification").agg(
        F.count("*").alias("row_count"),
        F.min("delay_probability").alias("min_probability"),
        F.max("delay_probability").alias("max_probability"),
    )


@query
def refdata_defaults(spark, sf_dir):
    """Signals of the file with defaults for cells that are missing or not numeric."""
    defaults = {"delay_probability": 0.3, "traffic_congestion_level": 4.0, "lead_time_days": 2.25, "shipping_costs": 17500.0}
    return refdata.with_defaults(tables.reference_text(spark, sf_dir).select(*defaults), defaults)


# ---- the whole batch


@query
def batch_bounded(spark, sf_dir):
    """The processed layer after half of the records of three days came late, and a run over those days only."""
    arrived, processed_path = shared_path(spark, "arrived"), shared_path(spark, "processed")
    raw_path = f"{arrived}/late=false"
    late = F.coalesce(F.col("event_date").between(*LATE_DAYS) & (F.pmod(F.xxhash64("kafka_offset"), F.lit(2)) == 0), F.lit(False))
    raw = ingest.to_raw(tables.envelope(spark, sf_dir)).withColumn("late", late)
    layers.write_raw(raw, arrived, apart=["late"])  # records are made and written once, those to come late apart
    batch.build_processed(spark, raw_path, processed_path)
    came_late = spark.read.schema(raw.schema).parquet(arrived).filter("late").select(*S.RAW_COLUMNS)
    layers.write_raw(came_late, raw_path, "append")
    batch.build_processed(spark, raw_path, processed_path, *LATE_DAYS)
    return layers.read_processed(spark, processed_path).drop("processed_at")


def _published(spark, sf_dir, table: str) -> DataFrame:
    """A table the batch publishes, from the faulty topic records through all layers."""
    raw, processed = shared_path(spark, "raw"), shared_path(spark, "processed")
    layers.write_raw(ingest.to_raw(tables.envelope(spark, sf_dir)), raw)
    published = {}

    def publish(df: DataFrame, name: str) -> None:
        if name == table:
            published[name] = stored(df, name)

    batch.run_batch(spark, raw, processed, publish)
    return _compared(published[table])


@query
def batch_shipment_metrics(spark, sf_dir):
    return _published(spark, sf_dir, "shipment_metrics")


@query
def batch_region_delay(spark, sf_dir):
    return _published(spark, sf_dir, "mart_region_delay")


@query
def batch_hub_performance(spark, sf_dir):
    return _published(spark, sf_dir, "mart_hub_performance")


@query
def batch_risk_summary(spark, sf_dir):
    return _published(spark, sf_dir, "mart_risk_summary")


@query
def batch_tables(spark, sf_dir):
    """Raw layer, processed layer and all published tables through the batch job; rows per table."""
    raw, processed = shared_path(spark, "raw"), shared_path(spark, "processed")
    layers.write_raw(ingest.to_raw(tables.envelope(spark, sf_dir)), raw)
    published = {}

    def publish(df: DataFrame, name: str) -> None:
        path = shared_path(spark, name)
        df.write.parquet(path)
        published[name] = spark.read.schema(df.schema).parquet(path)

    batch.run_batch(spark, raw, processed, publish)

    def summary(name: str, df: DataFrame, events: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            F.sum(events).alias("event_count"),
        )

    result = summary("shipment_metrics", published["shipment_metrics"], "event_count")
    for name in marts.MARTS:
        events = "event_count" if name == "mart_risk_summary" else "total_event_count"
        result = result.unionByName(summary(name, published[name], events))
    return result
