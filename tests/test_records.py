"""Every record accounted for: rejects, missing offsets, status order, compaction, appended dimensions, sketched medians."""

import itertools
import random

import pytest
from helpers import at, payload, raw_frame
from pyspark.sql import functions as F

from shipflow import constants as C
from shipflow import schemas as S
from shipflow.operators import cleanse, dims, flow, keyfilter, medians, offsets, quality, refdata
from shipflow.plans import checked
from shipflow.sources import compaction, layers, topic
from shipflow.streaming import ingest

# ---- rejects


TEXTS = [
    payload(event_id="a"), payload(event_id="a", event_sequence=2), payload(event_id="b"), payload(event_id=None),
    payload(event_id="c", shipment_id=None), payload(event_id="d", event_status=None), payload(event_id="e", event_timestamp="?"),
    "not json", "[]", None, "",
]


def test_rejects_are_kept_and_everything_adds_up(spark, tmp_path, rows):
    raw = raw_frame(spark, *TEXTS).repartition(3)
    side, processed = str(tmp_path / "checked"), str(tmp_path / "processed")
    for _ in range(2):
        balance = checked.build_checked(spark, raw, side, processed)
    assert balance == checked.Balance(raw=11, rejected=8, duplicates=1, kept=2)
    balance.check()
    rejected = checked.rejected_records(spark, side)
    assert rejected.columns == [*S.RAW_COLUMNS, "reject_reason"]
    reasons = {row.kafka_offset: row.reject_reason for row in rejected.collect()}
    assert reasons == {3: "MISSING_EVENT_ID", 4: "MISSING_SHIPMENT_ID", 5: "MISSING_EVENT_STATUS", 6: "INVALID_EVENT_TIMESTAMP",
                       **dict.fromkeys((7, 8, 9, 10), "MISSING_EVENT_ID")}
    assert rows(rejected.drop("reject_reason")) == rows(raw.filter("kafka_offset >= 3").select(*S.RAW_COLUMNS))
    layer = layers.read_processed(spark, processed).drop("processed_at")
    expected = cleanse.processed_events(raw).drop("processed_at")
    assert rows(layer.select(*expected.columns)) == rows(expected)
    counted = {row.reject_reason: row["count"] for row in rejected.groupBy("reject_reason").count().collect()}
    assert counted | {"DUPLICATE_EVENT_ID": 1} == {row.reject_reason: row.row_count for row in cleanse.reject_summary(raw).collect()}


def test_payloads_are_parsed_once(spark):
    plan = cleanse.checked_records(raw_frame(spark, *TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StructField(dispatch_id") == 1
    with pytest.raises(ValueError, match="do not add up"):
        checked.Balance(3, 1, 1, 0).check()


def test_nothing_to_check(spark, tmp_path):
    raw = raw_frame(spark, *TEXTS).limit(0)
    balance = checked.build_checked(spark, raw, str(tmp_path / "checked"), str(tmp_path / "processed"))
    assert balance == checked.Balance(0, 0, 0, 0)


# ---- missing offsets


def stored_records(spark, records):
    frame = spark.createDataFrame(records, "kafka_topic string, kafka_partition int, kafka_offset long, minute int")
    return frame.withColumn("kafka_timestamp", F.lit(at(0)) + F.make_dt_interval(mins=F.col("minute")))


def missing(records, first):
    found = []
    key = lambda record: (record[0], record[1])
    known = sorted(r for r in records if None not in r[:3] and (first is None or r[2] >= first))
    for place, group in itertools.groupby(known, key):
        times = {}
        for _, _, offset, minute in group:
            times[offset] = min(minute, times.get(offset, minute))
        before = None if first is None else first - 1
        for offset in sorted(times):
            if before is not None and offset - before > 1:
                seen = at(times[before]) if before in times else None
                found.append((*place, before + 1, offset - 1, offset - before - 1, seen, at(times[offset])))
            before = offset
    return sorted(found, key=repr)


@pytest.mark.parametrize("first", [None, 0, 50])
@pytest.mark.parametrize("range_offsets", [7, 100, 1_000_000])
def test_offset_gaps(spark, rows, first, range_offsets):
    draw = random.Random(4)
    records = [("t", 0, offset, draw.randrange(500)) for offset in range(20, 900) if draw.random() > 0.05 and not 300 < offset < 420]
    records += [("t", 1, offset, 3) for offset in (0, 1, 2, 60)] + [("u", 0, 5, 1), ("u", None, 9, 1), ("u", 0, None, 1), (None, 0, 3, 1)]
    records += records[::7]  # stored twice
    found = offsets.offset_gaps(stored_records(spark, records), first, range_offsets)
    assert rows(found) == missing(records, first)


def test_no_task_has_a_whole_partition_of_the_topic(spark):
    records = spark.range(100_000).filter("id % 1000 <> 7").selectExpr(
        "'t' AS kafka_topic", "0 AS kafka_partition", "id AS kafka_offset", "timestamp_seconds(id) AS kafka_timestamp"
    )
    found = offsets.offset_gaps(records, range_offsets=1_000)
    assert found.count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "lag(" in line]
    assert any("range#" in line.split("], [")[1] for line in windows)  # records are looked at by ranges
    assert offsets.offset_gaps(records.limit(0), 0).count() == 0


# ---- status order


def judged(events):
    found, furthest = {}, 0
    for _, event_id, state in sorted(events):
        rank = C.STATUSES.index(state) + 1 if state in C.STATUSES else None
        verdict = (
            "unknown" if rank is None else "expected" if rank == furthest + 1 else "skipped" if rank > furthest
            else "repeated" if rank == furthest else "backward"
        )
        found[event_id] = (C.STATUSES[furthest - 1] if furthest else None, verdict, max((rank or 0) - furthest - 1, 0))
        furthest = max(furthest, rank or 0)
    return found


@pytest.mark.parametrize("limits", [{}, {"max_rows": 40}, {"max_rows": 4}])
def test_status_conformance(spark, limits):
    draw = random.Random(2)
    statuses = [*C.STATUSES, "LOST", None]
    rows = [
        ("HOT" if i < 300 else f"S{i % 20}", i // 9, at(i), f"E{i:04d}", draw.choice(statuses) if i % 50 else "CREATED")
        for i in range(500)
    ]
    events = spark.createDataFrame(rows, "shipment_id string, event_sequence int, event_timestamp timestamp, event_id string, event_status string")
    found = {row.event_id: tuple(row[3:]) for row in flow.status_conformance(events.repartition(5), **limits).collect()}
    expected = {}
    for shipment in {row[0] for row in rows}:
        expected |= judged([((row[1], row[2]), row[3], row[4]) for row in rows if row[0] == shipment])
    assert found == expected
    assert {verdict for _, verdict, _ in found.values()} == {"unknown", "expected", "skipped", "repeated", "backward"}


# ---- compaction


def arrive(spark, folder, first, count):
    """Records of three dates and of none, in files of their own."""
    raw = raw_frame(spark, *[payload(event_id=f"E{i}", event_timestamp=at(1440 * (i % 3)).isoformat() if i % 7 else "?") for i in range(first, first + count)])
    records = raw.select(
        F.col("kafka_key").cast("binary").alias("key"), F.col("raw_payload").cast("binary").alias("value"),
        F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"), F.col("kafka_timestamp").alias("timestamp"),
    )
    records.repartition(2).write.mode("append").parquet(f"{folder}/arrivals")
    stream = topic.file_stream(spark, f"{folder}/arrivals", 1)
    ingest.ingest(stream, f"{folder}/raw", f"{folder}/checkpoint", ingest.UNTIL_CAUGHT_UP).awaitTermination()


def test_compaction_beside_a_stream(spark, tmp_path, rows):
    folder = f"{tmp_path}/a layer"
    compacted = compaction.CompactedRaw(spark, f"{folder}/raw", f"{folder}/compacted")
    layer = lambda: rows(layers.read_raw(spark, f"{folder}/raw").select(*S.RAW_COLUMNS))
    arrive(spark, folder, 0, 40)
    assert rows(compacted.read()) == layer()
    before = len(compacted.files())
    assert compacted.compact() == before > 4
    assert len(compacted.files()) == 4 and rows(compacted.read()) == layer()
    arrive(spark, folder, 40, 30)  # the stream goes on with its own files
    assert len(layer()) == 70 and rows(compacted.read()) == layer()
    assert compacted.compact() > 4
    assert len(compacted.files()) == 4 and rows(compacted.read()) == layer()
    assert compacted.compact() == 0


def test_a_compaction_that_was_cut_short_is_not_seen(spark, tmp_path, rows):
    folder = str(tmp_path)
    arrive(spark, folder, 0, 40)
    compacted = compaction.CompactedRaw(spark, f"{folder}/raw", f"{folder}/compacted")
    compacted.compact()
    (tmp_path / "compacted" / "replaced" / "run=0" / "_SUCCESS").unlink()
    assert rows(compacted.read()) == rows(layers.read_raw(spark, f"{folder}/raw").select(*S.RAW_COLUMNS))
    assert compacted.compact() > 4 and len(compacted.files()) == 4
    assert rows(compacted.read()) == rows(layers.read_raw(spark, f"{folder}/raw").select(*S.RAW_COLUMNS))


def test_files_are_grouped_by_date_and_size(spark, tmp_path, monkeypatch):
    compacted = compaction.CompactedRaw(spark, str(tmp_path / "raw"), str(tmp_path / "compacted"))
    sizes = {"/raw/event_date=1/a": 60, "/raw/event_date=1/b": 10, "/raw/event_date=1/c": 30, "/raw/event_date=1/d": 45, "/raw/event_date=2/e": 5}
    monkeypatch.setattr(compacted.folder, "size_of", sizes.get)
    assert compacted.groups(dict.fromkeys(sizes, "/raw"), 100) == [["/raw/event_date=1/b", "/raw/event_date=1/c", "/raw/event_date=1/d"]]
    assert compacted.groups(dict.fromkeys(sizes, "/raw"), 120) == [["/raw/event_date=1/b", "/raw/event_date=1/c", "/raw/event_date=1/d"]]
    assert compacted.groups(dict.fromkeys(sizes, "/raw"), 90) == [["/raw/event_date=1/b", "/raw/event_date=1/c", "/raw/event_date=1/d"]]
    assert compacted.groups(dict.fromkeys(sizes, "/raw"), 60) == [["/raw/event_date=1/b", "/raw/event_date=1/c"]]
    with pytest.raises(ValueError, match="must not lie"):
        compaction.CompactedRaw(spark, str(tmp_path / "raw"), str(tmp_path / "raw" / "compacted"))


# ---- appended dimensions


KINDS = "id string, name string, note string"


def test_append_if_absent(spark, tmp_path, rows):
    path = str(tmp_path / "dim")
    first = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), (None, "n", "x")], KINDS)
    assert dims.append_if_absent(spark, path, first, "id") == 2
    files = {file.name: file.stat().st_mtime_ns for file in (tmp_path / "dim").glob("*.parquet")}
    more = spark.createDataFrame([("b", "9", "y"), ("c", "4", "y"), ("c", "3", "y"), (None, "n", "y")], KINDS)
    assert dims.append_if_absent(spark, path, more, "id", ["name"]) == 1
    assert dims.append_if_absent(spark, path, more, "id", ["name"]) == 0
    assert rows(spark.read.schema(KINDS).parquet(path)) == [("a", "1", "x"), ("b", "2", "x"), ("c", "3", "y")]
    after = {file.name: file.stat().st_mtime_ns for file in (tmp_path / "dim").glob("*.parquet")}
    assert files.items() < after.items() and len(after) == len(files) + 1


def test_append_after_a_run_that_wrote_only_some_rows(spark, tmp_path, rows):
    path = str(tmp_path / "dim")
    whole = spark.createDataFrame([(str(i), "n", "x") for i in range(20)], KINDS)
    whole.limit(7).write.parquet(path)
    assert dims.append_if_absent(spark, path, whole, "id") == 13
    assert rows(spark.read.schema(KINDS).parquet(path)) == rows(whole)


# ---- sketched medians


@pytest.mark.parametrize("rank_error", [0.2, 0.01, 0.0001])
def test_sketched_medians_are_within_their_bound(spark, rank_error):
    draw = random.Random(6)
    values = [(draw.choice([None, float("nan"), draw.gauss(0, 1), 5.0, -1e300]), draw.random() if i % 2 else 0.25, None) for i in range(5000)]
    frame = spark.createDataFrame(values, "a double, b double, c double").repartition(7)
    guesses = medians.approximate_medians(frame, ["a", "b", "c"], rank_error)
    found = {row.column_name: row for row in medians.rank_errors(frame, guesses, ["a", "b", "c"]).collect()}
    numbers = {name: [row[i] for row in values if row[i] is not None and row[i] == row[i]] for i, name in enumerate("abc")}
    assert {name: row.value_count for name, row in found.items()} == {name: len(of) for name, of in numbers.items()}
    assert found["a"].rank_error <= rank_error and found["b"].rank_error <= rank_error and found["c"].rank_error is None
    guess = guesses.first()
    assert guess.a in numbers["a"] and guess.b in numbers["b"] and guess.c is None


def test_rank_errors_count_ranks(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(100)], "a double")
    for guess, expected in ((49.0, 0.0), (50.0, 0.0), (59.0, 0.09), (39.0, 0.1), (-5.0, 0.5), (200.0, 0.5)):
        guesses = spark.createDataFrame([(guess,)], "a double")
        assert medians.rank_errors(frame, guesses, ["a"]).first().rank_error == pytest.approx(expected)


def test_the_file_is_filled_by_either_median(spark, rows):
    names = list(S.REFERENCE_COLUMNS)
    text = spark.createDataFrame(
        [[None if name in ("shipping_costs", "lead_time_days") and i % 3 == 0 else str(i) for name in names] for i in range(31)],
        ", ".join(f"{name} string" for name in names),
    )
    typed = refdata.type_reference(text)
    assert rows(refdata.clean_reference(typed, rank_error=1e-6).drop("shipping_costs", "lead_time_days")) == rows(
        refdata.clean_reference(typed).drop("shipping_costs", "lead_time_days")
    )
    assert refdata.clean_reference(typed, rank_error=1e-6).filter("shipping_costs IS NULL").count() == 0


# ---- key filters and group sizes


def test_key_filters_pass_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.lit("p").alias("table"), F.concat(F.lit("K"), (F.col("id") * 7).cast("string")).alias("value"))
    others = spark.range(200_000).select(F.lit("p").alias("table"), F.concat(F.lit("X"), F.col("id").cast("string")).alias("value"))
    for blocks in (keyfilter.blocks_for(20_000), 1):
        found = keyfilter.key_filter(keys, ["table", "value"], blocks).cache()
        assert keyfilter.possible(keys, ["table", "value"], found, blocks).count() == 20_000
        strangers = keyfilter.possible(others, ["table", "value"], found, blocks).count()
        assert strangers < 4_000 if blocks > 1 else strangers > 100_000
    assert keyfilter.possible(others, ["table", "value"], keyfilter.key_filter(keys.limit(0), ["table", "value"], 1), 1).count() == 0
    assert keyfilter.blocks_for(0) == 1 and keyfilter.blocks_for(10**9) == keyfilter.MAX_BLOCKS


def test_fk_violations_of_large_parents(spark, rows):
    tables = {
        "parent": spark.range(50_000).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("parent_id")),
        "child": spark.range(900).select(
            F.when(F.col("id") % 9 > 0, F.concat(F.lit("P"), (F.col("id") * 60).cast("string"))).alias("parent_id"),
            F.concat(F.lit("P"), (F.col("id") % 5).cast("string")).alias("other_id"),
        ),
    }
    keys, references = {"parent": "parent_id"}, [("child", "parent_id", "parent"), ("child", "other_id", "parent")]
    plain = quality.fk_violations(tables, references, keys)
    filtered = quality.fk_violations(tables, references, keys, large_parents=True)
    assert rows(filtered) == rows(plain)
    assert {row.column_name: row.missing_values for row in plain.collect()} == {"parent_id": 59, "other_id": 0}
    filtered.collect()
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("substring(bitmap") > plan.index("LeftOuter")  # the parents are filtered below the join
    named = spark.range(900).select(F.lit("parent").alias("parent_table"), F.concat(F.lit("P"), (F.col("id") * 60).cast("string")).alias("value"))
    parents = tables["parent"].select(F.lit("parent").alias("parent_table"), F.col("parent_id").alias("value"))
    blocks = keyfilter.blocks_for(900)
    left = keyfilter.possible(parents, ["parent_table", "value"], keyfilter.key_filter(named, ["parent_table", "value"], blocks), blocks)
    assert left.count() < 2_500  # of 50,000


def test_known_sizes_of_groups(spark, rows):
    data = [("HOT" if i < 200 else f"S{i % 20}", i, at(i), f"E{i:04d}", C.STATUSES[i % 7]) for i in range(300)]
    events = spark.createDataFrame(data, "shipment_id string, event_sequence int, event_timestamp timestamp, event_id string, event_status string")
    expected = rows(flow.stage_transitions(events))
    sizes = events.groupBy("shipment_id").agg((F.count("*") + 1).alias("event_count"))
    cut = flow.stage_transitions(events, max_rows=40, sizes=sizes)
    assert rows(cut) == expected and "_piece" in cut._jdf.queryExecution().optimizedPlan().toString()
    whole = flow.stage_transitions(events, max_rows=40, largest=40)  # taken at its word
    assert rows(whole) == expected and "_piece" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert rows(flow.stage_transitions(events, max_rows=40, largest=200)) == expected
