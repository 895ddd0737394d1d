"""The test tables read as delivery events, envelopes, dimensions and a reference file.

One lineitem row is one event of the shipment given by its order; the line number is the sequence. Driver and cargo
change along a shipment, and they and the vehicle are sometimes missing; some risk labels are off their band.
Rows with equal order and line are copies of an event.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow import constants as C
from shipflow import schemas as S
from shipflow.operators import cleanse
from shipflow.session import prepare
from shipflow.sources import topic

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
TOPIC = "delivery_events"
RECORDS_PER_TASK = 400_000  # some 400 MB of JSON text, which writers by date sort
TASKS_PER_CORE = 2  # of small tables

# Cargo types, licence types, vehicle types with capacity.
CARGO_TYPES = ("일반화물", "신선식품", "냉장식품", "전자제품", "의류", "생활용품", "산업자재")
LICENSE_TYPES = ("1종 대형", "1종 보통", "화물운송자격")
VEHICLE_TYPES = (
    ("1톤 탑차", 1000),
    ("2.5톤 탑차", 2500),
    ("5톤 윙바디", 5000),
    ("11톤 카고", 11000),
    ("냉장 탑차", 2000),
    ("전기 배송차", 800),
)
EXCEPTION_TYPES = ("TRAFFIC_ACCIDENT", "BAD_WEATHER", "HUB_CONGESTION", "VEHICLE_ISSUE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _array(values) -> str:
    """Fixed short list as SQL text, for element_at with an index from 1."""
    texts = [f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v) for v in values]
    return f"array({', '.join(texts)})"


HUB_IDS = _array([hub[0] for hub in C.HUBS])
HUB_REGIONS = _array([hub[2] for hub in C.HUBS])
HUB_LATITUDES = _array([hub[3] for hub in C.HUBS])
HUB_LONGITUDES = _array([hub[4] for hub in C.HUBS])
HUB_CENTRES = _array([C.CENTRAL_HUBS[hub[2]] for hub in C.HUBS])

# Event columns; oh and dh are the numbers of the origin and the destination hub, start and
# event_second are seconds since the epoch.
EVENT_COLUMNS = f"""
    concat('EVT_', l_orderkey, '_', l_linenumber) AS event_id;
    concat('SHP_', l_orderkey) AS shipment_id;
    concat('DSP_', l_orderkey) AS dispatch_id;
    IF(l_partkey % 7 = 0, NULL, concat('DRV_', lpad((o_custkey + l_linenumber) % 300 + 1, 4, '0'))) AS driver_id;
    IF(l_partkey % 11 = 0, NULL, concat('VEH_', lpad(o_custkey % 500 + 1, 4, '0'))) AS vehicle_id;
    element_at({HUB_REGIONS}, oh) AS origin_region_id;
    element_at({HUB_REGIONS}, dh) AS destination_region_id;
    element_at({HUB_IDS}, oh) AS origin_hub_id;
    element_at({HUB_IDS}, dh) AS destination_hub_id;
    CASE WHEN l_linenumber <= 4 THEN element_at({HUB_IDS}, oh)
      WHEN l_linenumber <= 6 THEN element_at({HUB_CENTRES}, dh) ELSE element_at({HUB_IDS}, dh) END AS current_hub_id;
    CASE WHEN l_linenumber <= 4 THEN element_at({HUB_CENTRES}, dh) ELSE element_at({HUB_IDS}, dh) END AS next_hub_id;
    IF(l_partkey % 13 = 0, NULL, element_at({_array(CARGO_TYPES)}, CAST((o_custkey + l_linenumber) % 7 + 1 AS INT))) AS cargo_type;
    round(o_totalprice % 8000, 2) AS cargo_weight_kg;
    o_totalprice AS shipping_costs;
    CAST(o_custkey % 5 + 1 AS DOUBLE) AS lead_time_days;
    timestamp_seconds(start + (o_custkey % 5 + 1) * 86400) AS promised_delivery_at;
    element_at({_array(C.STATUSES)}, l_linenumber) AS event_status;
    l_linenumber AS event_sequence;
    timestamp_seconds(event_second) AS event_timestamp;
    timestamp_seconds(event_second + l_suppkey % 60) AS processing_timestamp;
    element_at({HUB_LATITUDES}, IF(l_linenumber <= 4, oh, dh)) AS latitude;
    element_at({HUB_LONGITUDES}, IF(l_linenumber <= 4, oh, dh)) AS longitude;
    CASE WHEN l_linenumber <= 4 THEN 0 WHEN l_linenumber <= 6 THEN 1 ELSE 2 END AS route_step;
    2 AS route_total_steps;
    round(l_quantity / 5.0D, 2) AS traffic_congestion_level;
    round(l_tax * 100, 2) AS weather_severity;
    round((l_partkey % 101) / 10.0D, 2) AS hub_congestion_level;
    round(l_extendedprice % 40, 2) AS eta_variation_minutes;
    chance AS delay_probability;
    CASE WHEN l_partkey % 17 = 0 THEN 'LOW' WHEN chance >= 0.70D THEN 'HIGH' WHEN chance >= 0.38D THEN 'MEDIUM' ELSE 'LOW' END AS risk_classification;
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber >= 3
      THEN element_at({_array(EXCEPTION_TYPES)}, CAST(l_suppkey % 4 + 1 AS INT)) END AS exception_type;
    timestamp_seconds(event_second + l_suppkey % 60) AS kafka_timestamp;
    CAST(l_orderkey % 3 AS INT) AS kafka_partition;
    l_partkey * 100000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 100000 AS kafka_offset;
    l_partkey % 97 AS fault
"""


def _lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Lines with their order; ``dealt`` to all cores, and to tasks of a bounded number of rows.

    They are dealt before the join, by its key: events are several times as wide, and records wider still. The join deals
    to no fewer tasks than the session's shuffles have, and each task writes a file per date, so small ones are put together.
    """
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if not dealt:
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.count()  # from the footers of the files
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-rows // RECORDS_PER_TASK))
    lines = lines.repartition(tasks, "l_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).coalesce(tasks)


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "*",
        "CAST(l_orderkey % 12 + 1 AS INT) AS oh",
        "CAST(o_custkey % 12 + 1 AS INT) AS dh",
        "round(l_discount * 10, 3) AS chance",
        f"{EPOCH} + (l_orderkey % 720) * 3600 AS start",
        f"{EPOCH} + (l_orderkey % 720) * 3600 + (l_linenumber * 600 + l_partkey % 900) * 60 AS event_second",
    )


def event_copies(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """All events with every copy: 31 payload columns, arrival order and the number of the fault rule."""
    return _numbered(_lines(spark, sf_dir, dealt)).selectExpr(*EVENT_COLUMNS.split(";"))


def unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """31 payload columns, first arrival of each event.

    Lines are a third as wide as events, so copies meet as lines with the event's id and arrival.
    """
    lines = _lines(spark, sf_dir)
    needed = [column for column in EVENT_COLUMNS.split(";") if column.split()[-1] in ("event_id", *S.ARRIVAL_ORDER)]
    arrived = _numbered(lines).selectExpr(*lines.columns, *needed)
    first = cleanse.first_arrivals(arrived).select(*lines.columns)
    return _numbered(first).selectExpr(*EVENT_COLUMNS.split(";")).select(*S.PAYLOAD_COLUMNS)


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, unique and flagged events."""
    return cleanse.flag_events(unique_events(spark, sf_dir))


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies as topic records, faults included.

    By l_partkey % 97: 0 text that is not JSON, 1 no event_id, 2 unreadable event_timestamp,
    3 text as event_sequence, 4 no event_status.
    """
    # Dealt, as the tables are few row groups, which would leave the encoding, and the files of a stream, to as few tasks.
    # In order of arrival, as in a topic. Joined and encoded in one go, they would be a method too large for HotSpot to compile.
    copies = event_copies(spark, sf_dir, dealt=True).sortWithinPartitions("kafka_timestamp").selectExpr(
        "* EXCEPT (event_id, event_status)",
        "IF(fault <> 1, event_id, NULL) AS event_id",
        "IF(fault <> 4, event_status, NULL) AS event_status",
    )
    encoded = topic.encode_events(copies, keep=["fault", *S.ARRIVAL_ORDER]).selectExpr(
        "CAST(key AS BINARY) AS key",
        """CAST(CASE fault WHEN 0 THEN 'not json'
             WHEN 2 THEN regexp_replace(value, '"event_timestamp":"[^"]*"', '"event_timestamp":"garbage"')
             WHEN 3 THEN regexp_replace(value, '"event_sequence":[0-9]+', '"event_sequence":"x"')
             ELSE value END AS BINARY) AS value""",
        f"'{TOPIC}' AS topic",
        "kafka_partition AS partition",
        "kafka_offset AS offset",
        "kafka_timestamp AS timestamp",
    )
    return encoded


def activity_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as topic records, props as a nested field. Every ninth time is unreadable.

    Two thirds of the records reach the topic a day or two after their event.
    """
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(CAST(user_id AS STRING) AS BINARY) AS key",
        """CAST(to_json(struct(
             CAST(event_id AS STRING) AS event_id,
             IF(event_id % 9 = 0, 'late', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")) AS event_timestamp,
             event_type, value, from_json(props, 'k INT') AS props)) AS BINARY) AS value""",
        "'activity' AS topic",
        "CAST(user_id % 3 AS INT) AS partition",
        "event_id AS offset",
        "timestampadd(DAY, CAST(event_id % 3 AS INT), CAST(ts AS TIMESTAMP)) AS timestamp",
    )


def lossy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw columns of the events table as a topic of three partitions, of which one holds four fifths of the records.

    Offsets have no holes but for the records that are lost: five of every 97. Some records were stored twice.
    """
    events = table(spark, sf_dir, "events").filter("event_id % 97 NOT BETWEEN 5 AND 9")
    return events.selectExpr(
        "explode(IF(event_id % 31 = 0, array(0, 60), array(0))) AS again",
        "'activity' AS kafka_topic",
        "CAST(IF(event_id % 10 < 8, 0, event_id % 10 - 7) AS INT) AS kafka_partition",
        "IF(event_id % 10 < 8, event_id div 10 * 8 + event_id % 10, event_id div 10) AS kafka_offset",
        "timestampadd(SECOND, again, CAST(ts AS TIMESTAMP)) AS kafka_timestamp",
    ).drop("again")


def untidy_statuses(events: DataFrame) -> DataFrame:
    """Events of which some repeat the status before theirs, and some have one outside the order."""
    before = f"element_at({_array(C.STATUSES)}, greatest(event_sequence - 1, 1))"
    status = f"CASE weather_severity WHEN 3 THEN {before} WHEN 5 THEN 'LOST' ELSE event_status END"
    return events.withColumn("event_status", F.expr(status))


def _numbers(spark: SparkSession, sf_dir: str, count: int) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"CAST(o_custkey % {count} + 1 AS INT) AS i").distinct()


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir, 300).selectExpr(
        "concat('DRV_', lpad(i, 4, '0')) AS driver_id",
        "concat('driver ', i) AS driver_name",
        "concat('REG_', lpad(i % 10 + 1, 2, '0')) AS region_id",
        f"element_at({_array(LICENSE_TYPES)}, i % 3 + 1) AS license_type",
        "IF(i % 4 = 0, 'REST', 'ACTIVE') AS driver_status",
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir, 500).selectExpr(
        "concat('VEH_', lpad(i, 4, '0')) AS vehicle_id",
        f"IF(i % 25 = 0, NULL, element_at({_array([name for name, _ in VEHICLE_TYPES])}, i % 6 + 1)) AS vehicle_type",
        f"element_at({_array([capacity for _, capacity in VEHICLE_TYPES])}, i % 6 + 1) AS capacity_kg",
        "concat('REG_', lpad(i % 10 + 1, 2, '0')) AS region_id",
        "IF(i % 4 = 0, 'MAINTENANCE', 'AVAILABLE') AS vehicle_status",
    )


# Cells of the reference file, with bad ones at fixed places.
REFERENCE_CELLS = """
    IF(l_partkey % 23 = 0, 'not a date', date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')) AS timestamp;
    33.0D + (l_suppkey % 500) / 100.0D AS vehicle_gps_latitude;
    126.0D + (l_suppkey % 300) / 100.0D AS vehicle_gps_longitude;
    IF(l_partkey % 29 = 0, NULL, round(l_extendedprice % 4, 3)) AS eta_variation_hours;
    CASE WHEN l_partkey % 17 = 0 THEN 'n/a' WHEN l_partkey % 19 = 0 THEN IF(l_linenumber % 2 = 0, '12', '-3')
      ELSE CAST(round(l_quantity / 5.0D, 2) AS STRING) END AS traffic_congestion_level;
    round(l_tax * 100, 2) AS weather_condition_severity;
    IF(l_partkey % 19 = 0, IF(l_linenumber % 2 = 0, 12.0D, -3.0D), round((l_partkey % 101) / 10.0D, 2))
      AS port_congestion_level;
    CASE WHEN l_partkey % 31 = 0 THEN 1.5D WHEN l_partkey % 11 = 0 THEN round(round(l_discount * 10, 3) * 100, 1)
      ELSE round(l_discount * 10, 3) END AS delay_probability;
    element_at(array('High Risk', ' medium ', 'low', 'Moderate', NULL, 'HIGH'), CAST(l_suppkey % 6 + 1 AS INT))
      AS risk_classification;
    IF(l_partkey % 13 = 0, NULL, o_totalprice) AS shipping_costs;
    IF(l_partkey % 37 = 0, 'n/a', CAST(o_custkey % 5 + 1 AS STRING)) AS lead_time_days;
    l_discount AS driver_behavior_score;
    l_tax AS fatigue_monitoring_score;
    (l_suppkey % 100) / 100.0D AS disruption_likelihood_score;
    (l_linenumber - 4) * 0.5D AS delivery_time_deviation
"""


def reference_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 text columns as a reference file would have them."""
    cells = _lines(spark, sf_dir).selectExpr(*REFERENCE_CELLS.split(";"))
    return cells.selectExpr(*[f"CAST({name} AS STRING) AS {name}" for name in S.REFERENCE_COLUMNS])
