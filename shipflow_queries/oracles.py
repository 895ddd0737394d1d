"""The registered queries as DuckDB SQL over the test tables."""

from shipflow import constants as C


def _values(rows) -> str:
    def cell(value):
        return f"'{value}'" if isinstance(value, str) else f"{float(value)!r}e0"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


REGION = f"region_dim(region_id, region_name, region_group) AS (VALUES {_values(C.REGIONS)})"
HUB = f"hub_dim(hub_id, hub_name, region_id, latitude, longitude, hub_type) AS (VALUES {_values(C.HUBS)})"
CENTRE = f"centre(region_id, hub_id) AS (VALUES {_values(C.CENTRAL_HUBS.items())})"
REGION_WEIGHT = f"region_weight(region_id, weight) AS (VALUES {_values(C.REGION_WEIGHTS.items())})"
HUB_WEIGHT = f"hub_weight(hub_id, weight) AS (VALUES {_values(C.HUB_WEIGHTS.items())})"

# One row per lineitem; hubs by number, the central hub of a hub's region next to it.
SOURCE = f"""{HUB}, {CENTRE},
place AS (
  SELECT CAST(substr(h.hub_id, 5) AS BIGINT) AS n, h.hub_id, h.region_id, h.latitude, h.longitude,
         c.hub_id AS centre
  FROM hub_dim h JOIN centre c ON c.region_id = h.region_id),
timed AS (
  SELECT l.*, o.*, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(l_orderkey % 720 AS INTEGER)) AS t0
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
source AS (
  SELECT concat('EVT_', l_orderkey, '_', l_linenumber) AS event_id,
    concat('SHP_', l_orderkey) AS shipment_id,
    concat('DSP_', l_orderkey) AS dispatch_id,
    CASE WHEN l_partkey % 7 <> 0 THEN concat('DRV_', lpad(CAST((o_custkey + l_linenumber) % 300 + 1 AS VARCHAR), 4, '0')) END
      AS driver_id,
    CASE WHEN l_partkey % 11 <> 0 THEN concat('VEH_', lpad(CAST(o_custkey % 500 + 1 AS VARCHAR), 4, '0')) END AS vehicle_id,
    oh.region_id AS origin_region_id, dh.region_id AS destination_region_id,
    oh.hub_id AS origin_hub_id, dh.hub_id AS destination_hub_id,
    CASE WHEN l_linenumber <= 4 THEN oh.hub_id WHEN l_linenumber <= 6 THEN dh.centre ELSE dh.hub_id END
      AS current_hub_id,
    CASE WHEN l_linenumber <= 4 THEN dh.centre ELSE dh.hub_id END AS next_hub_id,
    CASE WHEN l_partkey % 13 <> 0 THEN CASE (o_custkey + l_linenumber) % 7 WHEN 0 THEN '일반화물' WHEN 1 THEN '신선식품' WHEN 2 THEN '냉장식품'
      WHEN 3 THEN '전자제품' WHEN 4 THEN '의류' WHEN 5 THEN '생활용품' ELSE '산업자재' END END AS cargo_type,
    round(o_totalprice % 8000, 2) AS cargo_weight_kg,
    o_totalprice AS shipping_costs,
    CAST(o_custkey % 5 + 1 AS DOUBLE) AS lead_time_days,
    t0 + to_days(CAST(o_custkey % 5 + 1 AS INTEGER)) AS promised_delivery_at,
    CASE l_linenumber WHEN 1 THEN 'CREATED' WHEN 2 THEN 'ASSIGNED' WHEN 3 THEN 'PICKUP'
      WHEN 4 THEN 'IN_TRANSIT' WHEN 5 THEN 'ARRIVED_HUB' WHEN 6 THEN 'OUT_FOR_DELIVERY'
      WHEN 7 THEN 'DELIVERED' END AS event_status,
    l_linenumber AS event_sequence,
    t0 + to_minutes(l_linenumber * 600 + l_partkey % 900) AS event_timestamp,
    t0 + to_minutes(l_linenumber * 600 + l_partkey % 900) + to_seconds(l_suppkey % 60)
      AS processing_timestamp,
    CASE WHEN l_linenumber <= 4 THEN oh.latitude ELSE dh.latitude END AS latitude,
    CASE WHEN l_linenumber <= 4 THEN oh.longitude ELSE dh.longitude END AS longitude,
    CASE WHEN l_linenumber <= 4 THEN 0 WHEN l_linenumber <= 6 THEN 1 ELSE 2 END AS route_step,
    2 AS route_total_steps,
    round(l_quantity / 5.0e0, 2) AS traffic_congestion_level,
    round(l_tax * 100, 2) AS weather_severity,
    round((l_partkey % 101) / 10.0e0, 2) AS hub_congestion_level,
    round(l_extendedprice % 40, 2) AS eta_variation_minutes,
    round(l_discount * 10, 3) AS delay_probability,
    CASE WHEN l_partkey % 17 = 0 THEN 'LOW' WHEN round(l_discount * 10, 3) >= 0.70e0 THEN 'HIGH'
         WHEN round(l_discount * 10, 3) >= 0.38e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_classification,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber >= 3 THEN
      CASE l_suppkey % 4 WHEN 0 THEN 'TRAFFIC_ACCIDENT' WHEN 1 THEN 'BAD_WEATHER'
        WHEN 2 THEN 'HUB_CONGESTION' ELSE 'VEHICLE_ISSUE' END END AS exception_type,
    t0 + to_minutes(l_linenumber * 600 + l_partkey % 900) + to_seconds(l_suppkey % 60) AS kafka_timestamp,
    CAST(l_orderkey % 3 AS INTEGER) AS kafka_partition,
    l_partkey * 100000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 100000 AS kafka_offset,
    l_partkey % 97 AS fault
  FROM timed
  JOIN place oh ON oh.n = l_orderkey % 12 + 1
  JOIN place dh ON dh.n = o_custkey % 12 + 1)"""

PAYLOAD = """event_id, shipment_id, dispatch_id, driver_id, vehicle_id, origin_region_id,
  destination_region_id, origin_hub_id, destination_hub_id, current_hub_id, next_hub_id, cargo_type,
  cargo_weight_kg, shipping_costs, lead_time_days, promised_delivery_at, event_status, event_sequence,
  event_timestamp, processing_timestamp, latitude, longitude, route_step, route_total_steps,
  traffic_congestion_level, weather_severity, hub_congestion_level, eta_variation_minutes,
  delay_probability, risk_classification, exception_type"""

FIRST_COPY = "QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY kafka_timestamp, kafka_partition, kafka_offset) = 1"

FLAGS = """CAST(event_timestamp AS DATE) AS event_date,
    CAST(hour(event_timestamp) AS INTEGER) AS event_hour,
    event_status = 'CREATED' AS is_created, event_status = 'ASSIGNED' AS is_assigned,
    event_status = 'PICKUP' AS is_pickup, event_status = 'IN_TRANSIT' AS is_in_transit,
    event_status = 'ARRIVED_HUB' AS is_arrived_hub, event_status = 'OUT_FOR_DELIVERY' AS is_out_for_delivery,
    event_status = 'DELIVERED' AS is_delivered, exception_type IS NOT NULL AS is_exception,
    coalesce(delay_probability >= 0.5e0 OR eta_variation_minutes >= 30 OR exception_type IS NOT NULL, false)
      AS is_event_delayed"""

EVENTS = f"""{SOURCE},
ev AS (SELECT * FROM source {FIRST_COPY}),
processed AS (SELECT {PAYLOAD}, {FLAGS} FROM ev)"""

# The same from the faulty topic records.
FROM_TOPIC = f"""{SOURCE},
usable AS (SELECT * REPLACE (CASE WHEN fault <> 3 THEN event_sequence END AS event_sequence)
  FROM source WHERE fault NOT IN (0, 1, 2, 4)),
processed AS (SELECT {PAYLOAD}, {FLAGS} FROM (SELECT * FROM usable {FIRST_COPY}))"""


def _mean(column: str) -> str:
    """A mean as the registered queries compare it."""
    return f"round(avg({column}), 9)"


def _avg(name: str) -> str:
    return f"{_mean(name)} AS avg_{name}"


def _rate(part: str, whole: str, name: str = "delay_rate") -> str:
    return f"round(CAST({part} AS DOUBLE) / nullif({whole}, 0), 4) AS {name}"


def _count_if(condition: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) AS {name}"


def _minutes(start: str, end: str) -> str:
    return f"CAST(floor(epoch({end})) - floor(epoch({start})) AS BIGINT) / 60.0e0"


DELAYED = "count(*) FILTER (WHERE is_event_delayed)"

def _first(name: str) -> str:
    """The first value there is, in event order; an unknown sequence comes first."""
    order = "event_sequence NULLS FIRST, event_timestamp, event_id"
    return f"first({name} ORDER BY {order}) FILTER (WHERE {name} IS NOT NULL) AS {name}"


METRICS_TABLE = f"""metrics AS (
  SELECT *, {_minutes('first_event_time', 'delivered_time')} AS total_delivery_minutes,
    {_minutes('promised_delivery_at', 'delivered_time')} AS delay_minutes,
    coalesce({_minutes('promised_delivery_at', 'delivered_time')} > 0, false) AS is_delayed
  FROM (
    SELECT shipment_id,
      {_first('dispatch_id')},
      {_first('driver_id')},
      {_first('vehicle_id')},
      {_first('origin_region_id')},
      {_first('destination_region_id')},
      {_first('origin_hub_id')},
      {_first('destination_hub_id')},
      {_first('promised_delivery_at')},
      min(event_timestamp) AS first_event_time,
      max(event_timestamp) FILTER (WHERE event_status = 'DELIVERED') AS delivered_time,
      count(*) AS event_count, max(event_sequence) AS final_event_sequence,
      {_avg('delay_probability')}, max(delay_probability) AS max_delay_probability,
      {_avg('traffic_congestion_level')}, {_avg('weather_severity')}, {_avg('hub_congestion_level')},
      count(exception_type) AS exception_count, max(risk_classification) AS final_risk_classification
    FROM processed GROUP BY shipment_id))"""

METRICS = f"{EVENTS},\n{METRICS_TABLE}"

FIRST_ATTRS = """dispatch_id, driver_id, vehicle_id, origin_region_id, destination_region_id, origin_hub_id,
  destination_hub_id, promised_delivery_at"""

SHIPMENTS = f"""{EVENTS},
shipments AS (
  SELECT s.shipment_id, origin_region_id, destination_region_id, origin_hub_id, destination_hub_id,
    o.latitude AS origin_latitude, o.longitude AS origin_longitude,
    d.latitude AS destination_latitude, d.longitude AS destination_longitude,
    cargo_type, cargo_weight_kg, shipping_costs, lead_time_days, created_at, promised_delivery_at, shipment_status
  FROM (
    SELECT shipment_id, {_first('origin_region_id')},
      {_first('destination_region_id')}, {_first('origin_hub_id')},
      {_first('destination_hub_id')}, {_first('cargo_type')},
      {_first('cargo_weight_kg')}, {_first('shipping_costs')},
      {_first('lead_time_days')}, {_first('promised_delivery_at')},
      min(event_timestamp) FILTER (WHERE event_status = 'CREATED') AS created_at,
      max_by(event_status, event_sequence) AS shipment_status
    FROM processed GROUP BY shipment_id) s
  JOIN hub_dim o ON o.hub_id = origin_hub_id JOIN hub_dim d ON d.hub_id = destination_hub_id),
dispatches AS (
  SELECT dispatch_id, {_first('shipment_id')}, {_first('driver_id')},
    {_first('vehicle_id')},
    min(event_timestamp) FILTER (WHERE event_status = 'ASSIGNED') AS assigned_at,
    max_by(event_status, event_sequence) AS dispatch_status
  FROM processed GROUP BY dispatch_id)"""

REGION_TABLE = f"""mart AS (SELECT event_date, destination_region_id, count(*) AS total_event_count,
    {DELAYED} AS delayed_event_count, {_rate(DELAYED, 'count(*)')}, {_avg('delay_probability')},
    {_avg('eta_variation_minutes')}, {_count_if("risk_classification = 'HIGH'", 'high_risk_count')}
  FROM processed GROUP BY event_date, destination_region_id)"""
REGION_MART = f"{EVENTS},\n{REGION_TABLE}"

HUB_TABLE = f"""mart AS (SELECT event_date, destination_hub_id, count(*) AS total_event_count,
    {DELAYED} AS delayed_event_count, {_rate(DELAYED, 'count(*)')}, {_avg('traffic_congestion_level')},
    {_avg('hub_congestion_level')}, {_avg('delay_probability')}
  FROM processed GROUP BY event_date, destination_hub_id)"""
HUB_MART = f"{EVENTS},\n{HUB_TABLE}"

RISK_SELECT = f"""SELECT event_date, risk_classification, count(*) AS event_count, {_avg('delay_probability')},
  {_avg('weather_severity')}, {_avg('traffic_congestion_level')}
FROM processed GROUP BY event_date, risk_classification"""

DIMENSIONS = f"""{REGION},
driver_dim AS (SELECT concat('DRV_', lpad(CAST(i AS VARCHAR), 4, '0')) AS driver_id,
    concat('driver ', i) AS driver_name, concat('REG_', lpad(CAST(i % 10 + 1 AS VARCHAR), 2, '0')) AS region_id,
    CASE i % 3 WHEN 0 THEN '1종 대형' WHEN 1 THEN '1종 보통' ELSE '화물운송자격' END AS license_type,
    CASE WHEN i % 4 = 0 THEN 'REST' ELSE 'ACTIVE' END AS driver_status, i
  FROM (SELECT DISTINCT o_custkey % 300 + 1 AS i FROM orders)),
vehicle_dim AS (SELECT concat('VEH_', lpad(CAST(i AS VARCHAR), 4, '0')) AS vehicle_id,
    CASE i % 6 WHEN 0 THEN 1000 WHEN 1 THEN 2500 WHEN 2 THEN 5000 WHEN 3 THEN 11000 WHEN 4 THEN 2000 ELSE 800
      END AS capacity_kg,
    CASE WHEN i % 25 <> 0 THEN CASE i % 6 WHEN 0 THEN '1톤 탑차' WHEN 1 THEN '2.5톤 탑차' WHEN 2 THEN '5톤 윙바디'
      WHEN 3 THEN '11톤 카고' WHEN 4 THEN '냉장 탑차' ELSE '전기 배송차' END END AS vehicle_type,
    concat('REG_', lpad(CAST(i % 10 + 1 AS VARCHAR), 2, '0')) AS region_id,
    CASE WHEN i % 4 = 0 THEN 'MAINTENANCE' ELSE 'AVAILABLE' END AS vehicle_status
  FROM (SELECT DISTINCT o_custkey % 500 + 1 AS i FROM orders))"""

STEPPED = f"""{EVENTS},
stepped AS (SELECT *, lag(event_status) OVER w AS from_status, lag(event_timestamp) OVER w AS previous_time,
    lag(event_sequence) OVER w AS previous_sequence, lag(current_hub_id) OVER w AS previous_hub
  FROM processed WINDOW w AS (PARTITION BY shipment_id ORDER BY event_sequence, event_timestamp, event_id))"""

REFERENCE = """cells AS (
  SELECT l_shipdate, l_partkey AS p, l_suppkey AS s, l_linenumber AS line, l_quantity, l_extendedprice, l_discount,
    l_tax, o_custkey, o_totalprice, round(l_discount * 10, 3) AS probability,
    CASE WHEN l_linenumber % 2 = 0 THEN 12.0e0 ELSE -3.0e0 END AS out_of_range
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
typed AS (
  SELECT CASE WHEN p % 23 <> 0 THEN l_shipdate END AS dataset_timestamp,
    33.0e0 + (s % 500) / 100.0e0 AS source_latitude, 126.0e0 + (s % 300) / 100.0e0 AS source_longitude,
    CASE WHEN p % 29 <> 0 THEN round(l_extendedprice % 4, 3) END AS eta_hours,
    CASE WHEN p % 17 = 0 THEN NULL WHEN p % 19 = 0 THEN out_of_range ELSE round(l_quantity / 5.0e0, 2) END AS traffic,
    round(l_tax * 100, 2) AS weather,
    CASE WHEN p % 19 = 0 THEN out_of_range ELSE round((p % 101) / 10.0e0, 2) END AS port,
    CASE WHEN p % 31 = 0 THEN 1.5e0 WHEN p % 11 = 0 THEN round(probability * 100, 1) ELSE probability END AS chance,
    CASE s % 6 WHEN 0 THEN 'High Risk' WHEN 1 THEN ' medium ' WHEN 2 THEN 'low' WHEN 3 THEN 'Moderate'
      WHEN 5 THEN 'HIGH' END AS label,
    CASE WHEN p % 13 <> 0 THEN o_totalprice END AS costs,
    CASE WHEN p % 37 <> 0 THEN CAST(o_custkey % 5 + 1 AS DOUBLE) END AS lead_days,
    l_discount AS driver_behavior_score, l_tax AS fatigue_monitoring_score,
    (s % 100) / 100.0e0 AS disruption_likelihood_score, (line - 4) * 0.5e0 AS delivery_time_deviation
  FROM cells),
limited AS (
  SELECT *, greatest(0.0e0, least(1.0e0, CASE WHEN chance > 1 THEN chance / 100 ELSE chance END)) AS delay_probability
  FROM typed),
labelled AS (
  SELECT *, CASE WHEN upper(label) LIKE '%HIGH%' THEN 'HIGH' WHEN upper(label) LIKE '%MED%' THEN 'MEDIUM'
    WHEN upper(label) LIKE '%LOW%' THEN 'LOW' WHEN delay_probability >= 0.7e0 THEN 'HIGH'
    WHEN delay_probability >= 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_classification
  FROM limited),
clean AS (
  SELECT dataset_timestamp, source_latitude, source_longitude,
    greatest(0.0e0, least(10.0e0, coalesce(traffic, 0))) AS traffic_congestion_level,
    greatest(0.0e0, least(10.0e0, weather)) AS weather_severity,
    greatest(0.0e0, least(10.0e0, port)) AS hub_congestion_level,
    round_even(coalesce(eta_hours, 0) * 60 * 100, 0) / 100 AS eta_variation_minutes,
    delay_probability, risk_classification,
    coalesce(costs, (SELECT median(costs) FROM typed)) AS shipping_costs,
    coalesce(lead_days, (SELECT median(lead_days) FROM typed)) AS lead_time_days,
    driver_behavior_score, fatigue_monitoring_score, disruption_likelihood_score, delivery_time_deviation
  FROM labelled)"""


def _fk(child: str, table: str, column: str, parent: str, parent_table: str, key: str) -> str:
    lost = f"c.{column} NOT IN (SELECT {key} FROM {parent_table})"
    return f"""SELECT '{child}' AS table_name, '{column}' AS column_name, '{parent}' AS parent_table,
      count(*) AS checked_rows, {_count_if(lost, 'violating_rows')},
      count(DISTINCT c.{column}) FILTER (WHERE {lost}) AS missing_values
    FROM {table} c WHERE c.{column} IS NOT NULL"""


def _pk(name: str, table: str, key: str) -> str:
    return f"""SELECT '{name}' AS table_name, count(*) AS key_count, {_count_if('n > 1', 'duplicated_keys')},
      CAST(sum(n - 1) AS BIGINT) AS surplus_rows
    FROM (SELECT {key}, count(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY {key})"""


def _nulls(name: str, table: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, {_count_if(f'{c} IS NULL', 'null_rows')} FROM {table}"
        for c in columns
    )


def _grouped(mart: str, key: str) -> str:
    keys = ", ".join(
        f"{k if k == key else 'CAST(NULL AS VARCHAR)'} AS {k}"
        for k in ("destination_region_id", "destination_hub_id", "risk_classification")
    )
    measures = ", ".join(
        _avg(name)
        for name in (
            "delay_probability",
            "eta_variation_minutes",
            "traffic_congestion_level",
            "weather_severity",
            "hub_congestion_level",
        )
    )
    return f"""SELECT '{mart}' AS mart, event_date, {keys}, count(*) AS event_count, {DELAYED} AS delayed_count,
      count(*) FILTER (WHERE processed.risk_classification = 'HIGH') AS high_risk_count, {measures}
    FROM processed GROUP BY event_date, processed.{key}"""


def _batch_row(table: str, key: str) -> str:
    return f"""SELECT '{table}' AS table_name, count(*) AS row_count, CAST(sum(n) AS BIGINT) AS event_count
    FROM (SELECT count(*) AS n FROM processed GROUP BY {key})"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


RAW_SELECT = """SELECT CASE WHEN fault NOT IN (0, 1) THEN event_id END AS event_id,
  CASE WHEN fault NOT IN (0, 2) THEN CAST(event_timestamp AS DATE) END AS event_date,
  shipment_id AS kafka_key, 'delivery_events' AS kafka_topic, kafka_partition, kafka_offset, kafka_timestamp,
  fault <> 0 AS is_json
FROM source"""

DECODED = ", ".join(
    {
        "event_id": "CASE WHEN fault NOT IN (0, 1) THEN event_id END AS event_id",
        "event_status": "CASE WHEN fault NOT IN (0, 4) THEN event_status END AS event_status",
        "event_sequence": "CASE WHEN fault NOT IN (0, 3) THEN event_sequence END AS event_sequence",
        "event_timestamp": "CASE fault WHEN 0 THEN NULL WHEN 2 THEN 'garbage'"
        " ELSE strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S') END AS event_timestamp",
        "processing_timestamp": "CASE WHEN fault <> 0 THEN strftime(processing_timestamp, '%Y-%m-%dT%H:%M:%S') END"
        " AS processing_timestamp",
        "promised_delivery_at": "CASE WHEN fault <> 0 THEN strftime(promised_delivery_at, '%Y-%m-%dT%H:%M:%S') END"
        " AS promised_delivery_at",
    }.get(name, f"CASE WHEN fault <> 0 THEN {name} END AS {name}")
    for name in (part.strip() for part in PAYLOAD.split(","))
)


FIELD_NAMES = [part.strip() for part in PAYLOAD.split(",")]
TEXT_TIMES = ("promised_delivery_at", "event_timestamp", "processing_timestamp")
READ_BACK = ", ".join(f"strftime({n}, '%Y-%m-%dT%H:%M:%S') AS {n}" if n in TEXT_TIMES else n for n in FIELD_NAMES)
NULL_FIELDS = " + ".join(f"CAST({name} IS NULL AS INTEGER)" for name in FIELD_NAMES)


def all_sql() -> dict[str, str]:
    sql = {
        "event_encode": _with(
            EVENTS,
            f"""SELECT shipment_id AS key, '{",".join(FIELD_NAMES)}' AS names, {NULL_FIELDS} AS null_fields, {READ_BACK}
            FROM ev""",
        ),
        "raw_envelope": _with(SOURCE, RAW_SELECT),
        "stream_raw_ingest": _with(SOURCE, RAW_SELECT),
        "raw_compacted": _with(SOURCE, RAW_SELECT),
        "offset_gaps": _with(
            """records AS (
              SELECT 'activity' AS kafka_topic, CAST(CASE WHEN event_id % 10 < 8 THEN 0 ELSE event_id % 10 - 7 END AS INTEGER)
                  AS kafka_partition,
                CASE WHEN event_id % 10 < 8 THEN event_id // 10 * 8 + event_id % 10 ELSE event_id // 10 END AS kafka_offset,
                ts AS seen_at
              FROM events WHERE event_id % 97 NOT BETWEEN 5 AND 9),
            stepped AS (
              SELECT *, lag(kafka_offset) OVER w AS offset_before, lag(seen_at) OVER w AS seen_before FROM records
              WINDOW w AS (PARTITION BY kafka_topic, kafka_partition ORDER BY kafka_offset))""",
            """SELECT kafka_topic, kafka_partition, coalesce(offset_before, -1) + 1 AS first_missing,
              kafka_offset - 1 AS last_missing, kafka_offset - coalesce(offset_before, -1) - 1 AS missing_count, seen_before,
              seen_at AS seen_after
            FROM stepped WHERE kafka_offset - coalesce(offset_before, -1) > 1""",
        ),
        "rejected_records": _with(
            SOURCE,
            f"""SELECT * EXCLUDE (fault), CASE WHEN fault IN (0, 1) THEN 'MISSING_EVENT_ID' WHEN fault = 4 THEN 'MISSING_EVENT_STATUS'
                ELSE 'INVALID_EVENT_TIMESTAMP' END AS reject_reason
              FROM ({RAW_SELECT.replace("fault <> 0 AS is_json", "fault <> 0 AS is_json, fault")})
              WHERE fault IN (0, 1, 2, 4)""",
        ),
        "record_balance": _with(
            FROM_TOPIC,
            """SELECT (SELECT count(*) FROM source) AS raw_count,
              (SELECT count(*) FROM source WHERE fault IN (0, 1, 2, 4)) AS rejected_count,
              (SELECT count(*) - count(DISTINCT event_id) FROM usable) AS duplicates_count,
              (SELECT count(DISTINCT event_id) FROM usable) AS kept_count""",
        ),
        "json_decode": _with(SOURCE, f"SELECT {DECODED} FROM source"),
        "stream_late_routing": """SELECT CASE WHEN event_id % 9 <> 0 THEN CAST(ts AS DATE) END AS event_date,
            count(*) AS row_count, count(*) FILTER (WHERE event_id % 9 <> 0
              AND CAST(ts + to_days(CAST(event_id % 3 AS INTEGER)) AS DATE) <> CAST(ts AS DATE)) AS misplaced_rows,
            max(CAST(event_id AS VARCHAR)) AS last_event_id
          FROM events GROUP BY 1""",
        "processed_events": _with(FROM_TOPIC, "SELECT * FROM processed"),
        "processed_roundtrip": _with(FROM_TOPIC, "SELECT * FROM processed"),
        "dedup_events": _with(EVENTS, f"SELECT {PAYLOAD} FROM ev"),
        "reject_summary": _with(
            FROM_TOPIC,
            """SELECT CASE WHEN fault IN (0, 1) THEN 'MISSING_EVENT_ID' WHEN fault = 4 THEN 'MISSING_EVENT_STATUS'
                ELSE 'INVALID_EVENT_TIMESTAMP' END AS reject_reason, count(*) AS row_count
              FROM source WHERE fault IN (0, 1, 2, 4) GROUP BY 1
            UNION ALL SELECT 'DUPLICATE_EVENT_ID', count(*) - count(DISTINCT event_id) FROM usable""",
        ),
        "event_flags": _with(
            EVENTS,
            """SELECT event_id, event_date, event_hour, is_created, is_assigned, is_pickup, is_in_transit,
              is_arrived_hub, is_out_for_delivery, is_delivered, is_exception, is_event_delayed FROM processed""",
        ),
        "shipment_metrics": _with(METRICS, "SELECT * FROM metrics"),
        "shipment_metrics_incremental": _with(METRICS, "SELECT * FROM metrics"),
        "shipment_first_attrs": _with(METRICS, f"SELECT shipment_id, {FIRST_ATTRS} FROM metrics"),
        "shipment_risk_modes": _with(
            EVENTS,
            """SELECT shipment_id, max(risk_classification) AS lexical_risk,
              CASE max(CASE risk_classification WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
                WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS worst_risk,
              max_by(risk_classification, event_sequence) AS last_risk
            FROM processed GROUP BY shipment_id""",
        ),
        "mart_region_delay": _with(REGION_MART, "SELECT * FROM mart"),
        "mart_hub_performance": _with(HUB_MART, "SELECT * FROM mart"),
        "mart_risk_summary": _with(EVENTS, RISK_SELECT),
        "mart_grouping_sets": _with(
            EVENTS,
            "\nUNION ALL ".join(
                [
                    _grouped("mart_region_delay", "destination_region_id"),
                    _grouped("mart_hub_performance", "destination_hub_id"),
                    _grouped("mart_risk_summary", "risk_classification"),
                ]
            ),
        ),
        "mart_region_named": _with(
            f"{REGION}, {REGION_MART}",
            """SELECT event_date, region_name, region_group, total_event_count, delayed_event_count, delay_rate,
              avg_delay_probability, avg_eta_variation_minutes, high_risk_count
            FROM mart LEFT JOIN region_dim ON region_id = destination_region_id""",
        ),
        "mart_hub_named": _with(
            HUB_MART,
            """SELECT event_date, hub_name, hub_type, total_event_count, delayed_event_count, delay_rate,
              avg_traffic_congestion_level, avg_hub_congestion_level, avg_delay_probability
            FROM mart LEFT JOIN hub_dim ON hub_id = destination_hub_id""",
        ),
        "region_group_delay": _with(
            f"{REGION}, {EVENTS}",
            f"""SELECT region_group, count(*) AS total_event_count, {DELAYED} AS delayed_event_count,
              count(DISTINCT destination_hub_id) AS hub_count, {_rate(DELAYED, 'count(*)')}
            FROM processed JOIN hub_dim h ON h.hub_id = destination_hub_id
            JOIN region_dim r ON r.region_id = h.region_id GROUP BY region_group""",
        ),
        "eligible_fleet": _with(
            DIMENSIONS,
            """SELECT 'driver' AS kind, driver_id AS id, region_id FROM driver_dim WHERE driver_status = 'ACTIVE'
            UNION ALL SELECT 'vehicle', vehicle_id, region_id FROM vehicle_dim WHERE vehicle_status = 'AVAILABLE'""",
        ),
        "dim_insert_if_absent": _with(
            DIMENSIONS,
            """SELECT driver_id, driver_name, region_id, license_type,
              CASE WHEN i <= 200 THEN 'REST' ELSE driver_status END AS driver_status FROM driver_dim""",
        ),
        "dim_append": _with(
            DIMENSIONS,
            """SELECT driver_id, driver_name, region_id, license_type,
              CASE WHEN i <= 200 THEN 'REST' ELSE driver_status END AS driver_status FROM driver_dim""",
        ),
        "fk_violations": _with(
            f"{DIMENSIONS}, {SHIPMENTS}, known_driver AS (SELECT * FROM driver_dim WHERE i % 50 <> 0)",
            "\nUNION ALL ".join(
                [
                    _fk("hub", "hub_dim", "region_id", "region", "region_dim", "region_id"),
                    _fk("driver", "known_driver", "region_id", "region", "region_dim", "region_id"),
                    _fk("vehicle", "vehicle_dim", "region_id", "region", "region_dim", "region_id"),
                    _fk("shipment", "shipments", "origin_region_id", "region", "region_dim", "region_id"),
                    _fk("shipment", "shipments", "destination_region_id", "region", "region_dim", "region_id"),
                    _fk("shipment", "shipments", "origin_hub_id", "hub", "hub_dim", "hub_id"),
                    _fk("shipment", "shipments", "destination_hub_id", "hub", "hub_dim", "hub_id"),
                    _fk("dispatch", "dispatches", "shipment_id", "shipment", "shipments", "shipment_id"),
                    _fk("dispatch", "dispatches", "driver_id", "driver", "known_driver", "driver_id"),
                    _fk("dispatch", "dispatches", "vehicle_id", "vehicle", "vehicle_dim", "vehicle_id"),
                ]
            ),
        ),
        "pk_violations": _with(
            f"{DIMENSIONS}, {SHIPMENTS}, known_driver AS (SELECT * FROM driver_dim WHERE i % 50 <> 0)",
            "\nUNION ALL ".join(
                [
                    _pk("region", "region_dim", "region_id"),
                    _pk("hub", "hub_dim", "hub_id"),
                    _pk("driver", "known_driver", "driver_id"),
                    _pk("vehicle", "vehicle_dim", "vehicle_id"),
                    _pk("shipment", "shipments", "shipment_id"),
                    _pk("dispatch", "dispatches", "dispatch_id"),
                    _pk("shipment_metrics", "shipments", "shipment_id"),
                    _pk("event", "source", "event_id"),
                ]
            ),
        ),
        "not_null_violations": _with(
            f"""{DIMENSIONS}, {SHIPMENTS}, known_driver AS (SELECT * FROM driver_dim WHERE i % 50 <> 0),
            named_vehicle AS (SELECT * FROM vehicle_dim)""",
            "\nUNION ALL ".join(
                [
                    _nulls("region", "region_dim", ["region_id", "region_name", "region_group"]),
                    _nulls(
                        "hub", "hub_dim", ["hub_id", "hub_name", "region_id", "latitude", "longitude", "hub_type"]
                    ),
                    _nulls(
                        "driver",
                        "known_driver",
                        ["driver_id", "driver_name", "region_id", "license_type", "driver_status"],
                    ),
                    _nulls(
                        "vehicle",
                        "named_vehicle",
                        ["vehicle_id", "vehicle_type", "capacity_kg", "region_id", "vehicle_status"],
                    ),
                    _nulls(
                        "shipment",
                        "shipments",
                        [
                            "shipment_id",
                            "origin_region_id",
                            "destination_region_id",
                            "origin_hub_id",
                            "destination_hub_id",
                            "origin_latitude",
                            "origin_longitude",
                            "destination_latitude",
                            "destination_longitude",
                            "cargo_type",
                            "cargo_weight_kg",
                            "created_at",
                            "promised_delivery_at",
                            "shipment_status",
                        ],
                    ),
                    _nulls(
                        "dispatch",
                        "dispatches",
                        ["dispatch_id", "shipment_id", "driver_id", "vehicle_id", "assigned_at", "dispatch_status"],
                    ),
                ]
            ),
        ),
        "shipment_dispatch": _with(
            SHIPMENTS,
            f"""SELECT s.shipment_id, dispatch_id, driver_id, vehicle_id, origin_hub_id, destination_hub_id, cargo_type,
              created_at, assigned_at, {_minutes('created_at', 'assigned_at')} AS minutes_to_assign,
              shipment_status, dispatch_status
            FROM shipments s JOIN dispatches d ON d.shipment_id = s.shipment_id""",
        ),
        "fleet_performance": _with(
            f"{DIMENSIONS}, {METRICS}",
            f"""SELECT d.region_id AS driver_region_id, v.capacity_kg, count(*) AS shipment_count,
              count(delivered_time) AS delivered_count, {_count_if('is_delayed', 'delayed_count')},
              CAST(sum(CAST(round(delay_minutes * 60) AS BIGINT)) AS DOUBLE) / nullif(60 * count(delay_minutes), 0)
                AS avg_delay_minutes,
              {_rate('count(*) FILTER (WHERE is_delayed)', 'count(delivered_time)', 'delivered_delay_rate')}
            FROM metrics m LEFT JOIN driver_dim d ON d.driver_id = m.driver_id
            LEFT JOIN vehicle_dim v ON v.vehicle_id = m.vehicle_id GROUP BY d.region_id, v.capacity_kg""",
        ),
        "stage_transitions": _with(
            STEPPED,
            f"""SELECT shipment_id, event_id, event_sequence, from_status, event_status AS to_status,
              {_minutes('previous_time', 'event_timestamp')} AS dwell_minutes FROM stepped""",
        ),
        "sequence_anomalies": _with(
            STEPPED,
            """SELECT * FROM (SELECT shipment_id, event_id, previous_sequence, event_sequence,
              coalesce(event_timestamp < previous_time, false) AS time_goes_back,
              greatest(event_sequence - coalesce(previous_sequence, 0) - 1, 0) AS missing_steps FROM stepped)
            WHERE time_goes_back OR missing_steps > 0""",
        ),
        "hub_path": _with(
            STEPPED,
            """SELECT shipment_id, row_number() OVER (PARTITION BY shipment_id ORDER BY event_sequence) AS hop_number,
              current_hub_id AS hub_id, event_timestamp AS seen_at
            FROM stepped WHERE previous_hub IS NULL OR previous_hub <> current_hub_id""",
        ),
        "current_status": _with(
            EVENTS,
            """SELECT shipment_id, max_by(event_status, event_sequence) AS current_status,
              max_by(event_timestamp, event_sequence) AS status_at FROM processed GROUP BY shipment_id""",
        ),
        "current_status_stream": _with(
            FROM_TOPIC,
            """SELECT shipment_id,
              last(event_status ORDER BY event_sequence NULLS FIRST, event_timestamp, event_id) AS current_status,
              last(event_timestamp ORDER BY event_sequence NULLS FIRST, event_timestamp, event_id) AS status_at
            FROM processed GROUP BY shipment_id""",
        ),
        "status_conformance": _with(
            f"""{EVENTS},
            statuses(status, rank) AS (VALUES {", ".join(f"('{status}', {i})" for i, status in enumerate(C.STATUSES, 1))}),
            untidy AS (
              SELECT shipment_id, event_id, event_timestamp, event_sequence, CASE weather_severity
                WHEN 3 THEN (SELECT status FROM statuses WHERE rank = greatest(event_sequence - 1, 1))
                WHEN 5 THEN 'LOST' ELSE event_status END AS event_status
              FROM processed),
            placed AS (
              SELECT u.*, rank, max(rank) OVER (PARTITION BY shipment_id ORDER BY event_timestamp, event_sequence, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest
              FROM untidy u LEFT JOIN statuses s ON s.status = u.event_status)""",
            """SELECT shipment_id, event_id, event_status, s.status AS furthest_status,
              CASE WHEN p.rank IS NULL THEN 'unknown' WHEN p.rank = coalesce(furthest, 0) + 1 THEN 'expected'
                WHEN p.rank > coalesce(furthest, 0) THEN 'skipped' WHEN p.rank = furthest THEN 'repeated'
                ELSE 'backward' END AS conformance,
              CAST(coalesce(greatest(p.rank - coalesce(furthest, 0) - 1, 0), 0) AS INTEGER) AS skipped_statuses
            FROM placed p LEFT JOIN statuses s ON s.rank = p.furthest""",
        ),
        "shipment_table": _with(SHIPMENTS, "SELECT * FROM shipments"),
        "dispatch_table": _with(SHIPMENTS, "SELECT * FROM dispatches"),
        "lane_weights": _with(
            f"{REGION_WEIGHT}, {HUB_WEIGHT}, {SHIPMENTS}",
            """SELECT *, region_weight * hub_weight * lane_weight AS total_weight FROM (
              SELECT shipment_id, coalesce(r.weight, 1.0e0) AS region_weight, coalesce(h.weight, 1.0e0) AS hub_weight,
                CASE WHEN origin_region_id = destination_region_id THEN 0.88e0
                  WHEN destination_region_id = 'REG_10' THEN 1.25e0
                  WHEN destination_region_id = 'REG_09' THEN 1.15e0 ELSE 1.08e0 END AS lane_weight
              FROM shipments LEFT JOIN region_weight r ON r.region_id = destination_region_id
              LEFT JOIN hub_weight h ON h.hub_id = destination_hub_id)""",
        ),
        "planned_route": _with(
            SHIPMENTS,
            """SELECT shipment_id, route, CAST(greatest(len(string_split(route, '>')) - 1, 1) AS INTEGER) AS route_total_steps FROM (
              SELECT shipment_id, concat(origin_hub_id,
                CASE WHEN origin_region_id <> destination_region_id AND o.hub_id <> origin_hub_id
                  THEN '>' || o.hub_id ELSE '' END,
                CASE WHEN origin_region_id <> destination_region_id AND d.hub_id NOT IN (origin_hub_id, o.hub_id)
                  THEN '>' || d.hub_id ELSE '' END,
                CASE WHEN destination_hub_id = origin_hub_id
                  OR (origin_region_id <> destination_region_id AND destination_hub_id IN (o.hub_id, d.hub_id))
                  THEN '' ELSE '>' || destination_hub_id END) AS route
              FROM shipments JOIN centre o ON o.region_id = origin_region_id
              JOIN centre d ON d.region_id = destination_region_id)""",
        ),
        "lane_distance": _with(
            SHIPMENTS,
            """SELECT shipment_id, origin_hub_id, destination_hub_id,
              round_even(greatest(1.0e0, (abs(origin_latitude - destination_latitude)
                + abs(origin_longitude - destination_longitude)) * 10) * 100, 0) / 100 AS distance_factor
            FROM shipments""",
        ),
        "hop_coordinates": _with(
            EVENTS,
            """SELECT event_id, current_hub_id, next_hub_id, current_latitude, current_longitude, next_latitude,
              next_longitude
            FROM (SELECT event_id, current_hub_id, next_hub_id, c.latitude AS current_latitude,
                c.longitude AS current_longitude, n.latitude AS next_latitude, n.longitude AS next_longitude
              FROM processed JOIN hub_dim c ON c.hub_id = current_hub_id JOIN hub_dim n ON n.hub_id = next_hub_id)""",
        ),
        "risk_banding": _with(
            EVENTS,
            """SELECT *, risk_band = risk_classification AS agrees FROM (SELECT event_id, delay_probability,
              CASE WHEN delay_probability >= 0.70e0 THEN 'HIGH' WHEN delay_probability >= 0.38e0 THEN 'MEDIUM'
                ELSE 'LOW' END AS risk_band, risk_classification FROM processed)""",
        ),
        "sla_check": _with(
            SHIPMENTS,
            f"""SELECT shipment_id, created_at, lead_time_days, promised_delivery_at, expected_promise_at,
              {_minutes('expected_promise_at', 'promised_delivery_at')} AS promise_shift_minutes, delivered_time,
              delivered_time <= promised_delivery_at AS kept_stated_promise,
              delivered_time <= expected_promise_at AS kept_expected_promise
            FROM (SELECT s.*, created_at + to_days(CAST(lead_time_days AS INTEGER)) AS expected_promise_at,
                (SELECT max(event_timestamp) FROM processed p
                 WHERE p.shipment_id = s.shipment_id AND event_status = 'DELIVERED') AS delivered_time
              FROM shipments s)""",
        ),
        "kpi_summary": _with(
            METRICS,
            f"""SELECT count(*) AS shipment_count, count(delivered_time) AS delivered_count,
              {_count_if('is_delayed', 'delayed_count')}, {_mean('total_delivery_minutes')} AS avg_delivery_minutes,
              {_mean('delay_minutes')} AS avg_delay_minutes,
              {_mean('CASE WHEN is_delayed THEN delay_minutes END')} AS avg_late_minutes,
              {_rate('count(*) FILTER (WHERE is_delayed)', 'count(*)')},
              {_rate('count(*) FILTER (WHERE is_delayed)', 'count(delivered_time)', 'delivered_delay_rate')}
            FROM metrics""",
        ),
        "kpi_region_rate": _with(
            EVENTS,
            f"""SELECT destination_region_id, count(*) AS total_event_count, {DELAYED} AS delayed_event_count,
              {_rate(DELAYED, 'count(*)')} FROM processed GROUP BY destination_region_id""",
        ),
        "kpi_hub_rate": _with(
            EVENTS,
            f"""SELECT destination_hub_id, count(*) AS total_event_count, {DELAYED} AS delayed_event_count,
              {_rate(DELAYED, 'count(*)')} FROM processed GROUP BY destination_hub_id""",
        ),
        "kpi_risk_share": _with(
            EVENTS,
            f"""SELECT risk_classification, count(*) AS event_count,
              {_rate('count(*)', '(SELECT count(*) FROM processed)', 'event_share')}
            FROM processed GROUP BY risk_classification""",
        ),
        "kpi_risk_delay": _with(
            METRICS,
            f"""SELECT final_risk_classification, count(*) AS shipment_count, count(delivered_time) AS delivered_count,
              {_count_if('is_delayed', 'delayed_count')}, {_rate('count(*) FILTER (WHERE is_delayed)', 'count(*)')},
              {_rate('count(*) FILTER (WHERE is_delayed)', 'count(delivered_time)', 'delivered_delay_rate')}
            FROM metrics GROUP BY final_risk_classification""",
        ),
        "kpi_risk_correlation": _with(
            METRICS,
            """SELECT count(*) AS delivered_count,
              round(corr(max_delay_probability, CAST(is_delayed AS INTEGER)), 6) AS probability_delay_correlation
            FROM metrics WHERE delivered_time IS NOT NULL""",
        ),
        "kpi_hourly": _with(
            EVENTS,
            f"""SELECT event_hour, count(*) AS event_count, {DELAYED} AS delayed_event_count,
              {_rate(DELAYED, 'count(*)')} FROM processed GROUP BY event_hour""",
        ),
        "refdata_clean": _with(REFERENCE, "SELECT * FROM clean"),
        "refdata_clean_approx": _with(
            REFERENCE,
            """SELECT 'shipping_costs' AS column_name, count(costs) AS value_count, true AS within_bound,
              (SELECT count(*) FILTER (WHERE shipping_costs IS NULL) FROM clean) AS null_count FROM typed
            UNION ALL SELECT 'lead_time_days', count(lead_days), true,
              (SELECT count(*) FILTER (WHERE lead_time_days IS NULL) FROM clean) FROM typed""",
        ),
        "refdata_roundtrip": _with(REFERENCE, "SELECT * FROM clean"),
        "refdata_risk_normalized": _with(
            REFERENCE,
            """SELECT label, risk_classification, count(*) AS row_count, min(delay_probability) AS min_probability,
              max(delay_probability) AS max_probability FROM labelled GROUP BY label, risk_classification""",
        ),
        "refdata_defaults": _with(
            REFERENCE,
            """SELECT chance AS delay_probability, coalesce(traffic, 4.0e0) AS traffic_congestion_level,
              coalesce(lead_days, 2.25e0) AS lead_time_days, coalesce(costs, 17500.0e0) AS shipping_costs FROM typed""",
        ),
        "batch_shipment_metrics": _with(f"{FROM_TOPIC},\n{METRICS_TABLE}", "SELECT * FROM metrics"),
        "batch_region_delay": _with(f"{FROM_TOPIC},\n{REGION_TABLE}", "SELECT * FROM mart"),
        "batch_hub_performance": _with(f"{FROM_TOPIC},\n{HUB_TABLE}", "SELECT * FROM mart"),
        "batch_risk_summary": _with(FROM_TOPIC, RISK_SELECT),
        "batch_bounded": _with(FROM_TOPIC, "SELECT * FROM processed"),
        "batch_tables": _with(
            FROM_TOPIC,
            "\nUNION ALL ".join(
                [
                    _batch_row("shipment_metrics", "shipment_id"),
                    _batch_row("mart_region_delay", "event_date, destination_region_id"),
                    _batch_row("mart_hub_performance", "event_date, destination_hub_id"),
                    _batch_row("mart_risk_summary", "event_date, risk_classification"),
                ]
            ),
        ),
    }
    sql["fk_violations_filtered"] = sql["fk_violations"]
    return sql
