"""Raw layer -> processed layer: decode, validate, deduplicate, type and flag."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shipflow import schemas as S
from shipflow.functions import labels, times


REQUIRED = ("event_id", "shipment_id", "event_status", "event_timestamp")


def decode(raw: DataFrame, keep: Sequence[str] = (), fields: Sequence[str] = ()) -> DataFrame:
    """JSON payload to its 31 columns, or only ``fields`` of them; ``keep`` names raw columns to carry.

    Bad text gives nulls, a badly typed field is null by itself. ``inline`` parses a payload once;
    with a plain struct column Spark would repeat the parse in every filter on a field.
    """
    schema = StructType([S.PAYLOAD[name] for name in fields]) if fields else S.PAYLOAD
    return raw.select(F.inline(F.array(F.from_json("raw_payload", schema))), *keep)


def type_times(events: DataFrame) -> DataFrame:
    present = [name for name in S.TIME_COLUMNS if name in events.columns]
    return events.withColumns({name: times.to_time(F.col(name)) for name in present})


def reject_reason() -> Column:
    """Why a decoded and typed event cannot be used; null if it can."""
    return (
        F.when(F.col("event_id").isNull(), "MISSING_EVENT_ID")
        .when(F.col("shipment_id").isNull(), "MISSING_SHIPMENT_ID")
        .when(F.col("event_status").isNull(), "MISSING_EVENT_STATUS")
        .when(F.col("event_timestamp").isNull(), "INVALID_EVENT_TIMESTAMP")
    )


def valid_events(raw: DataFrame, keep: Sequence[str] = S.ARRIVAL_ORDER, fields: Sequence[str] = ()) -> DataFrame:
    """Decoded, typed events that pass every check, with their arrival order; ``fields`` as in ``decode``.

    Records without a readable id or date are dropped by the stored columns, before their payload is read: the
    partition without a date is not opened.
    """
    readable = raw.filter(F.col("event_id").isNotNull() & F.col("event_date").isNotNull())
    required = reduce(Column.__and__, [F.col(name).isNotNull() for name in REQUIRED])
    return type_times(decode(readable, keep, fields)).filter(required)


def first_arrivals(
    events: DataFrame, key: str = "event_id", order: Sequence[str] = S.ARRIVAL_ORDER
) -> DataFrame:
    """One row per key: the copy that arrived first.

    Spark applies the rank limit before the shuffle as well, so each map task sends at most one
    copy of a key however many it holds.
    """
    by_arrival = Window.partitionBy(key).orderBy(*order)
    return (
        events.withColumn("_copy", F.row_number().over(by_arrival)).filter(F.col("_copy") == 1).drop("_copy")
    )


def later_arrivals(
    events: DataFrame, key: str = "event_id", order: Sequence[str] = S.ARRIVAL_ORDER
) -> DataFrame:
    """The rows that ``first_arrivals`` leaves out."""
    by_arrival = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_copy", F.row_number().over(by_arrival)).filter(F.col("_copy") > 1).drop("_copy")


def flag_events(events: DataFrame) -> DataFrame:
    """Add event date, hour and the nine flags."""
    return events.withColumns(
        {
            "event_date": F.to_date("event_timestamp"),
            "event_hour": F.hour("event_timestamp"),
            **labels.status_flags(),
            "is_exception": F.col("exception_type").isNotNull(),
            "is_event_delayed": labels.is_event_delayed(),
        }
    )


def processed_events(raw: DataFrame) -> DataFrame:
    """Raw layer to the processed layer. Flags come after the shuffle, to keep it narrow."""
    return decided_events(valid_events(raw))


def decided_events(usable: DataFrame) -> DataFrame:
    """The processed layer's rows from all usable copies of its events."""
    unique = first_arrivals(usable).drop(*S.ARRIVAL_ORDER)
    return flag_events(unique).withColumn("processed_at", F.current_timestamp())


def checked_records(raw: DataFrame) -> DataFrame:
    """Every record decoded and judged once: is_rejected, reject_reason, the record if rejected, the event if not.

    ``record`` has the raw columns, ``event`` the payload's and the arrival order. One of the two is null, so the two
    sides can be stored as one table without repeating a payload.
    """
    held = raw.select("*", F.struct(*S.RAW_COLUMNS).alias("_record"))
    typed = type_times(decode(held, keep=["_record"])).withColumn("reject_reason", reject_reason())
    rejected = F.col("reject_reason").isNotNull()
    event = F.struct(*S.PAYLOAD_COLUMNS, *[F.col("_record")[name].alias(name) for name in S.ARRIVAL_ORDER])
    return typed.select(
        rejected.alias("is_rejected"),
        "reject_reason",
        F.when(rejected, F.col("_record")).alias("record"),
        F.when(~rejected, event).alias("event"),
    )


def reject_summary(raw: DataFrame) -> DataFrame:
    """Rows dropped on the way to the processed layer, by reason.

    Valid rows are first reduced to one row per event_id, so neither a reason nor a much copied
    event meets in one task.
    """
    typed = type_times(decode(raw, fields=REQUIRED)).withColumn("reject_reason", reject_reason())
    counts = typed.groupBy(
        "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("event_id")).alias("event_id")
    ).agg(F.count("*").alias("n"))
    dropped = F.when(F.col("reject_reason").isNull(), F.col("n") - 1).otherwise(F.col("n"))
    return (
        counts.groupBy(F.coalesce("reject_reason", F.lit("DUPLICATE_EVENT_ID")).alias("reject_reason"))
        .agg(F.sum(dropped).alias("row_count"))
        .filter(F.col("row_count") > 0)
    )
