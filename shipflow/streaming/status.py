"""Current status of shipments, kept up to date while their events arrive.

Each micro-batch appends the first copies of its events to one log and the statuses of the shipments that it touches
to another. A status is that of the last event in event order, of the copies that arrived first, over all that has
been seen: neither a late event nor a late copy moves it to where the batch job would not put it.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shipflow import schemas as S
from shipflow.operators import cleanse, flow
from shipflow.session import own_tables, prepare, stored
from shipflow.sources.state_log import StateLog, latest
from shipflow.streaming import ingest

KEY = flow.KEY
STATE_COLUMNS = [KEY, *S.EVENT_ORDER, "event_status", *S.ARRIVAL_ORDER]
STATE = StructType([(S.PROCESSED if name in S.PROCESSED.names else S.RAW)[name] for name in STATE_COLUMNS])
STATUS = StructType().add(KEY, "string").add("current_status", "string").add("status_at", "timestamp")
FOLD_EVERY = 50


def event_log(spark: SparkSession, path: str) -> StateLog:
    """First copies of events, one per event and micro-batch."""
    return StateLog(spark, f"{path}/events", STATE)


def status_log(spark: SparkSession, path: str) -> StateLog:
    """Statuses of touched shipments; a null status is that of a shipment that has lost its events to others."""
    return StateLog(spark, f"{path}/statuses", STATUS)


def _first_copies(events: DataFrame) -> DataFrame:
    return cleanse.first_arrivals(events.select(*STATE_COLUMNS))


def _of(rows: DataFrame, keys: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.join(keys.select(*names), list(names), "left_semi")


def merge_batch(raw: DataFrame, path: str, number: int, fold_every: int = FOLD_EVERY) -> None:
    """Take raw records into the logs as generation ``number``; done twice, the second time changes nothing.

    Only events of touched shipments are read back: those that the batch names, and those that lose an event
    because an earlier copy of it turns up. With them come the copies that their events have elsewhere.
    """
    spark = raw.sparkSession
    events, statuses = event_log(spark, path), status_log(spark, path)
    known = events.read(before=number).select(*STATE_COLUMNS)
    with own_tables():  # both logs are written within, so nothing reads these later
        arrived = stored(_first_copies(cleanse.valid_events(raw)), "arrived")
        owners = _of(known, arrived, ["event_id"]).select(KEY)
        touched = stored(arrived.select(KEY).unionByName(owners).distinct(), "touched")
        held = _of(known, touched, [KEY]).unionByName(arrived).select("event_id").distinct()
        copies = _of(known, held, ["event_id"]).unionByName(arrived)
        events.append(arrived, number)
        current = flow.current_status(_first_copies(copies))
        statuses.append(touched.join(current, KEY, "left"), number)
    if number % fold_every == fold_every - 1:
        events.fold(_first_copies)
        statuses.fold(lambda rows: latest(rows, KEY))


def follow(
    envelope: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fold_every: int = FOLD_EVERY
) -> StreamingQuery:
    """Keep the statuses below ``path`` in step with a topic; path and checkpoint belong together.

    A batch that was cut short is run again under its number, so a restart neither loses nor repeats an event.
    Each batch reads the log once per question, so triggers of a minute or more suit a large log.
    """
    prepare(envelope.sparkSession)

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, path, number, fold_every)

    return (
        ingest.to_raw(envelope)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ingest.EVERY_SECOND))
        .start()
    )


def current_statuses(spark: SparkSession, path: str) -> DataFrame:
    """shipment_id, current_status, status_at as of the last complete batch."""
    return latest(status_log(spark, path).read(), KEY).filter("current_status IS NOT NULL")
