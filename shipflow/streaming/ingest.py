"""Topic -> raw layer. Stateless: each record is projected and appended under its own event date."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shipflow import schemas as S
from shipflow.functions import times
from shipflow.session import prepare
from shipflow.sources import layers

EVERY_SECOND = {"processingTime": "1 second"}
UNTIL_CAUGHT_UP = {"availableNow": True}


def to_raw(envelope: DataFrame) -> DataFrame:
    """Envelope, streaming or not, to the nine raw columns.

    The payload stays text. A record without a readable event time gets a null date and so lands in
    the default partition, where the processed layer's checks find it.
    """
    payload = F.col("value").cast("string")
    # parsed once, as in the batch: a payload that can be decoded there has its id and date here
    fields = F.from_json(payload, "event_id string, event_timestamp string")
    parsed = envelope.select("*", F.inline(F.array(fields)).alias("_id", "_time"))
    return parsed.select(
        F.col("_id").alias("event_id"),
        F.to_date(times.to_time(F.col("_time"))).alias("event_date"),
        F.col("key").cast("string").alias("kafka_key"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        payload.alias("raw_payload"),
        F.current_timestamp().alias("ingested_at"),
    ).select(*S.RAW_COLUMNS)


def start_raw_sink(
    raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append to the raw layer; the checkpoint makes restarts continue without repeats."""
    return (
        raw.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("compression", layers.COMPRESSION)
        .option("checkpointLocation", checkpoint)
        .partitionBy("event_date")
        .trigger(**(trigger or EVERY_SECOND))
        .start()
    )


def ingest(envelope: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Topic to raw layer; event dates are those of UTC, as in the batch."""
    prepare(envelope.sparkSession)
    return start_raw_sink(to_raw(envelope), path, checkpoint, trigger)
