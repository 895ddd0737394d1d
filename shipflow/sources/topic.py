"""Event topic: encoder, envelope, stream sources."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.functions import times


def encode_events(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Events as topic records: key = shipment_id, value = JSON of the 31 fields, nulls included."""
    fields = [
        times.iso_text(F.col(name)).alias(name) if name in S.TIME_COLUMNS else F.col(name)
        for name in S.PAYLOAD_COLUMNS
    ]
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return events.select(F.col("shipment_id").alias("key"), value.alias("value"), *keep)


def kafka_read_options(servers: str, topic: str, starting: str = "latest", max_offsets: int | None = None) -> dict[str, str]:
    """``starting`` applies to the first run only; later runs continue from the checkpoint.

    ``max_offsets`` bounds a micro-batch. A bound below the topic's rate falls behind for good, so none is the default.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    return options if max_offsets is None else options | {"maxOffsetsPerTrigger": str(max_offsets)}


def kafka_stream(spark: SparkSession, servers: str, topic: str, **limits) -> DataFrame:
    """Needs the Kafka connector package on the session."""
    return spark.readStream.format("kafka").options(**kafka_read_options(servers, topic, **limits)).load()


def write_to_topic(records: DataFrame, servers: str, topic: str) -> None:
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same envelope from Parquet files, optionally with a bound on files per micro-batch."""
    reader = spark.readStream.schema(S.ENVELOPE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)
