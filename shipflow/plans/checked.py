"""Raw layer -> processed layer with the rejected records kept and every record accounted for."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.operators import cleanse
from shipflow.plans import rebuild
from shipflow.sources import layers

CHECKED = """is_rejected boolean, reject_reason string, record struct<{record}>, event struct<{event}>, event_date date"""


@dataclass(frozen=True)
class Balance:
    """Where the records of the raw layer went."""

    raw: int
    rejected: int
    duplicates: int
    kept: int

    def check(self) -> None:
        if self.rejected + self.duplicates + self.kept != self.raw:
            raise ValueError(f"records do not add up: {self}")


def write_checked(raw: DataFrame, path: str) -> tuple[int, int]:
    """Judge all records in one pass and write both sides below ``path``; the number of records, and of rejected ones.

    Events are written by date, as the layer made from them will be; rejected records have none there. The counts are observed while the rows are written, so the input is not read again for them.
    """
    seen = Observation("checked")
    checked = cleanse.checked_records(raw).observe(
        seen, F.count("*").alias("raw"), F.count_if("is_rejected").alias("rejected")
    )
    dated = checked.withColumn("event_date", F.to_date("event.event_timestamp"))
    dated.write.mode("overwrite").option("compression", layers.COMPRESSION).partitionBy("is_rejected", "event_date").parquet(path)
    counts = seen.get
    return counts["raw"], counts["rejected"]


def _side(spark: SparkSession, path: str, rejected: bool) -> DataFrame:
    fields = {"event": [*S.PROCESSED][: len(S.PAYLOAD_COLUMNS)] + [S.RAW[name] for name in S.ARRIVAL_ORDER], "record": [S.RAW[name] for name in S.RAW_COLUMNS]}
    kinds = {side: ", ".join(f"{field.name}: {field.dataType.simpleString()}" for field in of) for side, of in fields.items()}
    whole = spark.read.schema(CHECKED.format(**kinds)).parquet(path)
    return whole.filter(F.col("is_rejected") if rejected else ~F.col("is_rejected"))


def rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw columns of the rejected records, and why each was rejected."""
    return _side(spark, path, True).select("record.*", "reject_reason")


def usable_events(spark: SparkSession, path: str) -> DataFrame:
    """Typed events that passed, with their arrival order, copies included."""
    return _side(spark, path, False).select("event.*")


def build_checked(spark: SparkSession, raw: DataFrame, checked_path: str, processed_path: str) -> Balance:
    """The processed layer, as the batch builds it, from records whose rejects stay below ``checked_path``.

    Payloads are read once, and no event is shuffled. What is kept is counted where it is written; copies of an event are
    what is left.
    """
    n_raw, n_rejected = write_checked(raw, checked_path)
    records = rebuild.located(_side(spark, checked_path, False))
    usable = records.select("event.event_id", *[f"event.{name}" for name in S.ARRIVAL_ORDER], "file", "row")
    events_of = lambda rows: rows.select("event.*").drop(*S.ARRIVAL_ORDER)
    if not rebuild.write_first_copies(records, usable, events_of, processed_path):
        nothing = cleanse.decided_events(usable_events(spark, checked_path))
        layers.write_processed(nothing, processed_path)
    n_kept = layers.read_processed(spark, processed_path).count()  # from the footers of the files
    return Balance(n_raw, n_rejected, n_raw - n_rejected - n_kept, n_kept)
