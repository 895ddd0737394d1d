"""Dimension tables: names, attributes, look-ups, insert-if-absent.

Facts are aggregated before they are joined; Spark then broadcasts a dimension whose known size is under its
threshold and otherwise shuffles, with adaptive skew splitting. Unreduced facts take ``bounded`` dimensions.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow import constants as C
from shipflow.functions.numbers import rate
from shipflow.operators.cleanse import first_arrivals
from shipflow.session import own_tables, stored
from shipflow.sources.files import Folder


def _inline(spark: SparkSession, names: str, rows: Sequence[Sequence]) -> DataFrame:
    """Fixed rows as a local relation, whose size Spark knows."""
    texts = [
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{float(v)!r}D" for v in row) + ")" for row in rows
    ]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(texts)} AS t({names})")


def regions(spark: SparkSession) -> DataFrame:
    return _inline(spark, "region_id, region_name, region_group", C.REGIONS)


def hubs(spark: SparkSession) -> DataFrame:
    return _inline(spark, "hub_id, hub_name, region_id, latitude, longitude, hub_type", C.HUBS)


def region_weights(spark: SparkSession) -> DataFrame:
    return _inline(spark, "region_id, region_weight", list(C.REGION_WEIGHTS.items()))


def hub_weights(spark: SparkSession) -> DataFrame:
    return _inline(spark, "hub_id, hub_weight", list(C.HUB_WEIGHTS.items()))


def central_hubs(spark: SparkSession) -> DataFrame:
    return _inline(spark, "region_id, central_hub_id", list(C.CENTRAL_HUBS.items()))


def bounded(dimension: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """The dimension, marked for broadcast if it has at most that many rows.

    For look-ups from unreduced facts: joined by a shuffle, a fact would meet on the few keys of the dimension. The
    count reads no more than most_rows + 1 rows. A larger dimension has as many keys to spread over.
    """
    return F.broadcast(dimension) if dimension.limit(most_rows + 1).count() <= most_rows else dimension


def look_up(df: DataFrame, dimension: DataFrame, fact_key: str, key: str, values: dict[str, str]) -> DataFrame:
    """Left join on ``fact_key = key``, adding dimension columns under new names; ``key`` is unique."""
    columns = [F.col(column).alias(name) for column, name in values.items()]
    side = dimension.select(F.col(key).alias(fact_key), *columns)
    return df.join(side, fact_key, "left")


def mart_region_named(mart: DataFrame, region: DataFrame) -> DataFrame:
    named = look_up(
        mart,
        region,
        "destination_region_id",
        "region_id",
        {"region_name": "region_name", "region_group": "region_group"},
    )
    return named.select("event_date", "region_name", "region_group", *_measures(mart, "destination_region_id"))


def mart_hub_named(mart: DataFrame, hub: DataFrame) -> DataFrame:
    named = look_up(
        mart, hub, "destination_hub_id", "hub_id", {"hub_name": "hub_name", "hub_type": "hub_type"}
    )
    return named.select("event_date", "hub_name", "hub_type", *_measures(mart, "destination_hub_id"))


def _measures(mart: DataFrame, key: str) -> list[str]:
    return [name for name in mart.columns if name not in ("event_date", key, "created_at")]


def region_group_delay(hub_mart: DataFrame, hub: DataFrame, region: DataFrame) -> DataFrame:
    """Hub counts rolled up over hub -> region -> region group."""
    counts = hub_mart.groupBy("destination_hub_id").agg(
        F.sum("total_event_count").alias("total"), F.sum("delayed_event_count").alias("delayed")
    )
    placed = look_up(counts, hub, "destination_hub_id", "hub_id", {"region_id": "region_id"})
    grouped = look_up(placed, region, "region_id", "region_id", {"region_group": "region_group"})
    return (
        grouped.groupBy("region_group")
        .agg(
            F.sum("total").alias("total_event_count"),
            F.sum("delayed").alias("delayed_event_count"),
            F.count("*").alias("hub_count"),
        )
        .withColumn("delay_rate", rate(F.col("delayed_event_count"), F.col("total_event_count")))
    )


def fleet_performance(metrics: DataFrame, driver: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Deliveries and delays by home region of the driver and capacity of the vehicle.

    Metrics are first added up per (driver, vehicle), so a busy driver does not skew the joins.
    Late time is added up in whole seconds, which keeps the sum exact.
    """
    late_seconds = F.round(F.col("delay_minutes") * 60).cast("long")
    teams = metrics.groupBy("driver_id", "vehicle_id").agg(
        F.count("*").alias("shipments"),
        F.count("delivered_time").alias("delivered"),
        F.count_if("is_delayed").alias("delayed"),
        F.sum(late_seconds).alias("late_seconds"),
    )
    with_driver = look_up(teams, driver, "driver_id", "driver_id", {"region_id": "driver_region_id"})
    with_both = look_up(with_driver, vehicle, "vehicle_id", "vehicle_id", {"capacity_kg": "capacity_kg"})
    return (
        with_both.groupBy("driver_region_id", "capacity_kg")
        .agg(
            F.sum("shipments").alias("shipment_count"),
            F.sum("delivered").alias("delivered_count"),
            F.sum("delayed").alias("delayed_count"),
            F.sum("late_seconds").alias("_late_seconds"),
        )
        .select(
            "driver_region_id",
            "capacity_kg",
            "shipment_count",
            "delivered_count",
            "delayed_count",
            F.try_divide(F.col("_late_seconds"), F.col("delivered_count") * 60).alias("avg_delay_minutes"),
            rate(F.col("delayed_count"), F.col("delivered_count")).alias("delivered_delay_rate"),
        )
    )


def in_status(dimension: DataFrame, column: str, status: str) -> DataFrame:
    """Rows in one status; on a stored or JDBC dimension the filter is pushed to the source."""
    return dimension.filter(F.col(column) == status)


def eligible_fleet(driver: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Active drivers and available vehicles."""

    def part(kind: str, dimension: DataFrame) -> DataFrame:
        return dimension.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), "region_id")

    return part("driver", in_status(driver, "driver_status", "ACTIVE")).unionByName(
        part("vehicle", in_status(vehicle, "vehicle_status", "AVAILABLE"))
    )


def append_if_absent(spark: SparkSession, path: str, batch: DataFrame, key: str, order: Sequence[str | Column] = ()) -> int:
    """Add the rows of the batch whose key is new to a stored dimension, and say how many; its files stay as they are.

    Only the keys of the stored table are read. Of equal keys in the batch the first by ``order`` is taken, and a row
    without a key is left out. Run again, also after a run that was cut short while it wrote, it adds what is still
    missing and nothing twice. Two runs at the same time must not add to one path.
    """
    unique = first_arrivals(batch.filter(F.col(key).isNotNull()), key, order or batch.columns)
    with own_tables():
        if Folder(spark, path).exists():
            unique = unique.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
        new = stored(unique, "new-rows")
        count = new.count()
        if count:
            new.write.mode("append").parquet(path)
        return count


def insert_if_absent(
    existing: DataFrame, batch: DataFrame, key: str, order: Sequence[str | Column] = ()
) -> DataFrame:
    """Existing rows plus those of the batch whose key is new; of equal keys the first by ``order``.

    A row without a key cannot be inserted and is left out.
    """
    unique = first_arrivals(batch.filter(F.col(key).isNotNull()), key, order or batch.columns)
    return existing.unionByName(unique.join(existing.select(key), key, "left_anti"))
