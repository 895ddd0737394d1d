"""Dashboard figures, taken from shipment metrics and marts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipflow.functions.numbers import rate


def kpi_summary(metrics: DataFrame) -> DataFrame:
    """Shipments, delivery time, delay and delay rate.

    Shipments still on the way count as not delayed in ``delay_rate``; ``delivered_delay_rate`` is
    taken over delivered ones only.
    """
    late_only = metrics.withColumn("late_minutes", F.when(F.col("is_delayed"), F.col("delay_minutes")))
    return late_only.agg(
        F.count("*").alias("shipment_count"),
        F.count("delivered_time").alias("delivered_count"),
        F.count_if("is_delayed").alias("delayed_count"),
        F.avg("total_delivery_minutes").alias("avg_delivery_minutes"),
        F.avg("delay_minutes").alias("avg_delay_minutes"),
        F.avg("late_minutes").alias("avg_late_minutes"),
    ).select(
        "*",
        rate(F.col("delayed_count"), F.col("shipment_count")).alias("delay_rate"),
        rate(F.col("delayed_count"), F.col("delivered_count")).alias("delivered_delay_rate"),
    )


def kpi_rate(mart: DataFrame, key: str) -> DataFrame:
    """Delay rate per region or hub over all dates, from counts and not from daily rates."""
    return (
        mart.groupBy(key)
        .agg(
            F.sum("total_event_count").alias("total_event_count"),
            F.sum("delayed_event_count").alias("delayed_event_count"),
        )
        .withColumn("delay_rate", rate(F.col("delayed_event_count"), F.col("total_event_count")))
    )


def kpi_risk_share(risk_mart: DataFrame) -> DataFrame:
    """Events per risk label and their share; the window runs over the few labels."""
    labels = risk_mart.groupBy("risk_classification").agg(F.sum("event_count").alias("event_count"))
    whole = F.sum("event_count").over(Window.partitionBy(F.lit(0)))
    return labels.withColumn("event_share", rate(F.col("event_count"), whole))


def kpi_risk_delay(metrics: DataFrame) -> DataFrame:
    """Shipments and delay rate per final risk."""
    return (
        metrics.groupBy("final_risk_classification")
        .agg(
            F.count("*").alias("shipment_count"),
            F.count("delivered_time").alias("delivered_count"),
            F.count_if("is_delayed").alias("delayed_count"),
        )
        .withColumn("delay_rate", rate(F.col("delayed_count"), F.col("shipment_count")))
        .withColumn("delivered_delay_rate", rate(F.col("delayed_count"), F.col("delivered_count")))
    )


def risk_delay_correlation(metrics: DataFrame, decimals: int = 6) -> DataFrame:
    """Correlation between the highest delay probability and a late delivery, delivered shipments only."""
    delivered = metrics.filter(F.col("delivered_time").isNotNull())
    late = F.col("is_delayed").cast("int")
    return delivered.agg(
        F.count("*").alias("delivered_count"),
        F.round(F.corr("max_delay_probability", late), decimals).alias("probability_delay_correlation"),
    )


def kpi_hourly(events: DataFrame) -> DataFrame:
    """Events and delays by hour of the day."""
    return (
        events.groupBy("event_hour")
        .agg(F.count("*").alias("event_count"), F.count_if("is_event_delayed").alias("delayed_event_count"))
        .withColumn("delay_rate", rate(F.col("delayed_event_count"), F.col("event_count")))
    )
