"""Daily marts. They count events, keyed by event date and destination."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipflow.functions.means import merged_mean
from shipflow.functions.numbers import rate

MEASURES = (
    "delay_probability",
    "eta_variation_minutes",
    "traffic_congestion_level",
    "weather_severity",
    "hub_congestion_level",
)

# mart -> key next to event_date, averaged measures in column order
MARTS = {
    "mart_region_delay": ("destination_region_id", ("delay_probability", "eta_variation_minutes")),
    "mart_hub_performance": (
        "destination_hub_id",
        ("traffic_congestion_level", "hub_congestion_level", "delay_probability"),
    ),
    "mart_risk_summary": (
        "risk_classification",
        ("delay_probability", "weather_severity", "traffic_congestion_level"),
    ),
}


def _delayed() -> Column:
    return F.count_if("is_event_delayed")


def _high_risk() -> Column:
    return F.count_if(F.col("risk_classification") == "HIGH")


def _shape(mart: str, grouped: DataFrame) -> DataFrame:
    """Columns of a mart in order, from event_count, delayed_count, high_risk_count and averages."""
    key, measures = MARTS[mart]
    averages = [f"avg_{name}" for name in measures]
    if mart == "mart_risk_summary":
        columns = ["event_count", *averages]
    else:
        columns = [
            F.col("event_count").alias("total_event_count"),
            F.col("delayed_count").alias("delayed_event_count"),
            rate(F.col("delayed_count"), F.col("event_count")).alias("delay_rate"),
            *averages,
        ]
    if mart == "mart_region_delay":
        columns.append("high_risk_count")
    return grouped.select("event_date", key, *columns, F.current_timestamp().alias("created_at"))


def build_mart(mart: str, events: DataFrame) -> DataFrame:
    """One mart from the processed events."""
    key, measures = MARTS[mart]
    grouped = events.groupBy("event_date", key).agg(
        F.count("*").alias("event_count"),
        _delayed().alias("delayed_count"),
        _high_risk().alias("high_risk_count"),
        *[F.avg(name).alias(f"avg_{name}") for name in measures],
    )
    return _shape(mart, grouped)


def mart_region_delay(events: DataFrame) -> DataFrame:
    return build_mart("mart_region_delay", events)


def mart_hub_performance(events: DataFrame) -> DataFrame:
    return build_mart("mart_hub_performance", events)


def mart_risk_summary(events: DataFrame) -> DataFrame:
    return build_mart("mart_risk_summary", events)


def mart_base(events: DataFrame) -> DataFrame:
    """Partial sums per (date, region, hub, risk), from which every mart follows.

    One scan of the events feeds all marts, and the grouping sets below expand these few rows
    instead of the events.
    """
    return events.groupBy(
        "event_date", "destination_region_id", "destination_hub_id", "risk_classification"
    ).agg(
        F.count("*").alias("event_count"),
        _delayed().alias("delayed_count"),
        _high_risk().alias("high_risk_count"),
        *[F.sum(name).alias(f"total_{name}") for name in MEASURES],
        *[F.count(name).alias(f"count_{name}") for name in MEASURES],
    )


def mart_grouping_sets(base: DataFrame) -> DataFrame:
    """All marts in long form: mart, event_date, the three keys and every measure."""
    keys = [key for key, _ in MARTS.values()]
    sets = [[F.col("event_date"), F.col(key)] for key in keys]
    # A grouping id has one bit per key, set where the key is aggregated away.
    mart_of = F.create_map(
        F.lit(0b011), F.lit("mart_region_delay"),
        F.lit(0b101), F.lit("mart_hub_performance"),
        F.lit(0b110), F.lit("mart_risk_summary"),
    )
    grouped = base.groupingSets(sets, "event_date", *keys).agg(
        F.grouping_id().alias("_grouping"),
        F.sum("event_count").alias("event_count"),
        F.sum("delayed_count").alias("delayed_count"),
        F.sum("high_risk_count").alias("high_risk_count"),
        *[merged_mean(f"total_{name}", f"count_{name}").alias(f"avg_{name}") for name in MEASURES],
    )
    return grouped.select(
        F.element_at(mart_of, F.col("_grouping").cast("int")).alias("mart"),
        "event_date",
        *keys,
        "event_count",
        "delayed_count",
        "high_risk_count",
        *[f"avg_{name}" for name in MEASURES],
    )


def split_marts(long_form: DataFrame) -> dict[str, DataFrame]:
    """The marts in their own column order."""
    return {mart: _shape(mart, long_form.filter(F.col("mart") == mart)) for mart in MARTS}
