"""Flags and labels of an event. Unknown is never true: nulls give false."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shipflow import constants as C


def status_flags(status: str = "event_status") -> dict[str, Column]:
    """is_created ... is_delivered."""
    return {
        f"is_{name.lower()}": F.coalesce(F.col(status) == name, F.lit(False)) for name in C.STATUSES
    }


def is_event_delayed() -> Column:
    signs = (
        (F.col("delay_probability") >= C.DELAYED_FROM_PROBABILITY)
        | (F.col("eta_variation_minutes") >= C.DELAYED_FROM_ETA_MINUTES)
        | F.col("exception_type").isNotNull()
    )
    return F.coalesce(signs, F.lit(False))


def risk_band(probability: Column, bands: tuple[float, float] = C.EVENT_RISK_BANDS) -> Column:
    medium_from, high_from = bands
    return (
        F.when(probability >= high_from, "HIGH")
        .when(probability >= medium_from, "MEDIUM")
        .when(probability.isNotNull(), "LOW")
    )


def normalize_risk(label: Column, probability: Column) -> Column:
    """Free-text label to LOW / MEDIUM / HIGH, else by the probability."""
    text = F.upper(label)
    return (
        F.when(text.contains("HIGH"), "HIGH")
        .when(text.contains("MED"), "MEDIUM")
        .when(text.contains("LOW"), "LOW")
        .otherwise(risk_band(probability, C.REFERENCE_RISK_BANDS))
    )


def risk_severity(label: Column) -> Column:
    severity = F.lit(None).cast("int")
    for name, rank in C.RISK_SEVERITY.items():
        severity = F.when(label == name, rank).otherwise(severity)
    return severity
