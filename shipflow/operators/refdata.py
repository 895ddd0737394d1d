"""Cleaning of the reference file: 15 text columns to typed, limited and imputed signals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.functions import labels, times
from shipflow.functions.numbers import clamp, number_or, round_even, to_number
from shipflow.operators.medians import approximate_medians, medians
from shipflow.operators.quality import require_columns

CONGESTION = ("traffic_congestion_level", "weather_severity", "hub_congestion_level")
IMPUTED = ("shipping_costs", "lead_time_days")
TEXT = ("dataset_timestamp", "risk_classification")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def type_reference(text: DataFrame) -> DataFrame:
    """Checked, renamed and typed columns; cells that do not parse are null."""
    require_columns(text, list(S.REFERENCE_COLUMNS))
    renamed = text.select([F.col(old).alias(new) for old, new in S.REFERENCE_COLUMNS.items()])
    numeric = [name for name in renamed.columns if name not in TEXT]
    return renamed.withColumns(
        {
            **{name: to_number(F.col(name)) for name in numeric},
            "dataset_timestamp": times.to_time(F.col("dataset_timestamp")),
        }
    )


def limit_signals(typed: DataFrame) -> DataFrame:
    """Congestion within 0-10, ETA in minutes, probability within 0-1, risk as one of three labels."""
    probability = _filled("delay_probability")
    probability = clamp(F.when(probability > 1, probability / 100).otherwise(probability), 0, 1)
    return typed.withColumns(
        {
            **{name: clamp(_filled(name), 0, 10) for name in CONGESTION},
            "eta_variation_minutes": round_even(_filled("eta_variation_hours") * 60, 2),
            "delay_probability": probability,
        }
    ).withColumn(
        "risk_classification", labels.normalize_risk(F.col("risk_classification"), F.col("delay_probability"))
    )


def impute(typed: DataFrame, rank_error: float | None = None) -> DataFrame:
    """Missing costs and lead times become the median of the column: the exact one, or one within a rank error."""
    found = medians(typed, IMPUTED) if rank_error is None else approximate_medians(typed, IMPUTED, rank_error)
    middle = found.select(F.struct(*IMPUTED)).scalar()
    return typed.withColumns({name: F.coalesce(F.col(name), middle[name]) for name in IMPUTED})


def clean_reference(typed: DataFrame, rank_error: float | None = None) -> DataFrame:
    """The cleaned file, 15 columns, from ``type_reference``.

    With ``rank_error`` the medians come from a sketch in one pass instead of three exact ones. Store the typed columns first: then the text is parsed once, and the passes for the medians read
    two columns only.
    """
    return limit_signals(impute(typed, rank_error)).select(S.REFERENCE_CLEAN.fieldNames())


def with_defaults(clean_text: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Text signals as numbers, a default where a cell is missing or not numeric; each named column must be there."""
    require_columns(clean_text, list(defaults))
    return clean_text.withColumns({name: number_or(F.col(name), value) for name, value in defaults.items()})
