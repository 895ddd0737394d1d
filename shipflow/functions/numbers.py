"""Numeric column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)$"


def to_number(text: Column) -> Column:
    """Text to double; anything else, NaN included, becomes null.

    The pattern keeps out Java spellings such as ``1.5f`` or ``0x1p3`` that a cast would take.
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def number_or(text: Column, default: float) -> Column:
    """Text to double, ``default`` for null or non-numeric text; NaN passes."""
    is_nan = F.lower(F.trim(text)).isin("nan", "+nan", "-nan")
    return F.coalesce(F.when(is_nan, F.lit(float("nan"))).otherwise(to_number(text)), F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null (least and greatest alone would skip it)."""
    limited = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), limited)


def round_even(value: Column, decimals: int) -> Column:
    """Scale, round half to even, scale back: the rounding of numpy and pandas."""
    factor = float(10**decimals)
    return F.rint(value * factor) / factor


def rate(part: Column, whole: Column, decimals: int = 4) -> Column:
    """``part / whole``, rounded half up; null where ``whole`` is 0."""
    return F.round(F.try_divide(part, whole), decimals)
