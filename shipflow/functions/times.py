"""Timestamp column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_time(text: Column) -> Column:
    """ISO text to timestamp; null where it does not parse, also under ANSI mode."""
    return F.try_to_timestamp(text)


def iso_text(time: Column) -> Column:
    """Timestamp to ISO text without zone."""
    return F.translate(time.cast("string"), " ", "T")


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end on whole seconds; null if either is null."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60


def plus_days(time: Column, days: Column) -> Column:
    """Add a fractional number of days."""
    return F.timestamp_micros(F.unix_micros(time) + F.round(days * 86_400_000_000.0).cast("long"))
