"""Means merged from partial sums."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged_mean(total: str, count: str) -> Column:
    """Mean over groups that carry a sum and a count; null where nothing was counted."""
    return F.try_divide(F.sum(total), F.sum(count))
