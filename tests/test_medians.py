import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from shipflow.operators import medians as M
from shipflow.operators.medians import medians


def median_of(spark, values):
    return medians(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).first().x


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [3.0, 1.0, 2.0],
        [1.0, 1.0, 1.0, 9.0],
        [-5.0, -1.0, 0.0, 2.0],
        [-1e300, 1e300, 1e-300, -1e-300, 0.0],
        [0.1, 0.1 + 1e-17, 0.10000000000000002, 0.1],
        [5e-324, 1.0, 2.0],
        [float("inf"), 1.0, 2.0],
        [float("-inf"), float("inf"), 7.0, 8.0],
        [100.0, 100.01, 100.02, 100.03, 100.04, 100.05],
    ],
)
def test_known_lists(spark, values):
    assert median_of(spark, values) == statistics.median(values)


def test_nulls_nan_and_several_columns(spark):
    rows = [(1.0, None), (float("nan"), None), (None, None), (4.0, None)]
    row = medians(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).first()
    assert row.x == 2.5 and row.y is None


def test_one_value_held_by_most_rows(spark):
    values = [250.0] * 700 + [random.Random(1).uniform(0, 1000) for _ in range(300)]
    assert median_of(spark, values) == statistics.median(values)


def test_close_values_of_both_signs(spark):
    draw = random.Random(3)
    values = [draw.gauss(0, 1) * 10 ** draw.randint(-3, 3) for _ in range(2001)]
    assert median_of(spark, values) == statistics.median(values)


def test_neighbouring_doubles_of_a_step(spark):
    values = [1.0 + i * 2.0**-52 for i in range(20_000)] + [1.0 + 2.0**-9]
    assert median_of(spark, values) == statistics.median(values)


def test_no_window_sees_all_buckets(spark, monkeypatch):
    """Values over all magnitudes, and many in one bucket: the rows that meet in a window stay few."""
    draw = random.Random(11)
    values = [math.ldexp(draw.uniform(1, 2), draw.randint(-1000, 1000)) for _ in range(20_000)]
    values += [draw.uniform(1, 1.002) for _ in range(40_001)]
    seen, plain = [], M._holding_middle

    def watched(rows, keys, place):
        seen.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return plain(rows, keys, place)

    monkeypatch.setattr(M, "_holding_middle", watched)
    assert median_of(spark, values) == statistics.median(values)
    assert len(seen) == 6 and max(seen) <= 8192


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=30))
def test_any_list(spark, values):
    low, high = sorted(values)[(len(values) - 1) // 2], sorted(values)[len(values) // 2]
    got = median_of(spark, values)
    want = (low + high) / 2
    assert got == want or (math.isinf(want) and math.isinf(got))
