"""Every registered query against its SQL oracle on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
import check
from shipflow_queries import oracles
from shipflow_queries.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="test tables are not here")
ORACLES = oracles.all_sql()


@pytest.fixture(scope="module")
def oracle():
    return check.oracle_connection(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    frame = QUERIES[name](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "rangepartitioning", "Python"):
        assert unwanted not in plan
    result = check.spark_rows(frame)
    assert result[1]
    if name in ORACLES:
        assert check.difference(result, check.oracle_rows(oracle, ORACLES[name])) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 100


@pytest.mark.parametrize("name", ["shipment_dispatch", "sla_check", "pk_violations", "not_null_violations"])
def test_the_log_is_deduplicated_once_for_all_tables(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan  # done when the layer was stored
