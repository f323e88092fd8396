import pytest

import __spark_entry__
from emberlens.queries import ORACLE, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), ORACLE[name])


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["_window_start", "event_type", "count", "avg(value)", "p99(value)"]
    assert found.count() > 0


def test_scans_read_only_what_a_query_needs(spark, sf):
    plan = QUERIES["filter_num_ge"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "PushedFilters" in plan
