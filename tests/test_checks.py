"""Every registered query with SQL gives the same rows in DuckDB."""

import re

import pandas as pd
import pytest

from oracle import connect, differences
from wattframe.plans.checks import CHECKS
from wattframe.plans.registry import QUERIES

@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_query_is_checked():
    assert set(CHECKS) == set(QUERIES)


def test_differences_sees_a_changed_value():
    rows = pd.DataFrame({"a": [1, 2], "b": [0.5, 0.25]})
    assert differences(rows, rows[["b", "a"]].iloc[::-1]) == ""
    assert differences(rows, rows.assign(b=[0.5, 0.26])) != ""
    assert differences(rows, rows.iloc[:1]) != ""


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)
    rows = df.toPandas()
    expected = duck.execute(CHECKS[name]).df()
    assert differences(rows, expected) == ""


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
