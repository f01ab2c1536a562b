"""Every registered query against its SQL on the smallest tables; those without SQL must run."""

import pytest

from recollect.catalogue import QUERIES, SQL
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pushdown_reaches_the_scan(spark):
    plan = QUERIES["filter_range_numeric"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_chars,500)" in plan and "text" not in plan.split("ReadSchema")[-1]
