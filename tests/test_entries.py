"""Every registered query against its SQL on the whole tables."""

import compare
import pytest

import __spark_entry__ as contract
from tidemark.queries import ORACLES, QUERIES




@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "InPandas", "PythonUDF", "CartesianProduct", "NestedLoopJoin"):
        assert node not in plan
    assert compare.difference(con, ORACLES[name], df) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 1
