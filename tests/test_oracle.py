"""Every registered query equals its SQL twin, without cross joins or Python workers."""

import pytest

from smeltry.catalog import all_queries, all_sql
from tests.compare import differences, duck

UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, sf, con, name):
    df = all_queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in UNWANTED:
        assert node not in plan
    assert differences(df, con, all_sql()[name]) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
