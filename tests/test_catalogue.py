"""Every query of the evaluation engine on the smallest tables, against its SQL where there is one."""

import os

import pytest

from tarsus.plans import catalogue, files

from .oracle import SMALL, same, views

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
QUERIES, SQL = catalogue.QUERIES | files.QUERIES, catalogue.ORACLE_SQL | files.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    return views(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_query_plan_has_a_cartesian_product(spark):
    for name in ("paired_hds", "token_coverage_turns", "cosine_pairs", "todo_plan", "audit_allocation", "threshold_sweep", "roc_auc"):
        plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
