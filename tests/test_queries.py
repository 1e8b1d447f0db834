"""Every registered query against its SQL twin on the smallest tables, without cross joins."""

import check
import pytest

import __spark_entry__ as entry_module

SF = "0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, con, name):
    out = entry_module.queries()[name](spark, f"{check.ROOT}/sf{SF}")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert check.compare_rows(out, con, entry_module.oracle_sql().get(name)) is None


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.columns[:3] == ["session_id", "src", "dst"] and out.count() > 0
