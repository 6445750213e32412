"""Every named query against its SQL on the smallest tables."""

import harness
import pytest

import __spark_entry__ as contract
from profilum.plans.oracle import ORACLES
from profilum.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return harness.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, connection, name):
    frame = contract.queries()[name](spark, FOLDER)
    assert harness.compare(frame, connection, ORACLES[name]) is None
    # No query pairs all rows with all rows or runs Python row by row.
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if bad in plan]


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() == 3
