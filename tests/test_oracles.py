"""Every registered query against its SQL, on the smallest tables."""

import pytest

import check_oracles
from conftest import SMALL
from lodestar import workload

REGISTRY = workload.load()


@pytest.fixture(scope="module")
def con():
    return check_oracles.duck(SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    entry = REGISTRY[name]
    frame = entry.run(spark, SMALL)
    plan = frame._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if entry.sql:
        assert check_oracles.compare(frame, con, entry.sql) is None
    else:
        assert frame.count() > 0
