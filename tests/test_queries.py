"""Every named query against its SQL on the smallest data, and what all plans must not contain."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools.check_queries import compare, connect  # noqa: E402

from forescale.plans.queries import QUERIES  # noqa: E402
from oracles.all import ORACLES  # noqa: E402

NAMES = sorted(QUERIES)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Scan ExistingRDD")


@pytest.fixture
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, folder, name):
    df = entry.queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    line = compare(spark, connection, folder, name, df)
    assert line.startswith("OK"), line


def test_every_query_has_sql():
    assert set(ORACLES) == set(NAMES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
