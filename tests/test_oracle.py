"""Every registered query against its SQL, on the smallest driver tables."""

from __future__ import annotations

import pytest
from compare import database, differences, plan_of
from conftest import SMALL

import __spark_entry__
from staffcast_checks.catalog import QUERIES
from staffcast_checks.oracle import ORACLE


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = plan_of(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan
    assert differences(df, con, ORACLE[name]) is None


def test_entry_has_rows_and_report_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:4] == ["scenario_id", "Div", "Type", "Title"]
    assert df.count() > 0
