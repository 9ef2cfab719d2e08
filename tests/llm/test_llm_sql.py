"""Queries with SQL against it, on the smallest driver tables."""

from __future__ import annotations

import pytest
from compare import database, differences
from conftest import SMALL

from staffcast.llm.oracle import ORACLE
from staffcast.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), database(SMALL), ORACLE[name]) is None


def test_one_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
