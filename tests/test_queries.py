"""Every query of the engine against its SQL, and the driver contract."""

from __future__ import annotations

import pytest
from oracle import assert_same

import __spark_entry__ as entry
from spanlock.plans import queries as engine


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, engine.QUERIES[name], engine.ORACLE_SQL[name])


def test_entry_gives_rows(spark):
    rows = entry.entry(spark).collect()
    assert {r["task"] for r in rows} >= {"__overall__", "__macro__"}


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
