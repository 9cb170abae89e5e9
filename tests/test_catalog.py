"""Every registered query against its SQL in DuckDB; the others give rows with a stable schema."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lodeworks.registry import ORACLE_SQL, QUERIES

from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and rows[0].asDict().keys() == set(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
