"""Every query of the tool corpus against its SQL."""

from __future__ import annotations

import pytest

from tallyforge.plans.catalog import QUERIES, SQL

from .comparing import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), tables.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_file(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
