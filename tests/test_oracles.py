"""Every registered query with SQL gives what DuckDB gives: names, types, rows and values."""

import pytest
from check_oracles import check

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    issues, _, _ = check(spark, duck, name, entry.queries()[name], SQL[name], sf)
    assert not issues, issues


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship_has_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["label", "precision", "recall", "f1", "support"]
    assert out.count() >= 4
