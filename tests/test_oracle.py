"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from navspark.plans.registry import QUERIES

SQL = {name: query.sql for name, query in QUERIES.items()}


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((x is not None, str(x)) for x in row))


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, data, duck):
    result = QUERIES[name](spark, data)
    cursor = duck.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(names)
    expected = cursor.fetchall()
    place = [result.columns.index(column) for column in names]
    found = [tuple(row[i] for i in place) for row in result.collect()]
    assert expected, "the query shows nothing on these tables"
    assert _sorted(found) == _sorted(expected)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
