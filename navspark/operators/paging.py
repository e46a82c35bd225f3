"""Sorting, column filters and pages of a view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page sizes a grid offers.
PAGE_SIZES = (25, 50, 100, 200)


def column_filter(name: str, kind: str, operation: str, value: object) -> Column:
    """A grid filter on one column: text, number or date.

    Text: contains, equals, startsWith, endsWith, without case. Number and date: equals,
    lessThan, greaterThan, or inRange with a pair of bounds, both included.
    """
    column = F.col(name)
    if kind == "text":
        text, wanted = F.lower(column.cast("string")), str(value).lower()
        tests = {
            "contains": text.contains(wanted),
            "equals": text == wanted,
            "startsWith": text.startswith(wanted),
            "endsWith": text.endswith(wanted),
        }
        return tests[operation]
    if kind == "date":
        column = F.to_date(column)
    if operation == "inRange":
        low, high = value
        return column.between(F.lit(low), F.lit(high))
    bound = F.lit(value)
    tests = {
        "equals": column == bound,
        "lessThan": column < bound,
        "greaterThan": column > bound,
    }
    return tests[operation]


def sorted_rows(df: DataFrame, by: Sequence[tuple[str, bool]], tie_breaker: str) -> DataFrame:
    """Order by (column, ascending) pairs; the tie-breaker makes the order total."""
    order = [
        F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()
        for name, ascending in by
    ]
    return df.orderBy(*order, F.col(tie_breaker).asc_nulls_last())


def page(
    df: DataFrame,
    by: Sequence[tuple[str, bool]],
    tie_breaker: str,
    number: int = 0,
    size: int = 50,
) -> DataFrame:
    """Page ``number`` (from 0). Only offset + size rows of each task are kept on the way."""
    return sorted_rows(df, by, tie_breaker).offset(number * size).limit(size)


def page_after(df: DataFrame, key: str, after: str | None, size: int = 50) -> DataFrame:
    """The page behind a key, for deep paging: its cost does not grow with the depth."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def _order(by: Sequence[tuple[str, bool]], tie_breaker: str) -> list[tuple[str, bool]]:
    return [*by, (tie_breaker, True)]


def end_key(
    page_rows: DataFrame, by: Sequence[tuple[str, bool]], tie_breaker: str
) -> dict[str, Column]:
    """Where a page ends: the sort values of its last row, each as a scalar of the plan."""
    backwards = [
        F.col(name).desc_nulls_first() if ascending else F.col(name).asc_nulls_first()
        for name, ascending in _order(by, tie_breaker)
    ]
    last = page_rows.orderBy(*backwards).limit(1)
    return {name: last.select(name).scalar() for name, _ in _order(by, tie_breaker)}


def behind(
    by: Sequence[tuple[str, bool]], tie_breaker: str, end: Mapping[str, object]
) -> Column:
    """Rows behind an end key in the order of ``sorted_rows``, whose nulls come last.

    ``end`` has a value (a constant or a column) for each sort column and the tie-breaker.
    """
    found, equal = F.lit(False), F.lit(True)
    for name, ascending in _order(by, tie_breaker):
        column, value = F.col(name), end[name]
        value = value if isinstance(value, Column) else F.lit(value)
        later = (column > value) if ascending else (column < value)
        later = F.coalesce(later, column.isNull() & value.isNotNull())
        found = found | (equal & later)
        equal = equal & column.eqNullSafe(value)
    return found


def seek(
    df: DataFrame,
    by: Sequence[tuple[str, bool]],
    tie_breaker: str,
    end: Mapping[str, object] | None = None,
    size: int = 50,
) -> DataFrame:
    """The page behind an end key, in any order; without one the first.

    However deep the page lies, each task keeps ``size`` rows and no row is skipped by counting.
    """
    rows = df if end is None else df.filter(behind(by, tie_breaker, end))
    return sorted_rows(rows, by, tie_breaker).limit(size)
