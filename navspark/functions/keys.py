"""Composite keys: parts joined by ``#``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "#"


def _text(part: Column) -> Column:
    """A part as text; a missing part prints as ``null`` instead of vanishing."""
    return F.coalesce(part.cast("string"), F.lit("null"))


def join_key(parts: Iterable[Column]) -> Column:
    return F.concat_ws(SEPARATOR, *[_text(part) for part in parts])


def _day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def account_key() -> Column:
    return F.col("accountId")


def instrument_key() -> Column:
    return F.col("instrumentId")


def order_key() -> Column:
    return F.col("orderId")


def holding_key() -> Column:
    return join_key([_day(F.col("date")), F.col("instrumentId"), F.col("accountId")])


def price_key() -> Column:
    return join_key([F.col("instrumentId"), _day(F.col("date"))])


def cash_key() -> Column:
    return join_key([_day(F.col("date")), F.col("instrumentId"), F.col("accountId")])


def unified_key() -> Column:
    """Key of a valued row; its prefix tells the kind of position."""
    kind = F.col("recordType")
    return (
        F.when(kind == "HOLDING", F.concat(F.lit("HOLDING" + SEPARATOR), holding_key()))
        .when(kind == "ORDER", F.concat(F.lit("ORDER" + SEPARATOR), _text(F.col("orderId"))))
        .otherwise(
            F.concat(
                F.lit("UNKNOWN" + SEPARATOR),
                join_key([F.col("instrumentId"), F.col("accountId")]),
            )
        )
    )


def split_key(key: Column) -> Column:
    return F.split(key, SEPARATOR)


KEYS = {
    "account": account_key,
    "instrument": instrument_key,
    "price": price_key,
    "holding": holding_key,
    "order": order_key,
    "cash": cash_key,
    "unified": unified_key,
}
