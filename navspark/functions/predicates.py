"""Predicates and derived columns of positions, orders and valued rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.schemas import TERMINAL_STATUSES, WORKING_STATUSES


def _zero(like: Column) -> Column:
    return F.coalesce(like, F.lit(0))


def is_holding() -> Column:
    return F.col("recordType") == "HOLDING"


def is_order() -> Column:
    return F.col("recordType") == "ORDER"


def in_accounts(accounts: Sequence[str] | None) -> Column:
    """Account selection; None means every account, an empty selection none."""
    return F.lit(True) if accounts is None else F.col("accountId").isin(list(accounts))


def of_accounts(df: DataFrame, accounts: Sequence[str] | DataFrame | None) -> DataFrame:
    """The rows of chosen accounts, given as a list, or as a table with ``accountId``."""
    if isinstance(accounts, DataFrame):
        return df.join(accounts.select("accountId").distinct(), "accountId", "left_semi")
    return df.filter(in_accounts(accounts))


def in_instruments(instruments: Sequence[str] | None) -> Column:
    """Instrument selection of an audit; here no selection means every instrument."""
    return F.col("instrumentId").isin(list(instruments)) if instruments else F.lit(True)


def has_valid_price() -> Column:
    return F.col("price") > 0


def has_price_time() -> Column:
    return F.col("priceTimestamp").isNotNull()


def has_market_values() -> Column:
    return F.col("marketValueLocal").isNotNull() & F.col("marketValueUSD").isNotNull()


def side(quantity: str = "orderQuantity") -> Column:
    return F.when(F.col(quantity) > 0, "BUY").when(F.col(quantity) < 0, "SELL")


def remaining_quantity() -> Column:
    return F.abs("orderQuantity") - F.col("filledQuantity")


def unified_remaining_quantity() -> Column:
    """Remaining quantity of a valued row; 0 for holdings and unknown quantities."""
    return _zero(F.when(is_order(), remaining_quantity()))


def completely_filled() -> Column:
    return F.col("filledQuantity") == F.abs("orderQuantity")


def is_working() -> Column:
    return F.col("orderStatus").isin(*WORKING_STATUSES)


def is_terminal(status: str = "orderStatus") -> Column:
    return F.col(status).isin(*TERMINAL_STATUSES)


def is_cash() -> Column:
    by_sector = F.lower("sector") == "cash"
    by_type = F.upper("instrumentType") == "CURRENCY"
    return F.coalesce(by_sector, F.lit(False)) | F.coalesce(by_type, F.lit(False))


def quantity_for_calculation() -> Column:
    return _zero(
        F.when(is_holding(), F.col("position")).when(is_order(), F.col("orderQuantity"))
    )


def pick_market_value(currency: str, value_type: str = "ORDER") -> Column:
    """One of the four market values, by target currency and value type.

    The filled value is defined for orders only; a holding always gives its full value.
    """
    suffix = "USD" if currency.upper() == "USD" else "Local"
    full = F.col("marketValue" + suffix)
    if value_type.upper() != "FILLED":
        return full
    return F.when(is_order(), F.col("filledMarketValue" + suffix)).otherwise(full)


def has_any_nav() -> Column:
    return (
        (_zero(F.col("sodNavUSD")) != 0)
        | (_zero(F.col("currentNavUSD")) != 0)
        | (_zero(F.col("expectedNavUSD")) != 0)
    )


def total_nav() -> Column:
    return (
        _zero(F.col("sodNavUSD")) + _zero(F.col("currentNavUSD")) + _zero(F.col("expectedNavUSD"))
    )
