"""Positions, quotes and their valuation at the latest state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.functions.predicates import of_accounts
from navspark.functions.valuation import value_positions
from navspark.operators import skew
from navspark.operators.latest import ARRIVAL, latest
from navspark.schemas import QUANTITY, columns_of

UNIFIED_COLUMNS = [name for name in columns_of("unified") if name != "calculationTimestamp"]
INSTRUMENT_COLUMNS = [
    "instrumentName", "instrumentType", "currency", "countryOfRisk", "countryOfDomicile",
    "sector", "subSectors",
]
HOLDING_COLUMNS = ["instrumentId", "accountId", "timestamp", "holdingId", "date", "position"]
ORDER_COLUMNS = [
    "instrumentId", "accountId", "timestamp", "orderId", "orderQuantity", "filledQuantity",
    "orderStatus", "orderPrice", "orderType", "venue",
]


def union_feeds(**feeds: DataFrame) -> DataFrame:
    """One table of several feeds, tagged with ``feed``; columns a feed lacks are null."""
    tagged = [df.withColumn("feed", F.lit(name)) for name, df in feeds.items()]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def positions(holdings: DataFrame, orders: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Holdings and orders in one wide table.

    Rows that cannot be valued (no position, no order quantity or status) give no result.
    """
    held = holdings.filter(F.col("position").isNotNull()).select(
        F.lit("HOLDING").alias("recordType"), *HOLDING_COLUMNS, *extra
    )
    return held.unionByName(order_positions(orders, extra), allowMissingColumns=True)


def order_positions(orders: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return orders.filter(
        F.col("orderQuantity").isNotNull() & F.col("orderStatus").isNotNull()
    ).select(F.lit("ORDER").alias("recordType"), *ORDER_COLUMNS, *extra)


def price_columns(prices: DataFrame, *extra: str) -> DataFrame:
    """The price side of a valued row. Its price time is the price's own date."""
    return prices.select(
        "instrumentId",
        "price",
        F.col("currency").alias("priceCurrency"),
        F.col("source").alias("priceSource"),
        F.col("date").alias("priceTimestamp"),
        *extra,
    )


def quotes(instruments: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per instrument that has both static data and a price: the latest of each."""
    static = latest(instruments, "instrument").select("instrumentId", *INSTRUMENT_COLUMNS)
    return static.join(price_columns(latest(prices, "price")), "instrumentId")


def _known_at_last_tick(log: DataFrame, last_tick: DataFrame) -> DataFrame:
    arrived = F.col("timestamp") <= F.col("_lastTick")
    return log.join(last_tick, "instrumentId").filter(arrived).drop("_lastTick")


def snapshot(
    holdings: DataFrame,
    orders: DataFrame,
    instruments: DataFrame,
    prices: DataFrame,
    accounts: Sequence[str] | DataFrame | None = None,
    mode: str = "raw",
    signed_fills: bool = False,
    as_of_last_tick: bool = False,
    order: Sequence[str] = ARRIVAL,
) -> DataFrame:
    """Latest holdings and orders valued with the latest instrument and price.

    Each feed may be a whole log or an already reduced table. Accounts are filtered before
    anything else. With ``as_of_last_tick`` only what had arrived by an instrument's last tick
    counts, as in a stream that re-values on ticks alone.
    """
    holdings, orders = of_accounts(holdings, accounts), of_accounts(orders, accounts)
    if as_of_last_tick:
        last_tick = prices.groupBy("instrumentId").agg(F.max("timestamp").alias("_lastTick"))
        holdings = _known_at_last_tick(holdings, last_tick)
        orders = _known_at_last_tick(orders, last_tick)
        instruments = _known_at_last_tick(instruments, last_tick)
    current = positions(latest(holdings, "holding", order), latest(orders, "order", order))
    valued = value_positions(
        current.join(quotes(instruments, prices), "instrumentId"), mode, signed_fills
    )
    return valued.select(*UNIFIED_COLUMNS)


def with_calculation_time(valued: DataFrame) -> DataFrame:
    return valued.withColumn("calculationTimestamp", F.localtimestamp())


def enriched_holdings(holdings: DataFrame, instruments: DataFrame) -> DataFrame:
    """Holdings with the static data of their instrument."""
    static = latest(instruments, "instrument").select("instrumentId", *INSTRUMENT_COLUMNS)
    return latest(holdings, "holding").join(static, "instrumentId")


def order_market_values(
    orders: DataFrame, instruments: DataFrame, prices: DataFrame, mode: str = "raw"
) -> DataFrame:
    """Current orders with their order and filled market values."""
    current = order_positions(latest(orders, "order")).withColumns(
        {
            "holdingId": F.lit(None).cast("string"),
            "date": F.lit(None).cast("date"),
            "position": F.lit(None).cast(QUANTITY),
        }
    )
    valued = value_positions(current.join(quotes(instruments, prices), "instrumentId"), mode)
    return valued.select(*UNIFIED_COLUMNS)


def holdings_priced_in_window(
    holdings: DataFrame,
    prices: DataFrame,
    width: str = "1 minute",
    left_rows: int = 200_000,
    right_rows: int = 200_000,
) -> DataFrame:
    """Enriched holdings joined to the prices of the same tumbling window."""
    held = holdings.withColumn("windowStart", F.window("timestamp", width).start)
    priced = price_columns(prices, "sequence").withColumn(
        "windowStart", F.window("priceTimestamp", width).start
    ).withColumnRenamed("sequence", "priceSequence")
    joined = skew.spread_join(
        held, priced, ["instrumentId", "windowStart"], ["holdingId"], ["priceSequence"],
        left_rows=left_rows, right_rows=right_rows,
    )
    return value_positions(
        joined.withColumn("recordType", F.lit("HOLDING"))
        .withColumn("orderQuantity", F.lit(None).cast(QUANTITY))
        .withColumn("filledQuantity", F.lit(None).cast(QUANTITY))
    ).drop("orderQuantity", "filledQuantity", "filledMarketValueLocal", "filledMarketValueUSD")


def lazy_account_view(
    holdings: DataFrame,
    orders: DataFrame,
    instruments: DataFrame,
    prices: DataFrame,
    accounts: Sequence[str] | DataFrame | None,
    group_columns: Sequence[str],
) -> DataFrame:
    """Filter accounts first, then join, value and group; None takes all rows given."""
    valued = snapshot(holdings, orders, instruments, prices, accounts)
    return valued.groupBy(*group_columns).agg(
        F.sum("marketValueUSD").alias("marketValueUSD"), F.count("*").alias("recordCount")
    )


def revalue_changed(
    current: DataFrame, quotes_now: DataFrame, ticked: DataFrame, mode: str = "raw"
) -> DataFrame:
    """Re-value only the positions of instruments that ticked."""
    touched = current.join(ticked.select("instrumentId").distinct(), "instrumentId", "left_semi")
    return value_positions(touched.join(quotes_now, "instrumentId"), mode).select(
        *UNIFIED_COLUMNS
    )


