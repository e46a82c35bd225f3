"""Price-triggered valuation over a whole history.

A tick values every holding and order of its instrument as they were known at the tick, with
the instrument data known at the tick. A position that arrives later waits for the next tick;
a tick before its instrument is known gives nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.functions.valuation import value_positions
from navspark.operators import skew
from navspark.operators.latest import latest_by_key, latest_unified
from navspark.operators.positions import (
    HOLDING_COLUMNS,
    INSTRUMENT_COLUMNS,
    ORDER_COLUMNS,
    UNIFIED_COLUMNS,
    price_columns,
)


def _within(tick: str, valid_from: str, valid_to: str) -> Column:
    """Known at the tick and not yet replaced; an arrival at the tick's own time is known."""
    moment, end = F.col(tick), F.col(valid_to)
    return (F.col(valid_from) <= moment) & (end.isNull() | (moment < end))


def known_ticks(
    prices: DataFrame, instruments: DataFrame, arrival: str = "timestamp"
) -> DataFrame:
    """Ticks with the instrument data known at their time, and since when; others are dropped.

    The interval of each instrument version is a lookup by time: the ticks and the versions of an
    instrument are put in one order, and each tick takes the last version before it.
    """
    static = latest_by_key(instruments, ["instrumentId", arrival], ["sequence"]).select(
        "instrumentId", F.col(arrival).alias("knownSince"), *INSTRUMENT_COLUMNS
    )
    ticks = price_columns(
        prices, F.col(arrival).alias("tickTime"), F.col("sequence").alias("tickSequence")
    )
    return skew.as_of(
        ticks, static, ["instrumentId"], "tickTime", "knownSince",
        ["knownSince", *INSTRUMENT_COLUMNS],
    )


BY_INSTRUMENT, BY_KEY = 0, 1


def position_loads(
    holdings: DataFrame, orders: DataFrame, ticks: DataFrame | None = None
) -> DataFrame:
    """Position versions by instrument, and by the key of a holding or an order, in one pass.

    With ``ticks``, a filter of instruments, the pass also notes the orders with a version of one.
    """
    kind = F.lit("HOLDING").alias("recordType")
    held = holdings.select("instrumentId", kind, F.col("instrumentId").alias("_k1"), F.col("accountId").alias("_k2"))
    kind = F.lit("ORDER").alias("recordType")
    ordered = orders.select("instrumentId", kind, F.col("orderId").alias("_k1"), F.lit("").alias("_k2"))
    levels = ["instrumentId"], ["recordType", "_k1", "_k2"]
    if ticks is None:
        return skew.loads(held.unionByName(ordered), *levels)
    ordered = ordered.withColumn("_ticks", skew.possible(["instrumentId"], ticks))
    every = held.withColumn("_ticks", F.lit(False)).unionByName(ordered)
    return skew.loads(every, *levels, flagged=F.col("_ticks"), by=["_k1"])


def ticked_positions(
    holdings: DataFrame, orders: DataFrame, prices: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Holdings and orders that some tick can value, and their loads.

    Positions of instruments without any tick give no row, so they are left out before the first
    exchange. An order can move to another instrument, and a version there ends the one before: if
    one version of an order stays, all do. Both filters have a fixed size and let some rows through
    that later joins drop.
    """
    ticks = skew.seen(prices, ["instrumentId"])
    holdings = holdings.filter(skew.possible(["instrumentId"], ticks))
    load = position_loads(holdings, orders, ticks)
    kept = skew.possible(["orderId"], skew.noted(load, 2), skew.FILTER_BITS)
    return holdings, orders.filter(kept), load


def position_versions(
    holdings: DataFrame,
    orders: DataFrame,
    tie_breakers: Sequence[str] = ("sequence",),
    arrival: str = "timestamp",
    load: DataFrame | None = None,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Every version of every holding and order with its interval of validity.

    Both feeds go through one window. A version that cannot be valued ends the one before it.
    """
    extra = list(dict.fromkeys([arrival, *tie_breakers]))
    if load is None:
        load = position_loads(holdings, orders)
    held = holdings.select(
        F.lit("HOLDING").alias("recordType"), *HOLDING_COLUMNS,
        *[c for c in extra if c not in HOLDING_COLUMNS],
        F.col("instrumentId").alias("_k1"), F.col("accountId").alias("_k2"),
    )
    ordered = orders.select(
        F.lit("ORDER").alias("recordType"), *ORDER_COLUMNS,
        *[c for c in extra if c not in ORDER_COLUMNS],
        F.col("orderId").alias("_k1"), F.lit("").alias("_k2"),
    )
    every = held.unionByName(ordered, allowMissingColumns=True)
    following = skew.neighbour(
        every, ["recordType", "_k1", "_k2"], [arrival, *tie_breakers], [arrival], "_next", True,
        rows_per_task=rows_per_task, heavy=skew.heavy_of(load, BY_KEY, rows_per_task),
    )
    valued = F.when(F.col("recordType") == "HOLDING", F.col("position").isNotNull()).otherwise(
        F.col("orderQuantity").isNotNull() & F.col("orderStatus").isNotNull()
    )
    live = following.filter(valued)
    kept = [c for c in every.columns if c not in {"_k1", "_k2", *extra} or c == "timestamp"]
    return live.select(
        *kept, F.col(arrival).alias("validFrom"), F.col(f"_next.{arrival}").alias("validTo")
    )


def replay(
    holdings: DataFrame,
    orders: DataFrame,
    instruments: DataFrame,
    prices: DataFrame,
    mode: str = "raw",
    tie_breakers: Sequence[str] = ("sequence",),
    position_rows: int = 50_000,
    tick_rows: int = 2_000,
    arrival: str = "timestamp",
) -> DataFrame:
    """The event log of valued rows: one per tick and live position.

    The result is as large as the sum over ticks of the live positions. The work of a busy
    instrument is laid out as a grid of position shares and tick shares. ``arrival`` names the
    time at which a row became known.
    """
    holdings, orders, load = ticked_positions(holdings, orders, prices)
    live = position_versions(holdings, orders, tie_breakers, arrival, load)
    ticks = known_ticks(prices, instruments, arrival)
    joined = skew.spread_join(
        live, ticks, ["instrumentId"], ["accountId", "orderId", "validFrom"], ["tickSequence"],
        _within("r.tickTime", "l.validFrom", "l.validTo"),
        heavy_left=skew.heavy_of(load, BY_INSTRUMENT, position_rows),
        heavy_right=skew.heavy_keys(prices, ["instrumentId"], tick_rows),
    )
    return value_positions(joined, mode).select(*UNIFIED_COLUMNS, "tickTime", "tickSequence")


def latest_valued(
    holdings: DataFrame,
    orders: DataFrame,
    instruments: DataFrame,
    prices: DataFrame,
    mode: str = "raw",
    tie_breakers: Sequence[str] = ("sequence",),
) -> DataFrame:
    """The last valued row per unified key of the replayed log, without building the log.

    A version was valued last by the last tick before it was replaced; one lookup by time finds
    that tick, so the work is linear in positions and ticks. Versions that still hold ask for the
    instrument's last tick, one row per instrument, and are spread however many there are.
    """
    holdings, orders, load = ticked_positions(holdings, orders, prices)
    live = position_versions(holdings, orders, tie_breakers, load=load)
    ticks = latest_by_key(
        known_ticks(prices, instruments), ["instrumentId", "tickTime"], ["tickSequence"]
    )
    priced = skew.as_of(
        live, ticks, ["instrumentId"], "validTo", "tickTime",
        [name for name in ticks.columns if name != "instrumentId"], inclusive=False,
        spread=skew.heavy_of(load, BY_INSTRUMENT),
    ).filter(F.col("tickTime") >= F.col("validFrom"))
    valued = value_positions(priced, mode).select(*UNIFIED_COLUMNS, "tickTime", "tickSequence")
    return latest_unified(valued, ("tickTime", "tickSequence"))
