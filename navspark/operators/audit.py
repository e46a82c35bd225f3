"""Counts, totals and checks over the feeds and the valued rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.functions.predicates import (
    in_accounts,
    in_instruments,
    is_cash,
    is_holding,
    is_order,
)
from navspark.operators.latest import latest
from navspark.schemas import RAW_MONEY


def page_totals(
    valued: DataFrame,
    accounts: Sequence[str] | None = None,
    instruments: Sequence[str] | None = None,
) -> DataFrame:
    """Totals over the chosen rows; an empty choice means all."""
    rows = valued.filter(in_accounts(accounts or None) & in_instruments(instruments))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast(RAW_MONEY)

    return rows.agg(
        total(F.when(is_holding(), F.col("marketValueUSD"))).alias("holdingValue"),
        total(F.when(is_order(), F.col("marketValueUSD"))).alias("orderValue"),
        total(F.when(is_order(), F.col("filledMarketValueUSD"))).alias("filledValue"),
        F.count("*").alias("recordCount"),
        F.countDistinct("instrumentType").alias("instrumentTypes"),
    )


def lookup(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose key, the one column of ``ids``, is listed there."""
    return df.join(ids.distinct(), ids.columns, "left_semi")


def dataset_counts(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, rows), one row per dataset, empty ones included."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        for name, df in datasets.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def expected_count_check(counts: DataFrame, minimum: Mapping[str, int]) -> DataFrame:
    """Pass or fail of each dataset against the fewest rows it must have."""
    expected = counts.sparkSession.createDataFrame(
        list(minimum.items()), "dataset STRING, minimum BIGINT"
    )
    rows = F.coalesce("rows", F.lit(0))
    return expected.join(counts, "dataset", "left").select(
        "dataset",
        rows.alias("rows"),
        "minimum",
        F.when(rows >= F.col("minimum"), "PASS").otherwise("FAIL").alias("result"),
    )


def record_type_counts(valued: DataFrame) -> DataFrame:
    """Rows per record type and in total."""
    kinds = valued.rollup("recordType").agg(F.count("*").alias("rows"))
    return kinds.select(F.coalesce("recordType", F.lit("ALL")).alias("recordType"), "rows")


def price_consistency(valued: DataFrame, per_tick: Sequence[str] = ()) -> DataFrame:
    """Does each instrument (of a tick, on an event log) carry one price and price time?"""
    groups = valued.groupBy("instrumentId", *per_tick).agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.col("price").isNull() | F.col("priceTimestamp").isNull(), 1))
        .alias("unpriced"),
        F.min("price").alias("lowest"),
        F.max("price").alias("highest"),
        F.min("priceTimestamp").alias("earliest"),
        F.max("priceTimestamp").alias("latestTime"),
    )
    same = (
        (F.col("unpriced") == 0)
        & (F.col("lowest") == F.col("highest"))
        & (F.col("earliest") == F.col("latestTime"))
    )
    return groups.select(
        "instrumentId", *per_tick, "rows", "unpriced",
        F.coalesce(same, F.lit(False)).alias("isConsistent"),
    )


def cash_summary(cash: DataFrame, by_movement: bool = False) -> DataFrame:
    """Net cash per account and currency, split by movement type if asked."""
    extra = ["movementType"] if by_movement else []
    return cash.groupBy("accountId", "instrumentId", *extra).agg(
        F.sum("quantity").alias("quantity"), F.count("*").alias("movements")
    )


def freshness(prices: DataFrame, orders: DataFrame) -> DataFrame:
    """Newest price and newest order event."""
    def newest(df: DataFrame, name: str, key: str) -> DataFrame:
        top = F.max(F.struct("timestamp", "sequence", key))
        return df.agg(top.alias("top")).select(
            F.lit(name).alias("dataset"),
            F.col(f"top.{key}").alias("newestKey"),
            F.col("top.timestamp").alias("newestTime"),
        )
    return newest(prices, "price", "instrumentId").unionByName(newest(orders, "order", "orderId"))


def topic_volume(log: DataFrame) -> DataFrame:
    """Messages per topic and in total."""
    counts = log.rollup("topic").agg(F.count("*").alias("messages"))
    return counts.select(F.coalesce("topic", F.lit("ALL")).alias("topic"), "messages")


def holding_coverage(holdings: DataFrame, instruments: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per account, how many of the non-cash instruments it holds and how many it lacks.

    The full grid of accounts and instruments is never built: the missing ones are a count
    minus a distinct count.
    """
    wanted = latest(instruments, "instrument").filter(~is_cash()).select("instrumentId")
    held = (
        holdings.select("accountId", "instrumentId")
        .distinct()
        .join(wanted, "instrumentId", "left_semi")
        .groupBy("accountId")
        .agg(F.count("*").alias("held"))
    )
    held_count = F.coalesce("held", F.lit(0))
    expected = wanted.agg(F.count("*").alias("n")).scalar()
    return (
        accounts.select("accountId")
        .join(held, "accountId", "left")
        .select("accountId", held_count.alias("held"), expected.alias("expected"))
        .withColumn("missing", F.col("expected") - F.col("held"))
    )


def missing_holdings(
    holdings: DataFrame, instruments: DataFrame, accounts: Sequence[str]
) -> DataFrame:
    """The non-cash instruments each of the named accounts does not hold."""
    if not accounts:
        raise ValueError("name the accounts to check")
    named = F.explode(F.array(*[F.lit(a) for a in accounts])).alias("accountId")
    wanted = latest(instruments, "instrument").filter(~is_cash()).select("instrumentId", named)
    held = holdings.filter(in_accounts(accounts)).select("accountId", "instrumentId")
    return wanted.join(held, ["accountId", "instrumentId"], "left_anti")
