"""Latest state per key, time-to-live, and validity intervals of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.functions import keys as K
from navspark.operators import skew
from navspark.schemas import LIVE_HOURS

ARRIVAL = ("timestamp", "sequence")

# Identity of the current row of each dataset. A holding is identified without its date: the
# holding of a new day replaces the old one.
STATE_KEYS = {
    "account": ("accountId",),
    "instrument": ("instrumentId",),
    "price": ("instrumentId",),
    "holding": ("instrumentId", "accountId"),
    "order": ("orderId",),
    "cash": ("accountId", "timestamp"),
}


def latest_by_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """The last arrived row of each key, whatever its event time.

    Spark keeps one row per key in each task before the exchange, so a key with very many
    versions does not pile up in one task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def latest(df: DataFrame, dataset: str, order: Sequence[str] = ARRIVAL) -> DataFrame:
    return latest_by_key(df, STATE_KEYS[dataset], order)


def latest_unified(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last valued row per unified key; here the date of a holding is part of the key."""
    return latest_by_key(df.withColumn("unifiedKey", K.unified_key()), ["unifiedKey"], order)


def live_rows(df: DataFrame, dataset: str, as_of: Column, written: str = "timestamp") -> DataFrame:
    """Rows whose time-to-live has not run out at ``as_of``."""
    return df.filter(F.col(written) > as_of - F.expr(f"INTERVAL {LIVE_HOURS[dataset]} HOURS"))


def latest_price_only(valued: DataFrame) -> DataFrame:
    """Drop valued rows priced before their instrument's newest price.

    A holding replaced by a later day keeps its own key and its last price; such a leftover
    would count its account twice and mix prices.
    """
    newest = valued.groupBy("instrumentId").agg(F.max("priceTimestamp").alias("_newest"))
    joined = valued.join(newest, "instrumentId")
    return joined.filter(F.col("priceTimestamp") == F.col("_newest")).drop("_newest")


def versions(
    df: DataFrame,
    dataset: str,
    tie_breakers: Sequence[str] = ("sequence",),
    time: str = "timestamp",
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Add the interval [validFrom, validTo) in which a row was the current one of its key."""
    following = skew.neighbour(
        df, STATE_KEYS[dataset], [time, *tie_breakers], [time], "_next", True,
        rows_per_task=rows_per_task,
    )
    return (
        following.withColumn("validFrom", F.col(time))
        .withColumn("validTo", F.col(f"_next.{time}"))
        .drop("_next")
    )


def daily_close(prices: DataFrame) -> DataFrame:
    """Last tick of each instrument and day."""
    last = F.max(F.struct("timestamp", "sequence", "price")).alias("last")
    return (
        prices.groupBy("instrumentId", F.to_date("date").alias("day"))
        .agg(last, F.count("*").alias("ticks"))
        .select("instrumentId", "day", F.col("last.price").alias("closePrice"), "ticks")
    )
