"""Windowed join of enriched holdings and prices on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.functions.valuation import raw_value
from navspark.operators.positions import price_columns


def window_join(
    holdings: DataFrame, prices: DataFrame, width: str = "1 minute", late: str = "5 minutes"
) -> DataFrame:
    """Holdings joined to the prices of the same instrument and tumbling window.

    The watermark on both sides lets Spark drop windows that can get no more rows. Watermarks
    need a zoned time, so the times are read as UTC.
    """
    held = (
        holdings.withColumn("eventTime", F.col("timestamp").cast("timestamp"))
        .withWatermark("eventTime", late)
        .withColumn("slot", F.window("eventTime", width))
        .drop("timestamp", "eventTime")
    )
    priced = (
        price_columns(prices, F.col("sequence").alias("priceSequence"))
        .withColumn("priceTime", F.col("priceTimestamp").cast("timestamp"))
        .withWatermark("priceTime", late)
        .withColumn("slot", F.window("priceTime", width))
        .drop("priceTime")
    )
    joined = held.join(priced, ["instrumentId", "slot"])
    return joined.withColumn("windowStart", F.col("slot.start").cast("timestamp_ntz")).withColumn(
        "marketValueUSD", raw_value(F.col("price"), F.col("position"))
    ).drop("slot")
