"""The feeds of a folder of test tables, and how results are shown."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DateType,
    DecimalType,
    MapType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from navspark.operators import positions, replay
from navspark.session import tune
from navspark.sources import bridge


class Feeds:
    """Lazy tables; each is planned when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    @cached_property
    def accounts(self) -> DataFrame:
        return bridge.accounts(self.spark, self.folder)

    @cached_property
    def instruments(self) -> DataFrame:
        return bridge.instruments(self.spark, self.folder)

    @cached_property
    def price_feed(self) -> DataFrame:
        return bridge.price_feed(self.spark, self.folder)

    @cached_property
    def prices(self) -> DataFrame:
        return bridge.prices(self.spark, self.folder)

    @cached_property
    def holdings(self) -> DataFrame:
        return bridge.holdings(self.spark, self.folder)

    @cached_property
    def orders(self) -> DataFrame:
        return bridge.order_events(self.spark, self.folder)

    @cached_property
    def cash(self) -> DataFrame:
        return bridge.cash(self.spark, self.folder)

    @cached_property
    def price_topic(self) -> DataFrame:
        return bridge.price_topic(self.spark, self.folder)

    @property
    def logs(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.holdings, self.orders, self.instruments, self.prices

    @cached_property
    def quotes(self) -> DataFrame:
        return positions.quotes(self.instruments, self.prices)

    def snapshot(self, **options: object) -> DataFrame:
        return positions.snapshot(*self.logs, **options)

    def replay(self, **options: object) -> DataFrame:
        return replay.replay(*self.logs, **options)

    def until(self, moment: str) -> Feeds:
        """The same feeds as they were at a moment."""
        past = Feeds(self.spark, self.folder)
        known = F.col("timestamp") <= F.lit(moment).cast("timestamp_ntz")
        for name in ("instruments", "prices", "holdings", "orders", "cash"):
            setattr(past, name, getattr(self, name).filter(known))
        return past


def present(df: DataFrame) -> DataFrame:
    """Plain columns for comparison: amounts as doubles of 4 places, times as text."""
    shown = []
    for field in df.schema:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (MapType, StructType)):
            continue
        if isinstance(kind, DecimalType):
            column = F.round(column, 4).cast("double")
        elif isinstance(kind, DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (TimestampNTZType, TimestampType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, ArrayType):
            column = F.concat_ws(" ", column)
        shown.append(column.alias(field.name))
    return df.select(*shown)
