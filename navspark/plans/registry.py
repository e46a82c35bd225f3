"""Registered queries: a Spark plan over the feeds, and SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from navspark.plans.feeds import Feeds, present


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Feeds], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return present(self.build(Feeds(spark, folder)))


QUERIES: dict[str, Query] = {}


def query(sql: str | None) -> Callable[[Callable[[Feeds], DataFrame]], Callable]:
    def register(build: Callable[[Feeds], DataFrame]) -> Callable:
        if build.__name__ in QUERIES:
            raise ValueError(f"query registered twice: {build.__name__}")
        QUERIES[build.__name__] = Query(build.__name__, build, sql)
        return build

    return register
