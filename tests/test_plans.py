"""Shape of the physical plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from navspark.operators import positions
from navspark.plans import catalog, lookups, streams  # noqa: F401  (registers the queries)
from navspark.plans.feeds import Feeds
from navspark.plans.registry import QUERIES

BATCH = [name for name in QUERIES if not name.startswith(("stream_", "csv_"))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cross_join(name, spark, data):
    plan = plan_of(QUERIES[name](spark, data))
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


def test_account_filter_reaches_both_scans(spark, data, tmp_path):
    f = Feeds(spark, data)
    f.holdings.write.parquet(str(tmp_path / "holding"))
    f.orders.write.parquet(str(tmp_path / "order"))
    held = spark.read.parquet(str(tmp_path / "holding"))
    ordered = spark.read.parquet(str(tmp_path / "order"))
    view = positions.lazy_account_view(
        held, ordered, f.instruments, f.prices, ("7", "8"), ("accountId",)
    )
    pushed = re.findall(r"PushedFilters: \[([^\n]*?)\], ReadSchema", plan_of(view))
    assert sum("accountId" in filters for filters in pushed) == 2
    total = view.agg(F.sum("recordCount")).first()[0]
    assert total == f.snapshot().filter("accountId IN ('7', '8')").count()


def test_exposure_prunes_columns(spark, data):
    plan = plan_of(QUERIES["account_overview_by_sector"](spark, data))
    events = re.search(r"ReadSchema: struct<([^>]*user_id[^>]*)>", plan).group(1)
    assert "props" not in events


@pytest.mark.parametrize("name", BATCH)
def test_building_a_query_runs_no_job(name, spark, data):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    QUERIES[name](spark, data)
    assert set(tracker.getJobIdsForGroup()) == before


@pytest.mark.parametrize("name", ["unified_mv_replay", "latest_unified_mv", "account_overview_cumulative"])
def test_positions_are_read_twice(name, spark, data):
    """Once to count them by key and once to work on them: two scans of each of two feeds."""
    df = QUERIES[name](spark, data)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert sum("lineitem.parquet" in line for line in final.splitlines()) <= 4
