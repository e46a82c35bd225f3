"""Heavy keys: the spread plans give the rows of the plain ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from navspark.operators import overview, skew
from navspark.operators.latest import latest_by_key, versions
from navspark.operators.lifecycle import order_history
from navspark.operators.replay import replay, ticked_positions
from navspark.plans.feeds import Feeds
from navspark.plans.request import ViewRequest
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def lopsided(spark):
    """1,200 rows, one key with a third of them."""
    dice = random.Random(7)
    rows = []
    for i in range(1200):
        key = "hot" if i % 3 == 0 else f"k{dice.randrange(60)}"
        rows.append((key, i, dice.randrange(86_400 * 4)))
    return spark.createDataFrame(rows, "key STRING, n INT, second INT").withColumn(
        "time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second")).cast("timestamp_ntz")
    )


def test_heavy_keys_are_found(lopsided):
    assert rows_of(skew.heavy_keys(lopsided, ["key"], 100)) == [("hot", 4)]
    assert rows_of(skew.heavy_keys(lopsided, ["key"], 1000)) == []


def test_every_heavy_key_is_spread(spark):
    """3,000 heavy keys, and one that needs 3,000 shares."""
    many = spark.range(30_000).select((F.col("id") % 3000).alias("key"))
    heavy = skew.heavy_keys(many, ["key"], 4)
    assert heavy.count() == 3000 and heavy.agg(F.min("shares")).first()[0] == 3
    one = spark.range(30_000).select(F.lit(1).alias("key"))
    assert rows_of(skew.heavy_keys(one, ["key"], 10)) == [(1, 3000)]


def test_neighbour_in_one_instant(spark):
    """A load with one time is cut by the second order column."""
    frame = spark.range(500).selectExpr("'hot' AS key", "id AS n", "TIMESTAMP_NTZ '2024-01-01' AS time")
    found = skew.neighbour(frame, ["key"], ["time", "n"], ["n"], "x", True, rows_per_task=50)
    assert rows_of(found.selectExpr("n", "x.n")) == rows_of(
        spark.range(500).selectExpr("id", "IF(id < 499, id + 1, NULL)")
    )


@pytest.mark.parametrize("spread", [None, 3])
@pytest.mark.parametrize("chunk", [600, 10**9])
def test_as_of_equals_brute_force(lopsided, chunk, spread):
    states = lopsided.filter("n % 5 = 0").dropDuplicates(["key", "time"])
    states = states.select("key", F.col("time").alias("since"), F.col("n").alias("v"))
    probes = lopsided.select("key", "time", "n")
    # Every tenth probe asks for the last version.
    open_ = F.when(F.col("n") % 10 != 0, F.col("time")).alias("time")
    probes = probes.select("key", open_, "n")
    shares = None
    if spread:
        shares = skew.heavy_keys(probes, ["key"], 50)
    found = skew.as_of(probes, states, ["key"], "time", "since", ["since", "v"], chunk, spread=shares)
    known = states.collect()
    want = []
    for r in probes.collect():
        past = [s for s in known if s.key == r.key and (r.time is None or s.since <= r.time)]
        if past:
            last = max(past, key=lambda s: s.since)
            want.append((r.key, r.time, r.n, last.since, last.v))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, want)))


def test_a_million_open_probes_of_one_key_are_spread(spark):
    """Probes that ask for the last version don't meet in one task."""
    probes = spark.range(1_000_000).selectExpr("'hot' AS key", "id AS n", "CAST(NULL AS TIMESTAMP_NTZ) AS time")
    states = spark.sql("SELECT 'hot' AS key, TIMESTAMP_NTZ '2024-01-01' AS since, 7 AS v")
    found = skew.as_of(probes, states, ["key"], "time", "since", ["since", "v"])
    sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) > 2


def test_loads_come_from_one_exchange(spark):
    rows = spark.range(1000).selectExpr("CAST(id % 3 AS STRING) AS a", "IF(id % 7 = 0, NULL, CAST(id % 5 AS STRING)) AS b", "'x' AS c")
    load = skew.loads(rows, ["a"], ["c", "b"])
    assert rows_of(load.groupBy().sum("rows")) == [(2000,)]
    one, two = skew.heavy_of(load, 0, 300), skew.heavy_of(load, 1, 150)
    frame = skew.with_splits(skew.with_splits(rows, ["a"], one, "x"), ["c", "b"], two, "y")
    assert frame.columns == ["a", "b", "c", "x", "y"]
    assert rows_of(frame.groupBy("x").count()) == [(2, 1000)]
    assert rows_of(frame.groupBy("y").count()) == [(1, 143), (2, 857)]
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Generate explode") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize(("left_rows", "right_rows"), [(50, 20), (50, 10**6), (10**6, 20)])
def test_grid_join_equals_join(spark, lopsided, left_rows, right_rows):
    right = lopsided.select("key", F.col("n").alias("m"), F.col("time").alias("end"))
    condition = F.col("l.time") <= F.col("r.end")
    found = skew.spread_join(
        lopsided, right, ["key"], ["n"], ["m"], condition, left_rows, right_rows
    )
    plain = (
        lopsided.alias("l")
        .join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & condition)
        .select("l.*", "r.m", "r.end")
    )
    assert found.columns == plain.columns
    assert rows_of(found) == rows_of(plain)


@pytest.mark.parametrize("forward", [True, False])
def test_chunked_neighbour_equals_window(lopsided, forward):
    found = skew.neighbour(
        lopsided, ["key"], ["time", "n"], ["n"], "x", forward, rows_per_task=50
    ).select("key", "n", F.col("x.n").alias("near"))
    shift = F.lead if forward else F.lag
    window = Window.partitionBy("key").orderBy("time", "n")
    assert rows_of(found) == rows_of(
        lopsided.select("key", "n", shift("n").over(window).alias("near"))
    )


@pytest.mark.parametrize("rows_per_task", [5, 10**6])
def test_later_sums_equal_brute_force(lopsided, rows_per_task):
    points = lopsided.select("key", "time", F.col("n").cast("bigint").alias("v"))
    probes = lopsided.select("key", "time", F.col("n").alias("probe"))
    found = skew.later_sums(
        points, probes, ["key"], "time", ["v"], chunk_seconds=7200, rows_per_task=rows_per_task
    )
    rows = lopsided.select("key", "time", "n").collect()
    expected = sorted(
        (r.key, r.n, sum(o.n for o in rows if o.key == r.key and o.time >= r.time)) for r in rows
    )
    assert sorted((r.key, r.probe, r.v) for r in found.collect()) == expected


def test_spread_versions_and_replay(spark, data):
    f = Feeds(spark, data)
    kept = ["orderId", "sequence", "validFrom", "validTo"]
    assert rows_of(versions(f.orders, "order", rows_per_task=2).select(*kept)) == rows_of(
        versions(f.orders, "order").select(*kept)
    )
    plain = replay(*f.logs).select("instrumentId", "orderId", "holdingId", "tickSequence")
    spread = replay(*f.logs, position_rows=20, tick_rows=10).select(*plain.columns)
    assert rows_of(spread) == rows_of(plain)


def test_spread_cumulative_equals_event_log(spark, data):
    f = Feeds(spark, data)
    request = ViewRequest(None, ("sector", "orderStatus"))
    names = ["rowKey", "sodNavUSD", "currentNavUSD", "expectedNavUSD", "recordCount"]
    whole = overview.cumulative_overview(f.replay(), request).select(*names)
    fast = overview.cumulative_from_versions(*f.logs, request, rows_per_task=3).select(*names)
    assert rows_of(fast) == rows_of(whole)


def test_history_of_a_heavy_order(spark, data):
    f = Feeds(spark, data)
    one_order = f.orders.withColumn("orderId", F.lit("O"))
    names = ["timestamp", "sequence", "instrumentId", "previousStatus", "previousFilled"]
    order = ["timestamp", "sequence"]
    unique = one_order.dropDuplicates(order)
    assert rows_of(order_history(unique, rows_per_task=100).select(*names)) == rows_of(
        order_history(unique).select(*names)
    )


def test_latest_reduces_before_the_exchange(lopsided):
    plan = latest_by_key(lopsided, ["key"], ["time", "n"])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


@pytest.mark.parametrize("fields", [("sector",), ("instrumentName", "accountName")])
def test_cumulative_over_a_thousand_eras(spark, fields):
    """One instrument renamed before each of its ticks; sector changes once."""
    from datetime import timedelta

    from tests.feeds import NOON, feeds, holding, instrument, order, price

    dice = random.Random(3)
    versions_, ticks, held, ordered = [], [], [], []
    for i in range(1000):
        row = instrument(0, sector="A" if i < 400 else "B")
        row["instrumentName"], row["timestamp"], row["sequence"] = f"N{i}", NOON + timedelta(seconds=10 * i), i
        versions_.append(row)
        tick = price(0, i % 7 + 1)
        tick["timestamp"] = tick["date"] = NOON + timedelta(seconds=10 * i + 5)
        tick["sequence"] = 5000 + i
        ticks.append(tick)
    for k in range(40):
        at = NOON + timedelta(seconds=dice.randrange(-500, 10_000))
        row = holding(0, dice.randint(1, 9), account=f"A{k % 5}", sequence=10_000 + k)
        held.append({**row, "timestamp": at})
        row = order(0, dice.randint(1, 9), dice.randint(0, 5), order_id=f"O{k % 11}")
        ordered.append({**row, "timestamp": at + timedelta(seconds=1), "sequence": 20_000 + k})
    logs = feeds(spark, held, ordered, versions_, ticks)
    request = ViewRequest(None, fields)
    names = ["rowKey", "sodNavUSD", "currentNavUSD", "expectedNavUSD", "recordCount"]
    fast = overview.cumulative_from_versions(*logs, request, rows_per_task=20).select(*names)
    whole = overview.cumulative_overview(replay(*logs), request).select(*names)
    found = rows_of(fast)
    assert found == rows_of(whole) and len(found) > (1 if fields == ("sector",) else 1000)
    plan = fast._jdf.queryExecution().optimizedPlan().toString()
    assert "validFrom#" not in "".join(line for line in plan.splitlines() if "Join " in line and "knownSince" in line)


def test_loads_send_buckets_and_not_keys(spark):
    """300,000 keys of one row each; a heavy one among them is still found."""
    many = spark.range(300_000).selectExpr("CAST(id AS STRING) AS a").unionAll(
        spark.range(5000).selectExpr("'hot' AS a")
    )
    load = skew.loads(many, ["a"])
    assert load.count() <= skew.BUCKETS
    heavy = skew.heavy_of(load, 0, 2000)
    splits = skew.with_splits(many, ["a"], heavy, "n").groupBy("n").agg(F.count("*"), F.max("a"))
    assert [r for r in rows_of(splits) if r[0] > 1] == [(3, 5000 + splits_beside(many, load), "hot")]


def splits_beside(many, load):
    """Other keys of the hot key's bucket."""
    marked = many.withColumn("m", skew._load_mark(0, ["a"]))
    hot = marked.filter("a = 'hot'").first().m
    return marked.filter(F.col("m") == hot).filter("a <> 'hot'").count()


def test_a_filter_has_all_its_keys_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("IF(id = 7, NULL, CAST(id * 3 AS STRING)) AS k")
    filter_ = skew.seen(keys, ["k"])
    rows = spark.range(60_000).selectExpr("CAST(id AS STRING) AS k").unionAll(spark.sql("SELECT CAST(NULL AS STRING)"))
    found = rows.filter(skew.possible(["k"], filter_))
    assert keys.join(found, keys.k.eqNullSafe(found.k), "left_anti").count() == 0
    assert 20_000 <= found.count() < 20_500
    assert rows.filter(skew.possible(["k"], skew.seen(keys.limit(0), ["k"]))).count() == 0


def test_positions_without_a_tick_stay_in_their_scan(spark, data):
    """Rows of instruments that never tick meet no exchange, but an order's versions stay together."""
    from tests.feeds import feeds, holding, instrument, order, price

    f = Feeds(spark, data)
    for kept in ticked_positions(f.holdings, f.orders, f.prices)[:2]:
        plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
        scan = next(line for line in plan if "Filter" in line and "l_linestatus" in line)
        assert "getbit" in scan
    logs = feeds(
        spark, [holding(0, 10), holding(0, 4, instrument="IBM")],
        [order(1, 5), order(15, 6, instrument="IBM"), order(25, 7), order(3, 2, order_id="O2", instrument="IBM")],
        [instrument(0), instrument(0, "IBM")], [price(m, 10 + m) for m in (10, 20, 30)],
    )
    found = replay(*logs).select("recordType", "orderQuantity", "tickSequence")
    assert [(r[0], r[1] and int(r[1]), r[2]) for r in rows_of(found)] == [
        ("HOLDING", None, 10), ("HOLDING", None, 20), ("HOLDING", None, 30), ("ORDER", 5, 10), ("ORDER", 7, 30)
    ]
    held, ordered, _ = ticked_positions(*logs[:2], logs[3])
    assert held.count() == 1 and {r.orderId for r in ordered.collect()} == {"O1"} and ordered.count() == 3
