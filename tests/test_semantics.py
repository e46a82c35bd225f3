"""Worked cases of the valuation and the views."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from navspark.functions import keys as K
from navspark.functions.predicates import has_valid_price
from navspark.operators import audit, changes, lifecycle, overview, paging, positions
from navspark.operators.latest import latest, latest_price_only, latest_unified, live_rows
from navspark.operators.replay import replay
from navspark.plans.feeds import Feeds
from navspark.plans.request import Exposure, ViewRequest
from navspark.sources import decode
from tests.conftest import rows_of
from tests.feeds import feeds, frame, holding, instrument, order, price

BY_ACCOUNT = ViewRequest(("ACC001",), ("accountName",))
TICK_ORDER = ("tickTime", "tickSequence")


def navs(df):
    return [
        tuple(int(x) for x in row)
        for row in df.select("sodNavUSD", "currentNavUSD", "expectedNavUSD", "recordCount")
        .collect()
    ]


def test_overview_of_one_holding_and_one_order(spark):
    logs = feeds(
        spark, [holding(0, 10)], [order(1, 5, 2)], [instrument(0)], [price(2, 10), price(3, 10)]
    )
    assert navs(overview.account_overview(positions.snapshot(*logs), BY_ACCOUNT)) == [
        (100, 120, 150, 2)
    ]
    log = replay(*logs)
    assert navs(overview.cumulative_overview(log, BY_ACCOUNT)) == [(200, 240, 300, 4)]
    assert navs(overview.cumulative_from_versions(*logs, BY_ACCOUNT)) == [(200, 240, 300, 4)]


def test_cancelled_orders_count_unless_excluded(spark):
    logs = feeds(spark, [holding(0, 10)], [order(1, 5, 2, "CANCELLED")], [instrument(0)],
                 [price(2, 10)])
    valued = positions.snapshot(*logs)
    assert navs(overview.account_overview(valued, BY_ACCOUNT)) == [(100, 120, 150, 2)]
    assert navs(
        overview.account_overview(valued, BY_ACCOUNT, exclude_statuses=("CANCELLED",))
    ) == [(100, 100, 100, 2)]


def test_only_ticks_emit(spark):
    late_order = feeds(spark, [holding(0, 1)], [order(5, 1)], [instrument(0)], [price(1, 10)])
    assert [r.recordType for r in replay(*late_order).collect()] == ["HOLDING"]
    late_instrument = feeds(spark, [holding(0, 1)], [], [instrument(5)], [price(1, 10)])
    assert replay(*late_instrument).count() == 0
    assert positions.snapshot(*late_instrument, as_of_last_tick=True).count() == 0
    assert positions.snapshot(*late_instrument).count() == 1


def test_arrival_at_the_tick_is_known(spark):
    logs = feeds(spark, [holding(1, 1), holding(1, 2, sequence=9)], [], [instrument(1)],
                 [price(1, 10)])
    assert [int(r.marketValueUSD) for r in replay(*logs).collect()] == [20]


def test_stale_dated_holding(spark):
    logs = feeds(
        spark, [holding(0, 10, day=1), holding(5, 20, day=2)], [], [instrument(0)],
        [price(1, 10), price(6, 11)],
    )
    table = latest_unified(replay(*logs), TICK_ORDER)
    assert sorted((r.unifiedKey, int(r.marketValueUSD)) for r in table.collect()) == [
        ("HOLDING#2024-01-01#AAPL#ACC001", 100), ("HOLDING#2024-01-02#AAPL#ACC001", 220),
    ]
    assert [r.isConsistent for r in audit.price_consistency(table).collect()] == [False]
    clean = latest_price_only(table)
    assert [int(r.marketValueUSD) for r in clean.collect()] == [220]
    assert navs(overview.account_overview(clean, BY_ACCOUNT)) == [(220, 220, 220, 1)]
    assert navs(overview.account_overview(table, BY_ACCOUNT)) == [(320, 320, 320, 2)]


def test_instrument_versions_split_the_cumulative_view(spark):
    logs = feeds(
        spark, [holding(0, 1)], [],
        [instrument(0, sector="A"), instrument(3, sector="B"), instrument(6, sector="A")],
        [price(1, 1), price(4, 10), price(7, 100), price(8, 0)],
    )
    request = ViewRequest(None, ("sector",))
    expected = [("A", 101, 2), ("B", 10, 1)]
    for rows in (
        overview.cumulative_overview(replay(*logs), request),
        overview.cumulative_from_versions(*logs, request),
    ):
        assert sorted((r.rowKey, int(r.sodNavUSD), r.recordCount) for r in rows.collect()) == (
            expected
        )


def test_invalid_prices_leave_the_view(spark):
    logs = feeds(spark, [holding(0, 1)], [], [instrument(0)], [price(1, 0)])
    valued = positions.snapshot(*logs)
    assert valued.count() == 1 and valued.filter(has_valid_price()).count() == 0
    assert overview.account_overview(valued, BY_ACCOUNT).count() == 0


def test_group_key_of_nulls_orders_and_unknown_fields(spark):
    logs = feeds(spark, [holding(0, 1)], [order(0, 1)], [instrument(0, sector=None)],
                 [price(1, 10)])
    request = ViewRequest(None, ("accountId", "sector", "VENUE", "colour"))
    rows = overview.account_overview(positions.snapshot(*logs), request).collect()
    assert sorted(r.rowKey for r in rows) == [
        "ACC001#null#NYSE#unknown", "ACC001#null#null#unknown",
    ]
    assert rows[0].groupingFields["colour"] == "unknown"


def test_separator_in_values_does_not_merge_groups(spark):
    logs = feeds(
        spark, [holding(0, 1, "A#B", "C"), holding(0, 1, "A", "B#C")], [],
        [instrument(0, "C"), instrument(0, "B#C")], [price(1, 1, "C"), price(1, 1, "B#C")],
    )
    valued = positions.snapshot(*logs).withColumn("sector", F.col("instrumentId"))
    view = overview.account_overview(valued, ViewRequest(None, ("accountId", "sector")))
    assert [r.rowKey for r in view.collect()] == ["A#B#C", "A#B#C"]


def test_account_names(spark):
    logs = feeds(spark, [holding(0, 1, a) for a in ("1", "2", "3")], [], [instrument(0)],
                 [price(1, 10)])
    accounts = frame(spark, "account", [{"accountId": "1", "accountName": "Fund"},
                                        {"accountId": "2", "accountName": "Fund"}])
    view = overview.account_overview(
        positions.snapshot(*logs), ViewRequest(None, ("accountName",)), accounts
    )
    assert sorted((r.accountName, int(r.sodNavUSD), r.recordCount) for r in view.collect()) == [
        ("3", 10, 1), ("Fund", 20, 2),
    ]


def test_exposures_and_calculation_time(spark):
    logs = feeds(spark, [holding(0, 1)], [], [instrument(0)], [price(1, 10)])
    valued = positions.with_calculation_time(positions.snapshot(*logs))
    view = overview.account_overview(
        valued, ViewRequest(("ACC001",), ("sector",), (Exposure.EXPECTED,))
    )
    assert [c for c in view.columns if "Nav" in c] == ["expectedNavUSD"]
    assert view.first().lastUpdated is not None


def test_worked_account_total(spark):
    """A holding of 100, a buy of 20 and a sell of 10, all as absolute amounts."""
    def valued(value):
        return positions.snapshot(*feeds(
            spark, [holding(0, 100)], [order(0, 20), order(0, -10, order_id="O2")],
            [instrument(0)], [price(1, value)],
        ))
    change = overview.nav_change(valued("150"), valued("151.50"), abs_orders=True).first()
    assert (change.navBefore, change.navAfter, change.change) == (19500, 19695, 195)
    signed = overview.account_nav_totals(valued("151.50")).first()
    assert signed.totalValue == 16665
    maps = overview.account_nav_maps(valued("151.50"), ("ACC001",), abs_orders=True).first()
    assert maps.holdingValues == {"AAPL": 15150} and maps.orderValues == {"AAPL": 4545}
    with pytest.raises(ValueError):
        overview.account_nav_maps(valued("1"), ())


def test_view_sums_do_not_depend_on_grouping(spark, data):
    valued = Feeds(spark, data).snapshot()
    totals = set()
    for fields in (("accountId",), ("sector", "venue"), ("instrumentName", "orderStatus")):
        view = overview.account_overview(valued, ViewRequest(None, fields))
        totals.add(tuple(view.agg(F.sum("sodNavUSD"), F.sum("expectedNavUSD")).first()))
    assert len(totals) == 1


def test_table_view_equals_snapshot_at_last_tick(spark, data):
    f = Feeds(spark, data)
    names = ["rowKey", "sodNavUSD", "currentNavUSD", "expectedNavUSD", "recordCount"]
    request = ViewRequest(None, ("accountId", "sector"))
    table = latest_price_only(latest_unified(f.replay(), TICK_ORDER))
    at_tick = f.snapshot(as_of_last_tick=True)
    assert rows_of(overview.account_overview(table, request).select(*names)) == rows_of(
        overview.account_overview(at_tick, request).select(*names)
    )


def test_every_tick_has_one_price(spark, data):
    log = Feeds(spark, data).replay()
    assert audit.price_consistency(log, ["tickSequence"]).filter("NOT isConsistent").count() == 0


def test_injected_price_fault_is_found(spark):
    logs = feeds(spark, [holding(0, 1), holding(0, 1, "ACC002")], [], [instrument(0)],
                 [price(1, 10)])
    valued = positions.snapshot(*logs)
    broken = valued.withColumn(
        "price", F.when(F.col("accountId") == "ACC002", F.col("price") + 1).otherwise(F.col("price"))
    )
    assert [r.isConsistent for r in audit.price_consistency(valued).collect()] == [True]
    assert [r.isConsistent for r in audit.price_consistency(broken).collect()] == [False]


def test_typed_valuation_mode(spark):
    logs = feeds(spark, [holding(0, 10, instrument="UST")], [], [instrument(0, "UST", kind="BOND")],
                 [price(1, "98.50", "UST")])
    assert positions.snapshot(*logs, mode="typed").first().marketValueUSD == 985


def test_time_to_live(spark):
    prices = latest(frame(spark, "price", [price(0, 1), price(5, 2, "MSFT")]), "price")
    as_of = F.lit("2024-01-16 12:03:00").cast("timestamp_ntz")
    assert [r.instrumentId for r in live_rows(prices, "price", as_of).collect()] == ["MSFT"]


def test_lifecycle_rules(spark):
    orders = frame(spark, "order", [
        order(0, 10), order(1, 10, 5, "PARTIALLY_FILLED"), order(2, 10, 10, "FILLED"),
        order(0, -10, 0, order_id="O2"), order(1, -10, 4, "PARTIALLY_FILLED", "O2"),
        order(2, -10, 3, "REJECTED", "O2"), order(3, -10, 3, "CREATED", "O2"),
        order(0, 10, 11, "PARTIALLY_FILLED", "O3"), order(1, 10, 9, "FILLED", "O3"),
    ])
    found = {
        (r.orderId, r.sequence): [rule for rule in lifecycle.RULES if r[rule]]
        for r in lifecycle.violations(orders).collect()
    }
    assert found == {
        ("O2", 2): ["fillFalls"], ("O2", 3): ["afterTerminal"], ("O3", 0): ["overfilled"],
        ("O3", 1): ["fillFalls", "filledMismatch"],
    }
    assert lifecycle.working_order_count(orders).first()[0] == 1


def test_missing_holdings_of_named_accounts(spark):
    held = frame(spark, "holding", [holding(0, 1)])
    static = frame(spark, "instrument", [
        instrument(0), instrument(0, "MSFT"), instrument(0, "USD", kind="CURRENCY"),
        instrument(0, "GBP", sector="Cash"),
    ])
    missing = audit.missing_holdings(held, static, ("ACC001", "ACC002"))
    assert rows_of(missing.select("accountId", "instrumentId")) == [
        ("ACC001", "MSFT"), ("ACC002", "AAPL"), ("ACC002", "MSFT"),
    ]
    accounts = frame(spark, "account", [{"accountId": "ACC001"}, {"accountId": "ACC002"}])
    counts = audit.holding_coverage(held, static, accounts)
    assert rows_of(counts) == [("ACC001", 1, 2, 1), ("ACC002", 0, 2, 2)]
    assert missing.count() == counts.agg(F.sum("missing")).first()[0]


def test_page_totals_of_a_choice(spark, data):
    valued = Feeds(spark, data).snapshot()
    chosen = audit.page_totals(valued, accounts=("7", "8"), instruments=("1", "2", "3")).first()
    kept = valued.filter("accountId IN ('7', '8') AND instrumentId IN ('1', '2', '3')")
    assert chosen.recordCount == kept.count()


def view(spark, rows):
    exact = [
        (key, *[None if nav is None else Decimal(nav) for nav in navs], count)
        for key, *navs, count in rows
    ]
    return spark.createDataFrame(
        exact, "rowKey STRING, sodNavUSD DECIMAL(38,10), currentNavUSD DECIMAL(38,10), "
        "expectedNavUSD DECIMAL(38,10), recordCount BIGINT",
    )


def test_diff_message_and_direction(spark):
    old = view(spark, [("a", 1, 150000, 1, 1), ("b", 1, 1, 1, 1), ("c", 1, 1, 1, 1)])
    new = view(spark, [("a", 1, 151250, 1, 1), ("b", 1, 1, 1, 1), ("d", None, 2, 2, 1)])
    diff = changes.diff(old, new)
    assert rows_of(diff.select("rowKey", "changeType")) == [
        ("a", "UPDATE"), ("c", "DELETE"), ("d", "INSERT"),
    ]
    field = changes.field_changes(diff).first()
    assert (field.field, field.fieldType, field.delta, field.direction) == (
        "currentNavUSD", "DECIMAL", 1250, "up",
    )
    message = changes.change_set(diff).filter("rowKey = 'a'").first()
    assert list(message.changedFields) == ["currentNavUSD"]
    assert message.changedFields["currentNavUSD"].oldValue.startswith("150000")
    assert changes.diff(old, old).count() == 0
    assert changes.diff(old, new, keep_equal=True).count() == 4


def test_fold_of_diffs_gives_the_new_view(spark):
    states = [
        view(spark, []),
        view(spark, [("a", 1, 1, 1, 1), ("b", 5, 5, 5, 2)]),
        view(spark, [("a", 1, None, 3, 1), ("c", 0, 0, 1, 1)]),
        view(spark, [("b", 9, 9, 9, 9), ("c", 0, 0, 1, 1)]),
    ]
    log = None
    for step, (before, after) in enumerate(zip(states, states[1:], strict=False)):
        entry = changes.as_log(changes.diff(before, after), step)
        log = entry if log is None else log.unionByName(entry)
        assert rows_of(changes.fold(log)) == rows_of(after)


def test_directions(spark):
    rows = [
        ("marketValueUSD", "1", "2", "up"), ("sodNavUSD", "2", None, "down"),
        ("position", "1", "1.0", "same"), ("priceTimestamp", "a", "b", "time"),
        ("lastUpdated", "a", "b", "time"), ("orderStatus", "CREATED", "FILLED", "up"),
        ("orderStatus", "CREATED", "CANCELLED", "down"),
        ("orderStatus", "CREATED", "REJECTED", "changed"), ("sector", "a", "b", "changed"),
    ]
    df = spark.createDataFrame(rows, "field STRING, oldValue STRING, newValue STRING, e STRING")
    found = df.select("e", changes.direction().alias("d")).collect()
    assert [r.d for r in found] == [r.e for r in found]


def test_pages(spark):
    df = spark.range(120).select(
        F.format_string("k%03d", "id").alias("k"), (F.col("id") % 7).alias("v")
    )
    seen = [r.k for n in range(3) for r in paging.page(df, [("v", False)], "k", n, 50).collect()]
    assert seen == [r.k for r in paging.sorted_rows(df, [("v", False)], "k").collect()]
    assert [r.k for r in paging.page_after(df, "k", "k009", 3).collect()] == ["k010", "k011", "k012"]
    between = paging.column_filter("v", "number", "inRange", (2, 3))
    assert {r.v for r in df.filter(between).collect()} == {2, 3}
    assert df.filter(paging.column_filter("k", "text", "endsWith", "7")).count() == 12


def test_revaluation_of_ticked_instruments_only(spark):
    logs = feeds(spark, [holding(0, 1), holding(0, 1, instrument="MSFT")], [],
                 [instrument(0), instrument(0, "MSFT")], [price(1, 10), price(2, 20, "MSFT")])
    current = positions.positions(latest(logs[0], "holding"), latest(logs[1], "order"))
    ticked = logs[3].filter("sequence = 2")
    rows = positions.revalue_changed(current, positions.quotes(logs[2], logs[3]), ticked)
    assert rows.select(K.unified_key()).first()[0] == "HOLDING#2024-01-15#MSFT#ACC001"
    assert rows.count() == 1


@pytest.mark.parametrize("by", [[("v", True)], [("v", False), ("w", True)], [("w", False), ("v", True)]])
def test_pages_by_key_join_to_the_full_sort(spark, by):
    """With nulls and ties in all sort columns, in any direction; no plan counts rows to skip."""
    rows = [(f"k{i:02d}", None if i % 7 == 0 else i % 4, None if i % 5 == 0 else i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "k STRING, v INT, w INT")
    whole = [r.k for r in paging.sorted_rows(df, by, "k").collect()]
    seen, end = [], None
    while True:
        page = paging.seek(df, by, "k", end, 7)
        assert "Offset" not in page._jdf.queryExecution().optimizedPlan().toString()
        found = page.collect()
        if not found:
            break
        seen += [r.k for r in found]
        end = {name: found[-1][name] for name in ("k", "v", "w")}
    assert seen == whole
    first = paging.seek(df, by, "k", None, 7)
    assert [r.k for r in paging.seek(df, by, "k", paging.end_key(first, by, "k"), 7).collect()] == whole[7:14]


def test_composed_changes_equal_the_change_of_all(spark):
    """Random views; whatever happens to a row between, folding the composed log gives the last view."""
    dice = random.Random(11)
    columns = "rowKey STRING, sodNavUSD INT, currentNavUSD INT, expectedNavUSD INT, recordCount INT"
    views = []
    for _ in range(6):
        rows = [(f"r{i}", *(dice.choice((1, 2, None)) for _ in range(4))) for i in range(30) if dice.random() < 0.6]
        views.append(spark.createDataFrame(rows, columns))
    steps = [
        changes.diff(a, b).withColumn("sequence", F.lit(i)).withColumn("window", F.lit(i // 3))
        for i, (a, b) in enumerate(zip(views, views[1:]))
    ]
    whole = steps[0]
    for step in steps[1:]:
        whole = whole.unionByName(step)
    assert rows_of(changes.compose(whole)) == rows_of(changes.diff(views[0], views[-1]))
    parts = changes.compose(whole, within=["window"])
    for number, (a, b) in enumerate(((0, 3), (3, 5))):
        own = parts.filter(F.col("window") == number).drop("window")
        assert rows_of(own) == rows_of(changes.diff(views[a], views[b]))


def test_dead_letters_keep_bytes_and_origin(spark):
    values = [b'{"instrumentId":"A","price":1}', b"", None, b'{"price":"\xe9"}', b"\xff\x00nonsense"]
    rows = [(b"k", v, "base.price", i % 2, i) for i, v in enumerate(values)]
    log = spark.createDataFrame(rows, "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT")
    log = log.withColumn("timestamp", F.lit("2024-01-15 12:00:00").cast("timestamp"))
    letters = decode.dead_letters(log, "price")
    assert {r.topic for r in letters.collect()} == {"dlt.base-data"} and letters.columns == log.columns
    back = {(r.partition, r.offset): r.value and bytes(r.value) for r in decode.opened(letters).collect()}
    assert back == {(i % 2, i): v for i, v in enumerate(values) if i}
    fixed = decode.opened(letters).withColumn("value", F.lit(b'{"instrumentId":"B","price":2}'))
    good = decode.read_dataset(decode.restored(log, fixed.unionByName(fixed)), "price")
    assert sorted((r.sequence, r.instrumentId) for r in good.collect()) == [(0, "A"), (1, "B"), (2, "B"), (3, "B"), (4, "B")]
