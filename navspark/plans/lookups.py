"""Queries of chosen accounts, keys and instruments, and of the feeds that others leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.operators import audit, changes, overview
from navspark.operators.latest import latest, live_rows
from navspark.plans import catalog as C
from navspark.plans import oracle as O
from navspark.plans.feeds import Feeds
from navspark.plans.oracle import m, ts, with_
from navspark.plans.registry import query
from navspark.plans.request import ViewRequest
from navspark.sources import decode, publish
from navspark.streaming import tables

CHOSEN = tuple(str(n) for n in range(1, 60))
IN_CHOSEN = "accountId IN (" + ", ".join(f"'{a}'" for a in CHOSEN) + ")"
BY_SECTOR = ViewRequest(None, ("sector",))
ENDS_IN_3 = "accountId IN (SELECT accountId FROM account WHERE accountId LIKE '%3')"


@query(
    with_(O.BASE, O.STATE)
    + O.overview("snap", {"sector": "sector"}, name_join=False, where=IN_CHOSEN)
)
def overview_of_accounts(f: Feeds) -> DataFrame:
    """A view of listed accounts."""
    return overview.account_overview(f.snapshot(accounts=CHOSEN), BY_SECTOR)


@query(
    with_(O.BASE, O.STATE)
    + O.overview("snap", {"sector": "sector"}, name_join=False, where=ENDS_IN_3)
)
def overview_of_account_table(f: Feeds) -> DataFrame:
    """A view of the accounts of a table, however many there are."""
    chosen = f.accounts.filter(F.col("accountId").endswith("3"))
    return overview.account_overview(f.snapshot(accounts=chosen), BY_SECTOR)


_TOTALS = f"""
SELECT {{name}} AS choice, {m("coalesce(sum(CASE WHEN recordType = 'HOLDING' THEN mv END), 0)",
       'holdingValue')},
       {m("coalesce(sum(CASE WHEN recordType = 'ORDER' THEN mv END), 0)", 'orderValue')},
       count(*) AS recordCount FROM snap WHERE {{where}}"""


@query(
    with_(O.BASE, O.STATE)
    + " UNION ALL ".join(
        _TOTALS.format(name=f"'{name}'", where=where)
        for name, where in (
            ("all", "TRUE"), ("accounts", IN_CHOSEN), ("instruments", "instrumentId IN ('1', '2')")
        )
    )
)
def totals_of_choices(f: Feeds) -> DataFrame:
    """Page totals of everything, of some accounts, and of some instruments."""
    valued = f.snapshot()
    parts = {
        "all": audit.page_totals(valued, (), ()),
        "accounts": audit.page_totals(valued, CHOSEN, ()),
        "instruments": audit.page_totals(valued, (), ("1", "2")),
    }
    rows = [df.withColumn("choice", F.lit(name)) for name, df in parts.items()]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.select("choice", "holdingValue", "orderValue", "recordCount")


@query(
    with_(
        O.BASE,
        """
changed AS MATERIALIZED (SELECT orderId, accountId, orderStatus, filledQuantity, ts, seq FROM order_event),
last AS MATERIALIZED (
  SELECT orderId, max_by({a: accountId, s: orderStatus, f: filledQuantity}, (ts, seq)) AS row,
         bool_or(seq % 97 = 0) AS asked
  FROM changed GROUP BY orderId)""",
    )
    + f"""
SELECT orderId, row.a AS accountId, row.s AS orderStatus, {m('row.f', 'filledQuantity')}
FROM last WHERE asked"""
)
def orders_by_id(f: Feeds) -> DataFrame:
    """The current state of the orders of a table of ids."""
    ids = f.orders.filter("sequence % 97 = 0").select("orderId")
    return audit.lookup(latest(f.orders, "order"), ids).select(
        "orderId", "accountId", "orderStatus", "filledQuantity"
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT holdingId, accountId, instrumentId, {m('position')} FROM holding_now WHERE {IN_CHOSEN}"""
)
def holdings_of_accounts(f: Feeds) -> DataFrame:
    chosen = f.holdings.filter(F.col("accountId").isin(*CHOSEN))
    return latest(chosen, "holding").select("holdingId", "accountId", "instrumentId", "position")


@query(
    with_(O.BASE, O.STATE)
    + "SELECT i.instrumentId, instrumentName, sector FROM instrument_now i "
    "WHERE instrumentId IN (SELECT instrumentId FROM holding WHERE " + IN_CHOSEN + ")"
)
def instruments_by_id(f: Feeds) -> DataFrame:
    """The instruments that some accounts hold."""
    ids = f.holdings.filter(F.col("accountId").isin(*CHOSEN)).select("instrumentId")
    return audit.lookup(latest(f.instruments, "instrument"), ids).select(
        "instrumentId", "instrumentName", "sector"
    )


@query(
    with_(O.BASE)
    + f"""
SELECT {ts('date')}, instrumentId, accountId, {m('quantity')}, movementType, referenceId,
       {ts('ts', 'timestamp')} FROM cash"""
)
def cash_round_trip(f: Feeds) -> DataFrame:
    """Cash movements written as topic records under their key, and read back."""
    records = publish.as_log(f.cash, "cash")
    return decode.read_dataset(records, "cash").drop("topicPartition", "sequence")


@query(with_(O.BASE) + f"SELECT accountId, accountName, {ts('ts', 'timestamp')} FROM account")
def account_round_trip(f: Feeds) -> DataFrame:
    """Accounts written as topic records under their key, and read back."""
    records = publish.as_log(f.accounts, "account")
    return decode.read_dataset(records, "account").drop("topicPartition", "sequence")


@query(
    with_(O.BASE)
    + """
SELECT 'base.price' AS topic, count(*) AS messages FROM events
UNION ALL SELECT 'base.order-events', count(*) FROM order_event
UNION ALL SELECT 'base.intraday-cash', count(*) FROM cash
UNION ALL SELECT 'ALL', (SELECT count(*) FROM events) + (SELECT count(*) FROM order_event)
                        + (SELECT count(*) FROM cash)"""
)
def volume_of_topics(f: Feeds) -> DataFrame:
    log = f.price_topic.unionByName(publish.as_log(f.orders, "order"))
    return audit.topic_volume(log.unionByName(publish.as_log(f.cash, "cash")))


@query(
    with_(O.BASE, O.STATE)
    + " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, count(*) AS \"rows\" FROM {table} t "
        f"WHERE {column} > TIMESTAMP '{C.AS_OF}' - INTERVAL {hours} HOURS"
        for name, table, column, hours in (
            ("account", "account", "ts", 720),
            ("instrument", "instrument_now", "ts", 720),
            ("holding", "holding_now", "ts", 168),
            ("price", "price_now", "ts", 24),
            ("order", "order_now", "ts", 24),
            ("cash", O.newest("cash", "accountId, ts"), "ts", 168),
            ("unified", "snap", "priceTimestamp", 168),
        )
    )
)
def live_rows_by_dataset(f: Feeds) -> DataFrame:
    """Rows of each latest-value table whose time-to-live has not run out."""
    as_of = F.lit(C.AS_OF).cast("timestamp_ntz")
    feeds = {
        "account": f.accounts, "instrument": f.instruments, "holding": f.holdings,
        "price": f.prices, "order": f.orders, "cash": f.cash,
    }
    live = {name: live_rows(latest(df, name), name, as_of) for name, df in feeds.items()}
    live["unified"] = live_rows(f.snapshot(), "unified", as_of, "priceTimestamp")
    return audit.dataset_counts(live)


@query(with_(O.BASE, O.REPLAY) + C._consistency("log").replace(
    "SELECT instrumentId,", f"SELECT instrumentId, {ts('tickTime')}, tickSequence,"
).replace("GROUP BY 1", "GROUP BY instrumentId, log.tickTime, tickSequence"))
def price_consistency_per_tick(f: Feeds) -> DataFrame:
    """Every position of a tick carries that tick's price."""
    return audit.price_consistency(f.replay(), ("tickTime", "tickSequence"))


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT accountId, instrumentId,
       {m("sum(CASE WHEN recordType = 'HOLDING' THEN mv ELSE 0 END)", 'holdingValue')},
       {m("sum(CASE WHEN recordType = 'ORDER' THEN mv ELSE 0 END)", 'orderValue')}
FROM snap WHERE {IN_CHOSEN} GROUP BY 1, 2"""
)
def account_nav_of_maps(f: Feeds) -> DataFrame:
    """The maps of chosen accounts, laid out again as rows."""
    maps = overview.account_nav_maps(f.snapshot(), CHOSEN)
    rows = maps.select("accountId", "orderValues", F.explode("holdingValues").alias("instrumentId", "holdingValue"))
    return rows.select(
        "accountId", "instrumentId", "holdingValue",
        F.element_at("orderValues", F.col("instrumentId")).alias("orderValue"),
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT a.accountId, i.instrumentId FROM account a, instrument_now i
WHERE a.accountId IN ('1', '2', '4') AND NOT {C.IS_CASH}
  AND NOT EXISTS (SELECT 1 FROM holding h
                  WHERE h.accountId = a.accountId AND h.instrumentId = i.instrumentId)"""
)
def missing_holdings_of_accounts(f: Feeds) -> DataFrame:
    """The gap list: what each of the named accounts does not hold."""
    return audit.missing_holdings(f.holdings, f.instruments, ("1", "2", "4")).select(
        "accountId", "instrumentId"
    )


@query(C.TWO_VIEWS + "SELECT 'view' AS viewId, rowKey, changeType FROM changed")
def delivered_changes(f: Feeds) -> DataFrame:
    """Changes between two moments, gathered into bounded deliveries and unpacked again."""
    sent = tables.deliveries(changes.diff(*C._two_views(f)), "view", largest=50)
    row = F.explode("rowChanges").alias("row")
    return sent.select("viewId", row).select("viewId", "row.rowKey", "row.changeType")
