"""Batch queries over the whole given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.functions import keys as K
from navspark.functions import predicates as P
from navspark.functions import valuation as V
from navspark.operators import audit, changes, lifecycle, overview, paging, positions, replay
from navspark.operators.latest import (
    daily_close as daily_close_of,
)
from navspark.operators.latest import (
    latest,
    live_rows,
)
from navspark.operators.latest import (
    latest_price_only as only_latest_price,
)
from navspark.plans import oracle as O
from navspark.plans.feeds import Feeds
from navspark.plans.oracle import day, m, ts, with_
from navspark.plans.registry import query
from navspark.plans.request import Exposure, ViewRequest
from navspark.sources import bridge, decode, publish

BY_ACCOUNT_SECTOR = ViewRequest(None, ("accountName", "sector"))
BY_SECTOR = ViewRequest(None, ("sector",))
EARLIER, LATER = "2024-01-20 00:00:00", "2024-01-28 00:00:00"
BETWEEN = ("2024-01-22 12:00:00", "2024-01-25 00:00:00")
LATEST = "2024-01-30 18:00:00"


# Account overviews.


@query(
    with_(O.BASE, O.STATE) + O.overview("snap", {"accountName": O.NAME, "sector": "sector"})
)
def account_overview(f: Feeds) -> DataFrame:
    return overview.account_overview(f.snapshot(), BY_ACCOUNT_SECTOR, f.accounts)


@query(with_(O.BASE, O.STATE) + O.overview("snap", {"sector": "sector"}, name_join=False))
def account_overview_by_sector(f: Feeds) -> DataFrame:
    return overview.account_overview(f.snapshot(), BY_SECTOR)


@query(with_(O.BASE, O.STATE) + O.overview("snap", O.ON_ORDERS, name_join=False))
def account_overview_order_fields(f: Feeds) -> DataFrame:
    request = ViewRequest(None, ("ORDERSTATUS", "orderType", "venue"))
    return overview.account_overview(f.snapshot(), request)


@query(
    with_(O.BASE, O.STATE)
    + O.overview(
        "snap", {"accountId": "s.accountId", "currency": "currency"}, ("sodNavUSD",),
        name_join=False,
    )
)
def account_overview_exposure_sod(f: Feeds) -> DataFrame:
    request = ViewRequest(None, ("accountId", "currency"), (Exposure.SOD,))
    return overview.account_overview(f.snapshot(), request)


@query(
    with_(O.BASE, O.STATE)
    + O.overview(
        "snap", {"instrumentType": "instrumentType", "colour": "'unknown'"}, name_join=False,
        where="(recordType = 'HOLDING' OR orderStatus NOT IN ('CANCELLED', 'REJECTED'))",
    )
)
def account_overview_live_orders(f: Feeds) -> DataFrame:
    """Orders that came to nothing are left out; an unknown field groups as ``unknown``."""
    stopped = F.coalesce(F.col("orderStatus").isin("CANCELLED", "REJECTED"), F.lit(False))
    request = ViewRequest(None, ("instrumentType", "colour"))
    return overview.account_overview(
        f.snapshot().filter(~stopped), request, exclude_statuses=("CANCELLED", "REJECTED")
    )


@query(
    with_(O.BASE, O.REPLAY)
    + O.overview("log", {"accountName": O.NAME, "sector": "sector"}, price_time=False)
)
def account_overview_cumulative(f: Feeds) -> DataFrame:
    return overview.cumulative_from_versions(*f.logs, BY_ACCOUNT_SECTOR, f.accounts)


@query(
    with_(O.BASE, O.REPLAY)
    + O.overview("log", {"sector": "sector", **O.ON_ORDERS}, price_time=False, name_join=False)
)
def account_overview_cumulative_by_order_fields(f: Feeds) -> DataFrame:
    request = ViewRequest(None, ("sector", "orderStatus", "orderType", "venue"))
    return overview.cumulative_from_versions(*f.logs, request)


@query(
    with_(O.BASE, O.REPLAY) + O.overview("log", {"currency": "currency"}, name_join=False)
)
def account_overview_event_log(f: Feeds) -> DataFrame:
    """The cumulative overview taken from the replayed event log itself."""
    return overview.cumulative_overview(f.replay(), ViewRequest(None, ("currency",)))


@query(
    with_(O.BASE, O.REPLAY, O.TABLE_NOW)
    + """, newest AS (SELECT instrumentId, max(priceTimestamp) AS top FROM table_now GROUP BY 1),
clean AS (SELECT t.* FROM table_now t JOIN newest n ON t.instrumentId = n.instrumentId
          AND t.priceTimestamp = n.top)"""
    + O.overview("clean", {"sector": "sector"}, name_join=False)
)
def account_overview_of_table(f: Feeds) -> DataFrame:
    """Overview of the latest-value table kept by the event log, leftovers removed."""
    table = replay.latest_valued(*f.logs)
    return overview.account_overview(only_latest_price(table), BY_SECTOR)


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT coalesce(sector, 'null') AS rowKey, {m('sod', 'sodNavUSD')}, {m('cur', 'currentNavUSD')},
       {m('ex', 'expectedNavUSD')}, {m('sod + cur + ex', 'totalNavUSD')}, lastInstrumentName
FROM (SELECT sector, {O.SOD} AS sod, {O.CURRENT} AS cur, {O.EXPECTED} AS ex,
             arg_max(instrumentName, (priceTimestamp, instrumentName)) AS lastInstrumentName
      FROM snap WHERE price > 0 GROUP BY sector)
WHERE sod <> 0 OR cur <> 0 OR ex <> 0"""
)
def overview_totals(f: Feeds) -> DataFrame:
    rows = overview.account_overview(
        f.snapshot(), BY_SECTOR, last_instrument_by=("priceTimestamp",)
    )
    return rows.withColumn("totalNavUSD", P.total_nav()).select(
        "rowKey", "sodNavUSD", "currentNavUSD", "expectedNavUSD", "totalNavUSD",
        "lastInstrumentName",
    )


@query(
    with_(O.BASE, O.STATE)
    + O.overview("snap", {"accountName": O.NAME, "sector": "sector"})
)
def preaggregated_nav(f: Feeds) -> DataFrame:
    current = positions.positions(latest(f.holdings, "holding"), latest(f.orders, "order"))
    return overview.preaggregated_overview(current, f.quotes, BY_ACCOUNT_SECTOR, f.accounts)


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT a.accountId, a.accountName, {m('coalesce(sod, 0)', 'sodNavUSD')},
       {m('coalesce(cur, 0)', 'currentNavUSD')}, {m('coalesce(ex, 0)', 'expectedNavUSD')},
       coalesce(n, 0) AS recordCount
FROM account a LEFT JOIN (
  SELECT * FROM (SELECT accountId, {O.SOD} AS sod, {O.CURRENT} AS cur, {O.EXPECTED} AS ex,
                        count(*) AS n
                 FROM snap WHERE price > 0 GROUP BY 1)
  WHERE sod <> 0 OR cur <> 0 OR ex <> 0) USING (accountId)"""
)
def accounts_with_empty(f: Feeds) -> DataFrame:
    request = ViewRequest(None, ("accountId",))
    rows = overview.account_overview(f.snapshot(), request)
    return overview.with_empty_accounts(rows, f.accounts, request)


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT accountId, currency, {m('sum(mv)', 'marketValueUSD')}, count(*) AS recordCount
FROM snap WHERE accountId IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)
GROUP BY 1, 2"""
)
def lazy_account_view(f: Feeds) -> DataFrame:
    """Accounts chosen by a table: their rows are picked before anything is joined or valued."""
    customers = bridge.table(f.spark, f.folder, "customer").filter("c_acctbal > 0")
    chosen = customers.select(F.col("c_custkey").cast("string").alias("accountId"))
    return positions.lazy_account_view(
        f.holdings.join(chosen, "accountId", "left_semi"),
        f.orders.join(chosen, "accountId", "left_semi"),
        f.instruments, f.prices, None, ("accountId", "currency"),
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT accountId, instrumentId, {m('h', 'holdingValue')}, {m('o', 'orderValue')},
       {m('h + o', 'totalValue')}
FROM (SELECT accountId, instrumentId,
             sum(CASE WHEN recordType = 'HOLDING' THEN mv ELSE 0 END) AS h,
             sum(CASE WHEN recordType = 'ORDER' THEN mv ELSE 0 END) AS o
      FROM snap GROUP BY 1, 2)"""
)
def account_nav_breakdown(f: Feeds) -> DataFrame:
    return overview.account_nav(f.snapshot())


def _nav_at(suffix: str) -> str:
    return (
        f"(SELECT accountId, sum(CASE WHEN recordType = 'ORDER' THEN abs(mv) ELSE mv END) AS nav "
        f"FROM snap{suffix} GROUP BY 1)"
    )


@query(
    with_(
        O.BASE,
        O.state("_a", f"ts <= TIMESTAMP '{EARLIER}'"),
        O.state("_b", f"ts <= TIMESTAMP '{LATER}'"),
    )
    + f"""
SELECT accountId, {m('coalesce(x.nav, 0)', 'navBefore')}, {m('coalesce(y.nav, 0)', 'navAfter')},
       {m('coalesce(y.nav, 0) - coalesce(x.nav, 0)', 'change')}
FROM {_nav_at('_a')} x FULL JOIN {_nav_at('_b')} y USING (accountId)"""
)
def nav_before_after(f: Feeds) -> DataFrame:
    """Orders as absolute amounts, as in the account total of the worked example."""
    before, after = f.until(EARLIER).snapshot(), f.until(LATER).snapshot()
    return overview.nav_change(before, after, abs_orders=True)


# Valuation.


@query(with_(O.BASE, O.STATE) + f"SELECT {O.UNIFIED}, {O.UNIFIED_KEY} AS unifiedKey FROM snap")
def unified_mv_snapshot(f: Feeds) -> DataFrame:
    return f.snapshot().withColumn("unifiedKey", K.unified_key())


AT_LAST_TICK = O.STATE
for _log in ("holding", "order_event", "instrument"):
    AT_LAST_TICK = AT_LAST_TICK.replace(
        f"(SELECT * FROM {_log} WHERE TRUE)",
        f"(SELECT x.* FROM {_log} x JOIN last_tick l USING (instrumentId) WHERE x.ts <= l.top)",
    )


@query(
    with_(
        O.BASE,
        " last_tick AS (SELECT instrumentId, max(ts) AS top FROM tick GROUP BY 1)",
        AT_LAST_TICK,
    )
    + f"SELECT {O.UNIFIED} FROM snap"
)
def unified_mv_at_last_tick(f: Feeds) -> DataFrame:
    return f.snapshot(as_of_last_tick=True)


@query(
    with_(O.BASE, O.REPLAY)
    + f"SELECT {O.UNIFIED}, {ts('tickTime')}, tickSequence FROM log"
)
def unified_mv_replay(f: Feeds) -> DataFrame:
    return f.replay()


QTY = "CASE WHEN recordType = 'HOLDING' THEN position ELSE orderQuantity END"


def _typed(quantity: str, face: int | str = 100) -> str:
    return f"""CASE WHEN {quantity} = 0 THEN 0
  WHEN instrumentType = 'CURRENCY' THEN round({quantity}, 2)
  WHEN instrumentType = 'BOND'
    THEN round(CAST(round(price * 0.01, 6) AS DECIMAL(14,6)) * ({face}) * {quantity}, 2)
  ELSE round(price * {quantity}, 2) END"""


TYPED = f"""
typed AS (
  SELECT s.*, {_typed('(' + QTY + ')')} AS local,
         CASE WHEN recordType = 'ORDER'
              THEN {_typed('coalesce(filledQuantity, 0)')} END AS filledLocal,
         coalesce(r.rate, 1) AS rate
  FROM snap s LEFT JOIN rate r ON r.code = s.currency)"""


@query(
    with_(O.BASE, O.STATE, TYPED)
    + f"""
SELECT {O.UNIFIED_KEY} AS unifiedKey, instrumentType, currency,
       {m('local', 'marketValueLocal')}, {m('round(local * rate, 2)', 'marketValueUSD')},
       {m('filledLocal', 'filledMarketValueLocal')},
       {m('round(filledLocal * rate, 2)', 'filledMarketValueUSD')}
FROM typed"""
)
def typed_valuation(f: Feeds) -> DataFrame:
    return f.snapshot(mode="typed").select(
        K.unified_key().alias("unifiedKey"), "instrumentType", "currency", "marketValueLocal",
        "marketValueUSD", "filledMarketValueLocal", "filledMarketValueUSD",
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT {O.UNIFIED_KEY} AS unifiedKey, instrumentType,
       {m(_typed('(' + QTY + ')', 1000), 'marketValue')}
FROM snap"""
)
def bond_face_value(f: Feeds) -> DataFrame:
    """Typed values with a face of 1000 for bonds."""
    value = V.typed_value(
        F.col("instrumentType"), F.col("price"), P.quantity_for_calculation(), F.lit(1000)
    )
    return f.snapshot().select(
        K.unified_key().alias("unifiedKey"), "instrumentType", value.alias("marketValue")
    )


FACE = "(CAST(instrumentId AS BIGINT) % 7 + 1) * 142857"


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT {O.UNIFIED_KEY} AS unifiedKey, instrumentType, {FACE} AS face,
       {m('CAST(' + _typed('(' + QTY + ')', FACE) + ' AS DECIMAL(38,2))', 'marketValue')}
FROM snap"""
)
def bond_face_column(f: Feeds) -> DataFrame:
    """Typed values with a face of its own for each instrument, up to a million."""
    valued = f.snapshot().withColumn("face", F.expr(FACE))
    return V.value_positions(valued, "typed", face=F.col("face")).select(
        K.unified_key().alias("unifiedKey"), "instrumentType", "face",
        F.col("marketValueLocal").alias("marketValue"),
    )


# Units with more than four places, as a table of rates holds them.
FINE_RATES = {"USD": "1", "EUR": "1.0853172", "JPY": "0.0067254", "AUD": "0.000725"}


@query(
    with_(O.BASE)
    + f""", fine(code, rate) AS (VALUES {', '.join(
        f"('{c}', CAST({r} AS DECIMAL(16,10)))" for c, r in FINE_RATES.items())})
SELECT referenceId, instrumentId AS currency,
       {m('round(quantity * 1000 * coalesce(rate, 1), 2)', 'amountUSD')}
FROM cash LEFT JOIN fine ON code = instrumentId"""
)
def fine_rates(f: Feeds) -> DataFrame:
    """Conversion by table rates of ten places."""
    rates = f.spark.createDataFrame(list(FINE_RATES.items()), "currency STRING, rate STRING")
    rated = V.with_rates(f.cash, rates, "instrumentId")
    amount = F.col("quantity") * 1000
    return rated.select(
        "referenceId", F.col("instrumentId").alias("currency"),
        V.convert_to_usd(amount, F.col("instrumentId"), F.col("rateToUSD")).alias("amountUSD"),
    )


@query(
    with_(O.BASE)
    + f"""
SELECT referenceId, instrumentId AS currency, {m('quantity', 'amount')},
       {m('coalesce(rate, 1)', 'rate')}, rate IS NOT NULL AS supported,
       {m("round(quantity * coalesce(rate, 1), 2)", 'amountUSD')}
FROM cash LEFT JOIN rate ON code = instrumentId"""
)
def fx_conversion(f: Feeds) -> DataFrame:
    code = F.concat(F.lit(" "), F.lower("instrumentId"), F.lit(" "))
    return f.cash.select(
        "referenceId",
        F.col("instrumentId").alias("currency"),
        F.col("quantity").alias("amount"),
        V.rate_to_usd(code).alias("rate"),
        V.is_supported_currency(code).alias("supported"),
        V.convert_to_usd(F.col("quantity"), code).alias("amountUSD"),
    )


@query(
    with_(O.BASE)
    + f"""
SELECT priceCurrency, rate IS NOT NULL AS supported, count(*) AS ticks,
       {m('sum(price * coalesce(rate, 1))', 'priceUSD')}
FROM tick LEFT JOIN rate ON code = priceCurrency GROUP BY 1, 2"""
)
def rates_from_table(f: Feeds) -> DataFrame:
    """Rates joined from a table in place of the fixed ones."""
    rates = f.spark.createDataFrame(
        [(code, rate) for code, rate in V.USD_RATES.items()], "currency STRING, rate STRING"
    )
    priced = V.with_rates(f.prices.withColumnRenamed("currency", "priceCurrency"), rates,
                          "priceCurrency")
    rate = F.coalesce("rateToUSD", F.lit(1)).cast(V.RATE)
    return priced.groupBy("priceCurrency", F.col("rateToUSD").isNotNull().alias("supported")).agg(
        F.count("*").alias("ticks"), F.sum(F.col("price") * rate).alias("priceUSD")
    )


@query(
    with_(O.BASE, O.STATE)
    + """
SELECT currency, count(*) AS instruments FROM instrument_now
WHERE currency NOT IN (SELECT code FROM rate) GROUP BY 1"""
)
def unsupported_currencies(f: Feeds) -> DataFrame:
    now = latest(f.instruments, "instrument")
    return (
        now.filter(~V.is_supported_currency(F.col("currency")))
        .groupBy("currency")
        .agg(F.count("*").alias("instruments"))
    )


# Latest state.


@query(
    with_(O.BASE, O.STATE)
    + f"""SELECT instrumentId, {ts('priceTimestamp', 'date')}, {m('price')},
       priceCurrency AS currency, priceSource AS source FROM price_now"""
)
def latest_price(f: Feeds) -> DataFrame:
    return latest(f.prices, "price").select("instrumentId", "date", "price", "currency", "source")


@query(
    with_(O.BASE, O.STATE)
    + f"SELECT holdingId, {day('date')}, instrumentId, accountId, {m('position')} FROM holding_now"
)
def latest_holding(f: Feeds) -> DataFrame:
    return latest(f.holdings, "holding").select(
        "holdingId", "date", "instrumentId", "accountId", "position"
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT orderId, instrumentId, accountId, {m('orderQuantity')}, {m('filledQuantity')}, orderStatus,
       {m('orderPrice')}, orderType, venue, {ts('ts', 'timestamp')} FROM order_now"""
)
def current_orders(f: Feeds) -> DataFrame:
    return latest(f.orders, "order").drop("date", "sequence")


@query(
    with_(O.BASE, O.STATE)
    + """
SELECT instrumentId, instrumentName, instrumentType, currency, countryOfRisk, countryOfDomicile,
       sector, subSectors FROM instrument_now"""
)
def latest_instrument(f: Feeds) -> DataFrame:
    return latest(f.instruments, "instrument").drop("timestamp", "sequence")


@query(with_(O.BASE) + "SELECT accountId, accountName FROM account")
def latest_account(f: Feeds) -> DataFrame:
    return latest(f.accounts, "account").select("accountId", "accountName")


@query(
    with_(O.BASE)
    + f"""
SELECT accountId, {ts('ts', 'timestamp')}, instrumentId, {m('quantity')}, movementType, referenceId
FROM {O.newest('cash', 'accountId, ts')}"""
)
def latest_cash(f: Feeds) -> DataFrame:
    return latest(f.cash, "cash").select(
        "accountId", "timestamp", "instrumentId", "quantity", "movementType", "referenceId"
    )


@query(
    with_(O.BASE, O.REPLAY, O.TABLE_NOW)
    + f"""
SELECT unifiedKey, recordType, instrumentId, accountId, {m('price')}, {ts('priceTimestamp')},
       {m('mv', 'marketValueUSD')}, {m('fmv', 'filledMarketValueUSD')} FROM table_now"""
)
def latest_unified_mv(f: Feeds) -> DataFrame:
    return replay.latest_valued(*f.logs).select(
        "unifiedKey", "recordType", "instrumentId", "accountId", "price", "priceTimestamp",
        "marketValueUSD", "filledMarketValueUSD",
    )


@query(
    with_(O.BASE, O.REPLAY, O.TABLE_NOW)
    + f"""
SELECT unifiedKey, {ts('priceTimestamp')}, {m('mv', 'marketValueUSD')}
FROM (SELECT *, max(priceTimestamp) OVER (PARTITION BY instrumentId) AS top FROM table_now)
WHERE priceTimestamp = top"""
)
def latest_price_only(f: Feeds) -> DataFrame:
    table = replay.latest_valued(*f.logs)
    return only_latest_price(table).select("unifiedKey", "priceTimestamp", "marketValueUSD")


AS_OF = "2024-01-30 00:00:00"


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT 'price' AS dataset, instrumentId AS rowKey FROM price_now
WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS
UNION ALL SELECT 'order', orderId FROM order_now
WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS
UNION ALL SELECT 'holding', holdingId FROM holding_now
WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS
UNION ALL SELECT 'instrument', instrumentId FROM instrument_now
WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 720 HOURS"""
)
def live_rows_ttl(f: Feeds) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    parts = [
        ("price", f.prices, "instrumentId"), ("order", f.orders, "orderId"),
        ("holding", f.holdings, "holdingId"), ("instrument", f.instruments, "instrumentId"),
    ]
    live = [
        live_rows(latest(df, name), name, as_of).select(
            F.lit(name).alias("dataset"), F.col(key).alias("rowKey")
        )
        for name, df, key in parts
    ]
    return live[0].unionByName(live[1]).unionByName(live[2]).unionByName(live[3])


# Orders.


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT orderId, orderStatus, {m('orderQuantity')} FROM order_now
WHERE orderStatus IN ('CREATED', 'PARTIALLY_FILLED')"""
)
def working_orders(f: Feeds) -> DataFrame:
    return lifecycle.working_orders(f.orders).select("orderId", "orderStatus", "orderQuantity")


@query(
    with_(O.BASE, O.STATE)
    + """SELECT count(*) AS workingOrders FROM order_now
WHERE orderStatus IN ('CREATED', 'PARTIALLY_FILLED')"""
)
def working_order_count(f: Feeds) -> DataFrame:
    return lifecycle.working_order_count(f.orders)


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT orderId, CASE WHEN orderQuantity > 0 THEN 'BUY' WHEN orderQuantity < 0 THEN 'SELL' END
         AS side,
       {m('abs(orderQuantity)', 'quantity')},
       {m('abs(orderQuantity) - filledQuantity', 'remaining')},
       filledQuantity = abs(orderQuantity) AS completelyFilled,
       orderStatus IN ('FILLED', 'CANCELLED', 'REJECTED') AS terminal
FROM order_now"""
)
def order_derivations(f: Feeds) -> DataFrame:
    return latest(f.orders, "order").select(
        "orderId",
        P.side().alias("side"),
        F.abs("orderQuantity").alias("quantity"),
        P.remaining_quantity().alias("remaining"),
        P.completely_filled().alias("completelyFilled"),
        P.is_terminal().alias("terminal"),
    )


HISTORY = """
history AS (
  SELECT *, lag(orderStatus) OVER w AS previousStatus, lag(filledQuantity) OVER w AS previousFilled
  FROM order_event WINDOW w AS (PARTITION BY orderId ORDER BY ts, seq)),
judged AS (
  SELECT *, coalesce(previousStatus IN ('FILLED', 'CANCELLED', 'REJECTED'), FALSE) AS afterTerminal,
         previousStatus IS NOT NULL
           AND coalesce(filledQuantity, 0) < coalesce(previousFilled, 0) AS fillFalls,
         coalesce(filledQuantity, 0) > abs(orderQuantity) AS overfilled,
         (orderStatus = 'FILLED') <> coalesce(filledQuantity = abs(orderQuantity), FALSE)
           AS filledMismatch
  FROM history)"""


@query(
    with_(O.BASE, HISTORY)
    + f"""
SELECT orderId, {ts('ts', 'timestamp')}, orderStatus, previousStatus, {m('filledQuantity')},
       {m('previousFilled')} FROM judged"""
)
def order_history(f: Feeds) -> DataFrame:
    return lifecycle.order_history(f.orders).select(
        "orderId", "timestamp", "orderStatus", "previousStatus", "filledQuantity", "previousFilled"
    )


@query(
    with_(O.BASE, HISTORY)
    + f"""
SELECT orderId, {ts('ts', 'timestamp')}, orderStatus, previousStatus, afterTerminal, fillFalls,
       overfilled, filledMismatch FROM judged
WHERE afterTerminal OR fillFalls OR overfilled OR filledMismatch"""
)
def order_lifecycle_violations(f: Feeds) -> DataFrame:
    return lifecycle.violations(f.orders).select(
        "orderId", "timestamp", "orderStatus", "previousStatus", *lifecycle.RULES
    )


# Predicates and keys.

IS_CASH = "(coalesce(lower(sector) = 'cash', FALSE) OR upper(instrumentType) = 'CURRENCY')"


@query(
    with_(O.BASE, O.STATE) + f"SELECT instrumentId, {IS_CASH} AS isCash FROM instrument_now"
)
def cash_instruments(f: Feeds) -> DataFrame:
    return latest(f.instruments, "instrument").select("instrumentId", P.is_cash().alias("isCash"))


@query(
    with_(O.BASE, O.STATE, TYPED)
    + f"""
SELECT {O.UNIFIED_KEY} AS unifiedKey, {m('round(local * rate, 2)', 'usdOrder')},
       {m('''CASE WHEN recordType = 'ORDER' THEN round(filledLocal * rate, 2)
                  ELSE round(local * rate, 2) END''', 'usdFilled')},
       {m('local', 'localOrder')},
       {m("CASE WHEN recordType = 'ORDER' THEN filledLocal ELSE local END", 'localFilled')}
FROM typed"""
)
def market_value_pick(f: Feeds) -> DataFrame:
    valued = f.snapshot(mode="typed").filter(P.has_market_values())
    return valued.select(
        K.unified_key().alias("unifiedKey"),
        P.pick_market_value("USD").alias("usdOrder"),
        P.pick_market_value("USD", "FILLED").alias("usdFilled"),
        P.pick_market_value("LOCAL").alias("localOrder"),
        P.pick_market_value("LOCAL", "FILLED").alias("localFilled"),
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT {O.UNIFIED_KEY} AS unifiedKey, {m(QTY, 'quantity')},
       {m('''coalesce(CASE WHEN recordType = 'ORDER'
              THEN abs(orderQuantity) - filledQuantity END, 0)''', 'remaining')}
FROM snap WHERE priceTimestamp IS NOT NULL"""
)
def quantity_for_calculation(f: Feeds) -> DataFrame:
    return f.snapshot().filter(P.has_price_time()).select(
        K.unified_key().alias("unifiedKey"),
        P.quantity_for_calculation().alias("quantity"),
        P.unified_remaining_quantity().alias("remaining"),
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT accountId, instrumentId, holdingId, {m('mv', 'marketValueUSD')} FROM snap
WHERE recordType = 'HOLDING'"""
)
def unified_holdings(f: Feeds) -> DataFrame:
    return f.snapshot().filter(P.is_holding()).select(
        "accountId", "instrumentId", "holdingId", "marketValueUSD"
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT accountId, instrumentId, orderId, {m('mv', 'marketValueUSD')} FROM snap
WHERE recordType = 'ORDER' AND price > 0"""
)
def unified_orders(f: Feeds) -> DataFrame:
    return f.snapshot().filter(P.is_order() & P.has_valid_price()).select(
        "accountId", "instrumentId", "orderId", "marketValueUSD"
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT accountId, 'holding' AS dataset, count(*) AS n, {m('sum(position)', 'quantity')}
FROM holding_now GROUP BY 1
UNION ALL
SELECT accountId, 'cash', count(*), {m('sum(quantity)', 'quantity')}
FROM {O.newest('cash', 'accountId, ts')} GROUP BY 1
UNION ALL
SELECT accountId, 'order', count(*), {m('sum(orderQuantity)', 'quantity')}
FROM order_now GROUP BY 1"""
)
def account_lookup(f: Feeds) -> DataFrame:
    """What the current tables hold for each account."""
    def rows(dataset: str, df: DataFrame, quantity: str) -> DataFrame:
        return (
            latest(df, dataset)
            .groupBy("accountId", F.lit(dataset).alias("dataset"))
            .agg(F.count("*").alias("n"), F.sum(quantity).alias("quantity"))
        )
    return (
        rows("holding", f.holdings, "position")
        .unionByName(rows("cash", f.cash, "quantity"))
        .unionByName(rows("order", f.orders, "orderQuantity"))
    )


KEYS_SQL = """
SELECT 'holding' AS dataset, strftime(date, '%Y-%m-%d') || '#' || instrumentId || '#' || accountId
  AS rowKey FROM holding
UNION ALL SELECT 'order', orderId FROM order_event
UNION ALL SELECT 'price', instrumentId || '#' || strftime(priceTimestamp, '%Y-%m-%d') FROM tick
UNION ALL SELECT 'cash', strftime(date, '%Y-%m-%d') || '#' || instrumentId || '#' || accountId
FROM cash
UNION ALL SELECT 'account', accountId FROM account
UNION ALL SELECT 'instrument', instrumentId FROM instrument"""


def _keys(f: Feeds) -> DataFrame:
    tables = {
        "holding": f.holdings, "order": f.orders, "price": f.prices, "cash": f.cash,
        "account": f.accounts, "instrument": f.instruments,
    }
    parts = [
        df.select(F.lit(name).alias("dataset"), K.KEYS[name]().alias("rowKey"))
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(with_(O.BASE) + KEYS_SQL)
def composite_keys(f: Feeds) -> DataFrame:
    return _keys(f)


@query(
    with_(O.BASE)
    + f""", k AS ({KEYS_SQL})
SELECT DISTINCT dataset, rowKey, len(string_split(rowKey, '#')) AS parts,
       split_part(rowKey, '#', 1) AS firstPart FROM k"""
)
def parse_keys(f: Feeds) -> DataFrame:
    parts = K.split_key(F.col("rowKey"))
    return _keys(f).dropDuplicates().select(
        "dataset", "rowKey",
        F.size(parts).cast("bigint").alias("parts"), parts[0].alias("firstPart"),
    )


# Joins.


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT h.holdingId, h.accountId, h.instrumentId, {m('position')}, i.instrumentName,
       i.instrumentType, i.currency, i.sector
FROM holding_now h JOIN instrument_now i USING (instrumentId)"""
)
def enriched_holdings(f: Feeds) -> DataFrame:
    return positions.enriched_holdings(f.holdings, f.instruments).select(
        "holdingId", "accountId", "instrumentId", "position", "instrumentName", "instrumentType",
        "currency", "sector",
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT h.holdingId, i.instrumentName, {ts("time_bucket(INTERVAL '5 minutes', h.ts)",
       'windowStart')}, p.seq AS priceSequence, {m('p.price', 'price')},
       {m('p.price * h.position', 'marketValueUSD')}
FROM holding_now h JOIN instrument_now i USING (instrumentId) JOIN tick p
  ON p.instrumentId = h.instrumentId
  AND time_bucket(INTERVAL '5 minutes', p.ts) = time_bucket(INTERVAL '5 minutes', h.ts)"""
)
def holding_price_window_join(f: Feeds) -> DataFrame:
    held = positions.enriched_holdings(f.holdings, f.instruments)
    joined = positions.holdings_priced_in_window(held, f.prices, "5 minutes")
    return joined.select(
        "holdingId", "instrumentName", "windowStart", "priceSequence", "price", "marketValueUSD"
    )


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT orderId, {m('mv', 'marketValueUSD')}, {m('fmv', 'filledMarketValueUSD')}
FROM snap WHERE recordType = 'ORDER'"""
)
def order_mv(f: Feeds) -> DataFrame:
    return positions.order_market_values(f.orders, f.instruments, f.prices).select(
        "orderId", "marketValueUSD", "filledMarketValueUSD"
    )


@query(
    with_(O.BASE, O.STATE)
    + f""", wanted AS (SELECT instrumentId FROM instrument_now WHERE NOT {IS_CASH})
SELECT a.accountId, coalesce(n, 0) AS held, (SELECT count(*) FROM wanted) AS expected,
       (SELECT count(*) FROM wanted) - coalesce(n, 0) AS missing
FROM account a LEFT JOIN (
  SELECT accountId, count(DISTINCT instrumentId) AS n FROM holding
  WHERE instrumentId IN (SELECT instrumentId FROM wanted) GROUP BY 1) USING (accountId)"""
)
def holding_coverage_gaps(f: Feeds) -> DataFrame:
    return audit.holding_coverage(f.holdings, f.instruments, f.accounts)


@query(
    with_(O.BASE)
    + """
SELECT feed, count(*) AS n, count(DISTINCT instrumentId) AS instruments FROM (
  SELECT 'holding' AS feed, instrumentId FROM holding
  UNION ALL SELECT 'order', instrumentId FROM order_event
  UNION ALL SELECT 'instrument', instrumentId FROM instrument
  UNION ALL SELECT 'price', instrumentId FROM tick) GROUP BY 1"""
)
def tagged_union(f: Feeds) -> DataFrame:
    feeds = positions.union_feeds(
        holding=f.holdings, order=f.orders, instrument=f.instruments, price=f.prices
    )
    return feeds.groupBy("feed").agg(
        F.count("*").alias("n"), F.countDistinct("instrumentId").alias("instruments")
    )


@query(
    with_(O.BASE)
    + "SELECT DISTINCT instrumentId, accountId FROM holding UNION "
    + "SELECT DISTINCT instrumentId, accountId FROM order_event"
)
def distinct_rows(f: Feeds) -> DataFrame:
    pair = ["instrumentId", "accountId"]
    return f.holdings.select(*pair).unionByName(f.orders.select(*pair)).dropDuplicates()


# Audits and totals.


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT {m("sum(CASE WHEN recordType = 'HOLDING' THEN mv ELSE 0 END)", 'holdingValue')},
       {m("sum(CASE WHEN recordType = 'ORDER' THEN mv ELSE 0 END)", 'orderValue')},
       {m('sum(coalesce(fmv, 0))', 'filledValue')}, count(*) AS recordCount,
       count(DISTINCT instrumentType) AS instrumentTypes
FROM snap"""
)
def page_totals(f: Feeds) -> DataFrame:
    return audit.page_totals(f.snapshot())


COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, count(*) AS \"rows\" FROM {table}"
    for name, table in (
        ("account", "account"), ("instrument", "instrument_now"), ("price", "price_now"),
        ("holding", "holding_now"), ("order", "order_now"),
        ("cash", O.newest("cash", "accountId, ts")), ("unified", "snap"),
    )
)


def _counts(f: Feeds) -> DataFrame:
    tables = {
        name: latest(df, name)
        for name, df in (
            ("account", f.accounts), ("instrument", f.instruments), ("price", f.prices),
            ("holding", f.holdings), ("order", f.orders), ("cash", f.cash),
        )
    }
    return audit.dataset_counts({**tables, "unified": f.snapshot()})


@query(with_(O.BASE, O.STATE) + COUNTS)
def dataset_counts(f: Feeds) -> DataFrame:
    return _counts(f)


MINIMUM = {"account": 100, "instrument": 100, "holding": 10**12, "bonds": 1}


@query(
    with_(O.BASE, O.STATE)
    + f""", counts AS ({COUNTS}), expected(dataset, minimum) AS (
  VALUES {', '.join(f"('{name}', CAST({n} AS BIGINT))" for name, n in MINIMUM.items())})
SELECT e.dataset, coalesce("rows", 0) AS "rows", minimum,
       CASE WHEN coalesce("rows", 0) >= minimum THEN 'PASS' ELSE 'FAIL' END AS result
FROM expected e LEFT JOIN counts USING (dataset)"""
)
def expected_count_check(f: Feeds) -> DataFrame:
    return audit.expected_count_check(_counts(f), MINIMUM)


@query(
    with_(O.BASE, O.STATE)
    + 'SELECT recordType, count(*) AS "rows" FROM snap GROUP BY 1 '
    + "UNION ALL SELECT 'ALL', count(*) FROM snap"
)
def record_type_counts(f: Feeds) -> DataFrame:
    return audit.record_type_counts(f.snapshot())


def _consistency(source: str) -> str:
    return f"""
SELECT instrumentId, count(*) AS "rows",
       count(*) FILTER (price IS NULL OR priceTimestamp IS NULL) AS unpriced,
       count(DISTINCT (price, priceTimestamp)) = 1 AS isConsistent
FROM {source} GROUP BY 1"""


@query(with_(O.BASE, O.STATE) + _consistency("snap"))
def price_consistency_audit(f: Feeds) -> DataFrame:
    return audit.price_consistency(f.snapshot())


@query(with_(O.BASE, O.REPLAY, O.TABLE_NOW) + _consistency("table_now"))
def price_consistency_of_table(f: Feeds) -> DataFrame:
    """On the bare latest-value table leftovers show up as inconsistent instruments."""
    return audit.price_consistency(replay.latest_valued(*f.logs))


@query(
    with_(O.BASE)
    + f"""
SELECT accountId, instrumentId, movementType, {m('sum(quantity)', 'quantity')},
       count(*) AS movements FROM cash GROUP BY 1, 2, 3"""
)
def cash_summary(f: Feeds) -> DataFrame:
    return audit.cash_summary(f.cash, by_movement=True)


@query(
    with_(O.BASE)
    + f"""
SELECT 'price' AS dataset, instrumentId AS newestKey, {ts('ts', 'newestTime')}
FROM (SELECT * FROM tick ORDER BY ts DESC, seq DESC LIMIT 1)
UNION ALL SELECT 'order', orderId, {ts('ts', 'newestTime')}
FROM (SELECT * FROM order_event ORDER BY ts DESC, seq DESC LIMIT 1)"""
)
def freshness(f: Feeds) -> DataFrame:
    return audit.freshness(f.prices, f.orders)


@query(
    """SELECT 'base.price' AS topic, count(*) AS messages FROM events
UNION ALL SELECT 'ALL', count(*) FROM events"""
)
def topic_volume(f: Feeds) -> DataFrame:
    return audit.topic_volume(f.price_topic)


@query(
    with_(O.BASE)
    + f"""
SELECT instrumentId, strftime(ts, '%Y-%m-%d') AS day,
       {m('arg_max(price, (ts, seq))', 'closePrice')}, count(*) AS ticks
FROM tick GROUP BY 1, 2"""
)
def daily_close(f: Feeds) -> DataFrame:
    return daily_close_of(f.prices)


# Changes between two versions of a view.


def _view_at(suffix: str) -> str:
    return f"""
view{suffix} AS (
  SELECT * FROM (
    SELECT accountId || '#' || coalesce(currency, 'null') AS rowKey, {O.SOD} AS sodNavUSD,
           {O.CURRENT} AS currentNavUSD, {O.EXPECTED} AS expectedNavUSD, count(*) AS recordCount
    FROM snap{suffix} WHERE price > 0 GROUP BY accountId, currency)
  WHERE sodNavUSD <> 0 OR currentNavUSD <> 0 OR expectedNavUSD <> 0)"""


_SAME = " AND ".join(
    f"a.{n} IS NOT DISTINCT FROM b.{n}" for n in ("sodNavUSD", "currentNavUSD", "expectedNavUSD",
                                                  "recordCount")
)
TWO_VIEWS = with_(
    O.BASE,
    O.state("_a", f"ts <= TIMESTAMP '{EARLIER}'"),
    O.state("_b", f"ts <= TIMESTAMP '{LATER}'"),
    _view_at("_a"),
    _view_at("_b"),
    f"""
changed AS (
  SELECT coalesce(a.rowKey, b.rowKey) AS rowKey,
         CASE WHEN a.rowKey IS NULL THEN 'INSERT' WHEN b.rowKey IS NULL THEN 'DELETE'
              ELSE 'UPDATE' END AS changeType,
         a.sodNavUSD AS old_sod, b.sodNavUSD AS new_sod, a.currentNavUSD AS old_cur,
         b.currentNavUSD AS new_cur, a.expectedNavUSD AS old_ex, b.expectedNavUSD AS new_ex,
         a.recordCount AS old_recordCount, b.recordCount AS new_recordCount
  FROM view_a a FULL JOIN view_b b ON a.rowKey = b.rowKey
  WHERE a.rowKey IS NULL OR b.rowKey IS NULL OR NOT ({_SAME}))""",
)


def _two_views(f: Feeds) -> tuple[DataFrame, DataFrame]:
    request = ViewRequest(None, ("accountId", "currency"))
    return (
        overview.account_overview(f.until(EARLIER).snapshot(), request),
        overview.account_overview(f.until(LATER).snapshot(), request),
    )


@query(
    TWO_VIEWS
    + f"""
SELECT rowKey, changeType, {m('old_sod', 'old_sodNavUSD')}, {m('new_sod', 'new_sodNavUSD')},
       {m('old_cur', 'old_currentNavUSD')}, {m('new_cur', 'new_currentNavUSD')},
       {m('old_ex', 'old_expectedNavUSD')}, {m('new_ex', 'new_expectedNavUSD')},
       old_recordCount, new_recordCount FROM changed"""
)
def view_diff(f: Feeds) -> DataFrame:
    return changes.diff(*_two_views(f))


@query(
    TWO_VIEWS
    + f"""
SELECT rowKey, changeType, {m('old_sod', 'old_sodNavUSD')}, {m('new_sod', 'new_sodNavUSD')},
       old_recordCount, new_recordCount FROM changed"""
)
def composed_changes(f: Feeds) -> DataFrame:
    """The changes of three steps, sent as one: the same as the change from the first to the last view."""
    request = ViewRequest(None, ("accountId", "currency"))
    views = [
        overview.account_overview(f.until(moment).snapshot(), request)
        for moment in (EARLIER, *BETWEEN, LATER)
    ]
    steps = [
        changes.diff(old, new).withColumn("sequence", F.lit(i))
        for i, (old, new) in enumerate(zip(views, views[1:], strict=False))
    ]
    whole = steps[0].unionByName(steps[1]).unionByName(steps[2])
    return changes.compose(whole).select(
        "rowKey", "changeType", "old_sodNavUSD", "new_sodNavUSD", "old_recordCount",
        "new_recordCount",
    )


def _field(name: str, old: str, new: str, kind: str) -> str:
    return f"""
SELECT rowKey, '{name}' AS field, '{kind}' AS fieldType, {m(f'{new} - {old}', 'delta')},
       CASE WHEN '{name}' = 'recordCount' THEN 'changed' WHEN {new} > {old} THEN 'up'
            WHEN {new} < {old} THEN 'down' ELSE 'same' END AS direction
FROM changed WHERE changeType = 'UPDATE' AND {old} <> {new}"""


@query(
    TWO_VIEWS
    + " UNION ALL ".join(
        [
            _field("sodNavUSD", "old_sod", "new_sod", "DECIMAL"),
            _field("currentNavUSD", "old_cur", "new_cur", "DECIMAL"),
            _field("expectedNavUSD", "old_ex", "new_ex", "DECIMAL"),
            _field("recordCount", "old_recordCount", "new_recordCount", "INTEGER"),
        ]
    )
)
def field_changes(f: Feeds) -> DataFrame:
    rows = changes.field_changes(changes.diff(*_two_views(f)))
    return rows.select("rowKey", "field", "fieldType", "delta", "direction")


@query(
    TWO_VIEWS
    + """
SELECT rowKey, changeType,
       CASE WHEN changeType = 'UPDATE' THEN
         CAST(old_sod <> new_sod AS BIGINT) + CAST(old_cur <> new_cur AS BIGINT)
         + CAST(old_ex <> new_ex AS BIGINT) + CAST(old_recordCount <> new_recordCount AS BIGINT)
       END AS fields, changeType = 'INSERT' AS complete
FROM changed"""
)
def change_messages(f: Feeds) -> DataFrame:
    messages = changes.change_set(changes.diff(*_two_views(f)))
    return messages.select(
        "rowKey", "changeType",
        F.when(F.col("changedFields").isNotNull(), F.size("changedFields")).cast("bigint")
        .alias("fields"),
        F.col("completeRow").isNotNull().alias("complete"),
    )


HISTORY_DIRECTION = """
SELECT orderId, previousStatus AS oldValue, orderStatus AS newValue,
       CASE orderStatus WHEN 'FILLED' THEN 'up' WHEN 'CANCELLED' THEN 'down' ELSE 'changed' END
         AS direction
FROM history WHERE previousStatus IS NOT NULL AND previousStatus <> orderStatus"""


@query(with_(O.BASE, HISTORY) + HISTORY_DIRECTION)
def change_direction(f: Feeds) -> DataFrame:
    """Status changes of orders and their class."""
    steps = lifecycle.order_history(f.orders).select(
        "orderId", F.lit("orderStatus").alias("field"), F.col("previousStatus").alias("oldValue"),
        F.col("orderStatus").alias("newValue"),
    )
    return steps.filter(F.col("oldValue") != F.col("newValue")).select(
        "orderId", "oldValue", "newValue", changes.direction().alias("direction")
    )


@query(
    TWO_VIEWS
    + f"""
SELECT rowKey, {m('sodNavUSD')}, {m('currentNavUSD')}, {m('expectedNavUSD')}, recordCount
FROM view_b"""
)
def fold_changes(f: Feeds) -> DataFrame:
    """The earlier view as inserts, then its diff to the later one, folded: the later view."""
    old, new = _two_views(f)
    fields = list(changes.VIEW_FIELDS)
    nothing = old.limit(0)
    log = changes.as_log(changes.diff(nothing, old), 1).unionByName(
        changes.as_log(changes.diff(old, new), 2)
    )
    return changes.fold(log, fields)


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT {O.UNIFIED_KEY} AS unifiedKey, {m('mv', 'marketValueUSD')}
FROM snap WHERE instrumentId IN (
  SELECT instrumentId FROM tick WHERE ts > TIMESTAMP '{LATEST}')"""
)
def dirty_revaluation(f: Feeds) -> DataFrame:
    """Only positions of instruments that ticked in the last hours."""
    ticked = f.prices.filter(F.col("timestamp") > F.lit(LATEST).cast("timestamp_ntz"))
    current = positions.positions(latest(f.holdings, "holding"), latest(f.orders, "order"))
    return positions.revalue_changed(current, f.quotes, ticked).select(
        K.unified_key().alias("unifiedKey"), "marketValueUSD"
    )


# Sorting and paging.


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT * FROM ({O.overview("snap", {"accountName": O.NAME, "sector": "sector"})})
WHERE contains(lower(rowKey), 'promo') ORDER BY expectedNavUSD DESC NULLS LAST, rowKey
LIMIT 25 OFFSET 25"""
)
def view_page(f: Feeds) -> DataFrame:
    rows = account_overview(f).filter(
        paging.column_filter("rowKey", "text", "contains", "PROMO")
    )
    return paging.page(rows, [("expectedNavUSD", False)], "rowKey", number=1, size=25)


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT * FROM ({O.overview("snap", {"accountName": O.NAME, "sector": "sector"})})
ORDER BY sector ASC NULLS LAST, expectedNavUSD DESC NULLS LAST, rowKey LIMIT 25 OFFSET 25"""
)
def view_page_by_key(f: Feeds) -> DataFrame:
    """The second page, found by where the first one ends."""
    by = [("sector", True), ("expectedNavUSD", False)]
    rows = account_overview(f)
    first = paging.seek(rows, by, "rowKey", None, 25)
    return paging.seek(rows, by, "rowKey", paging.end_key(first, by, "rowKey"), 25)


@query(
    with_(O.BASE, O.STATE)
    + f"""
SELECT {O.UNIFIED_KEY} AS unifiedKey, {m('abs(orderQuantity)', 'quantity')}, orderType, venue,
       {day('date')}, {m('position')}
FROM snap WHERE mv > 100 AND (date IS NULL OR date > DATE '1996-01-01')"""
)
def display_rows(f: Feeds) -> DataFrame:
    """Columns of one kind of position are blank on the other; filters by number and date."""
    valued = f.snapshot().withColumn("unifiedKey", K.unified_key())
    big = paging.column_filter("marketValueUSD", "number", "greaterThan", 100)
    young = paging.column_filter("date", "date", "greaterThan", "1996-01-01")
    return valued.filter(big & (F.col("date").isNull() | young)).select(
        "unifiedKey",
        F.abs("orderQuantity").alias("quantity"),
        F.when(P.is_order(), F.col("orderType")).alias("orderType"),
        F.when(P.is_order(), F.col("venue")).alias("venue"),
        F.when(P.is_holding(), F.col("date")).alias("date"),
        F.when(P.is_holding(), F.col("position")).alias("position"),
    )


# Decoding.


@query(
    f"""
SELECT CAST(user_id AS VARCHAR) AS instrumentId,
       {ts('''CASE WHEN event_id % 20 IN (8, 9) THEN date_trunc('second', ts) ELSE ts END''',
           'date')},
       {m('CAST(value AS DECIMAL(18,6))', 'price')}, 'USD' AS currency,
       CASE event_id % 20 WHEN 14 THEN 'caf' || chr(65533) WHEN 15 THEN 'café'
            ELSE event_type END AS source, event_id AS sequence
FROM events WHERE event_id % 20 > 5"""
)
def parse_price_log(f: Feeds) -> DataFrame:
    return decode.read_dataset(f.price_topic, "price").select(
        "instrumentId", "date", "price", "currency", "source", "sequence"
    )


@query(
    """
SELECT 'base.price' AS topic, 'dlt.base-data' AS deadLetterTopic, event_id AS sequence,
       CASE event_id % 20 WHEN 0 THEN 'blank' WHEN 2 THEN 'blank' WHEN 1 THEN 'malformed'
            WHEN 5 THEN 'malformed' WHEN 3 THEN 'missing:instrumentId' ELSE 'missing:price' END
         AS reason
FROM events WHERE event_id % 20 <= 5"""
)
def quarantine(f: Feeds) -> DataFrame:
    bad = decode.quarantine(decode.parse(f.price_topic, "price"), "price")
    return bad.select("topic", "deadLetterTopic", "sequence", "reason")


@query(
    with_(O.BASE)
    + """
SELECT seq AS sequence, CASE WHEN seq % 3 = 0 THEN 'domain:orderStatus'
                             ELSE 'malformed:timestamp' END AS reason
FROM order_event WHERE seq % 3 < 2"""
)
def quarantine_orders(f: Feeds) -> DataFrame:
    """Order messages with a status that doesn't exist, or a time that can't be read."""
    third = F.col("offset") % 3
    text = F.col("value").cast("string")
    status = F.regexp_replace(text, '"orderStatus":"[A-Z_]*"', '"orderStatus":"PARTIAL"')
    time = F.regexp_replace(text, '"timestamp":"[^"]*"', '"timestamp":"rubbish"')
    damaged = F.when(third == 0, status).when(third == 1, time).otherwise(text)
    log = publish.as_log(f.orders, "order").withColumn("value", damaged.cast("binary"))
    bad = decode.quarantine(decode.parse(log, "order"), "order")
    return bad.select("sequence", "reason")


@query(
    with_(O.BASE)
    + f"""
SELECT orderId, instrumentId, accountId, {ts('date')}, {m('orderQuantity')},
       {m('coalesce(filledQuantity, 0)', 'filledQuantity')}, orderStatus, {m('orderPrice')},
       orderType, venue, {ts('ts', 'timestamp')} FROM order_event"""
)
def publish_round_trip(f: Feeds) -> DataFrame:
    """Order events written as topic records under their key, and read back."""
    records = publish.as_log(f.orders, "order")
    return decode.read_dataset(records, "order").drop("topicPartition", "sequence")


@query(
    with_(O.BASE, O.STATE)
    + f"SELECT {O.UNIFIED} FROM snap"
)
def unified_sink_round_trip(f: Feeds) -> DataFrame:
    """Valued rows written as topic records under their composite key, and read back."""
    records = publish.to_topic(positions.with_calculation_time(f.snapshot()), "unified").select(
        "key", "value", "topic", F.lit(0).alias("partition"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return decode.read_dataset(records, "unified").select(*positions.UNIFIED_COLUMNS)


@query(
    with_(O.BASE)
    + f"""
SELECT orderId, {m('orderQuantity')}, orderStatus, {ts('ts', 'timestamp')} FROM order_event"""
)
def repaired_orders(f: Feeds) -> DataFrame:
    """Damaged order messages go to the dead-letter topic, are repaired there, and come back once."""
    third = F.col("offset") % 3
    text = F.col("value").cast("string")
    status = F.regexp_replace(text, '"orderStatus":"', '"orderStatus":"X_')
    time = F.regexp_replace(text, '"timestamp":"', '"timestamp":"about ')
    damaged = F.when(third == 0, status).when(third == 1, time).otherwise(text)
    log = publish.as_log(f.orders, "order").withColumn("value", damaged.cast("binary"))
    letters = decode.opened(decode.dead_letters(log, "order"))
    mended = F.regexp_replace(F.regexp_replace(text, '"X_', '"'), '"about ', '"')
    repaired = letters.withColumn("value", mended.cast("binary"))
    sent_twice = repaired.unionByName(repaired.withColumn("sent", F.col("sent") + 1))
    orders = decode.read_dataset(decode.restored(log, sent_twice), "order")
    return orders.select("orderId", "orderQuantity", "orderStatus", "timestamp")
