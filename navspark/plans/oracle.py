"""The same queries as SQL over the given tables, for a second engine to run."""

from __future__ import annotations

from navspark.schemas import USD_RATES
from navspark.sources.bridge import CURRENCIES, KINDS, MOVEMENTS, ORDER_TYPES, VENUES


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


def m(expression: str, name: str = "") -> str:
    return f"CAST(round({expression}, 4) AS DOUBLE) AS {name or expression}"


def ts(expression: str, name: str = "") -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expression}"


def day(expression: str, name: str = "") -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {name or expression}"


_DAYS = "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"
_LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_SIGNED = "CAST(l_quantity * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS DECIMAL(18,4))"
_MOVEMENT = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in MOVEMENTS.items())
_RATES = ", ".join(f"('{c}', CAST({r} AS DECIMAL(10,4)))" for c, r in USD_RATES.items())

BASE = f"""
account AS (
  SELECT CAST(c_custkey AS VARCHAR) AS accountId, c_name AS accountName,
         TIMESTAMP '2024-01-01 00:00:00' AS ts, c_custkey AS seq
  FROM customer),
instrument AS (
  SELECT CAST(p_partkey AS VARCHAR) AS instrumentId, p_name AS instrumentName,
         {_list(KINDS)}[CAST(p_partkey % {len(KINDS)} AS INTEGER) + 1] AS instrumentType,
         {_list(CURRENCIES)}[CAST(p_size % {len(CURRENCIES)} AS INTEGER) + 1] AS currency,
         'NATION_' || CAST(p_partkey % 25 AS VARCHAR) AS countryOfRisk,
         'NATION_' || CAST(p_size % 25 AS VARCHAR) AS countryOfDomicile,
         CASE WHEN p_partkey % 50 = 4 THEN 'Cash' WHEN p_partkey % 50 <> 7 THEN p_type END
           || CASE WHEN v.n = 1 THEN '-R' ELSE '' END AS sector,
         p_name AS subSectors,
         CASE WHEN v.n = 1 THEN TIMESTAMP '2024-01-15 12:00:00'
              WHEN p_partkey % 10 = 0 THEN TIMESTAMP '2024-01-05 00:00:00'
              ELSE TIMESTAMP '2023-12-31 00:00:00' END AS ts,
         v.n AS seq
  FROM part, (VALUES (0), (1)) v(n)
  WHERE v.n = 0 OR p_partkey % 4 = 0),
price_feed AS (
  SELECT CAST(user_id AS VARCHAR) AS instrumentId, ts AS priceTimestamp,
         CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN CAST(0 AS DECIMAL(18,6))
              WHEN event_type = 'error' AND event_id % 10 = 1 THEN NULL
              ELSE CAST(value AS DECIMAL(18,6)) END AS price,
         {_list(CURRENCIES)}[CAST(user_id % {len(CURRENCIES)} AS INTEGER) + 1] AS priceCurrency,
         event_type AS priceSource, ts, event_id AS seq
  FROM events),
tick AS (SELECT * FROM price_feed WHERE price IS NOT NULL),
line AS (
  SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_orderpriority, {_LINE} AS line, {_DAYS} AS days,
         {_SIGNED} AS signed
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
holding AS (
  SELECT 'H-' || line AS holdingId, CAST(l_shipdate AS DATE) AS date,
         CAST(l_partkey AS VARCHAR) AS instrumentId, CAST(o_custkey AS VARCHAR) AS accountId,
         signed AS position,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((days % 30) * 1440 + l_orderkey % 1440
           AS INTEGER)) AS ts,
         ((l_orderkey * 10 + l_linenumber) * 10000 + days) * 10 AS seq
  FROM line WHERE l_linestatus = 'F'),
life AS (
  SELECT *, CASE
      WHEN o_orderstatus = 'F' AND l_linenumber = 7
        THEN ['CREATED', 'PARTIALLY_FILLED', 'FILLED', 'PARTIALLY_FILLED']
      WHEN o_orderstatus = 'F' THEN ['CREATED', 'PARTIALLY_FILLED', 'FILLED']
      WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
        THEN ['CREATED', 'PARTIALLY_FILLED', 'CANCELLED']
      WHEN o_orderstatus = 'P' THEN ['CREATED', 'PARTIALLY_FILLED']
      WHEN o_orderpriority = '5-LOW' THEN ['CREATED', 'CANCELLED']
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ['CREATED', 'REJECTED']
      ELSE ['CREATED'] END AS steps
  FROM line WHERE l_linestatus = 'O'),
step AS (
  SELECT life.*, s.n AS step, steps[s.n + 1] AS orderStatus
  FROM life, (VALUES (0), (1), (2), (3)) s(n) WHERE s.n < len(steps)),
order_event AS (
  SELECT 'O-' || line AS orderId, CAST(l_partkey AS VARCHAR) AS instrumentId,
         CAST(o_custkey AS VARCHAR) AS accountId, l_shipdate AS date, signed AS orderQuantity,
         CAST(CASE WHEN orderStatus = 'FILLED'
                     THEN l_quantity + CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END
                   WHEN orderStatus = 'PARTIALLY_FILLED' THEN floor(l_quantity / 2)
                   WHEN orderStatus = 'CANCELLED' AND o_orderstatus = 'P'
                     THEN floor(l_quantity / 2)
                   WHEN orderStatus = 'CREATED' AND l_suppkey % 10 = 0 THEN NULL
                   ELSE 0 END AS DECIMAL(18,4)) AS filledQuantity,
         orderStatus, CAST(l_partkey % 1000 + 900 AS DECIMAL(18,6)) AS orderPrice,
         {_list(ORDER_TYPES)}[CAST(l_linenumber % 3 AS INTEGER) + 1] AS orderType,
         {_list(VENUES)}[CAST(l_suppkey % 4 AS INTEGER) + 1] AS venue,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((days % 30) * 1440 + l_orderkey % 1440
           + step * 360 AS INTEGER)) AS ts,
         ((l_orderkey * 10 + l_linenumber) * 10000 + days) * 10 + step AS seq
  FROM step),
cash AS (
  SELECT date_trunc('day', ts) AS date,
         {_list(CURRENCIES[:7])}[CAST(event_id % 7 AS INTEGER) + 1] AS instrumentId,
         CAST(user_id AS VARCHAR) AS accountId,
         CAST(value * CASE WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 1 END
           AS DECIMAL(18,4)) AS quantity,
         CASE event_type {_MOVEMENT} END AS movementType,
         'REF-' || CAST(event_id AS VARCHAR) AS referenceId,
         date_trunc('day', ts) AS ts, event_id AS seq
  FROM events),
rate AS (SELECT * FROM (VALUES {_RATES}) r(code, rate))"""


def newest(source: str, keys: str, order: str = "ts DESC, seq DESC") -> str:
    return (
        f"(SELECT * FROM {source} QUALIFY row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY {order}) = 1)"
    )


def state(suffix: str = "", condition: str = "TRUE") -> str:
    """Latest tables and the valued snapshot, of all rows or of those that meet a condition."""
    def past(name: str) -> str:
        return f"(SELECT * FROM {name} WHERE {condition})"
    return f"""
holding_now{suffix} AS {newest(past('holding') + ' t', 'instrumentId, accountId')},
order_now{suffix} AS {newest(past('order_event') + ' t', 'orderId')},
instrument_now{suffix} AS {newest(past('instrument') + ' t', 'instrumentId')},
price_now{suffix} AS {newest(past('tick') + ' t', 'instrumentId')},
quote{suffix} AS (
  SELECT i.* EXCLUDE (ts, seq), p.price, p.priceCurrency, p.priceSource, p.priceTimestamp
  FROM instrument_now{suffix} i JOIN price_now{suffix} p USING (instrumentId)),
position_now{suffix} AS (
  SELECT 'HOLDING' AS recordType, * FROM holding_now{suffix}
  UNION ALL BY NAME
  SELECT 'ORDER' AS recordType, * EXCLUDE (date) FROM order_now{suffix}),
snap{suffix} AS (
  SELECT p.*, q.* EXCLUDE (instrumentId),
         price * CASE WHEN recordType = 'HOLDING' THEN position ELSE orderQuantity END AS mv,
         CASE WHEN recordType = 'ORDER' THEN price * coalesce(filledQuantity, 0) END AS fmv
  FROM position_now{suffix} p JOIN quote{suffix} q USING (instrumentId))"""


STATE = state()

REPLAY = """
holding_version AS (
  SELECT *, ts AS vf, lead(ts) OVER (PARTITION BY instrumentId, accountId ORDER BY ts, seq) AS vt
  FROM holding),
order_version AS (
  SELECT * EXCLUDE (date), ts AS vf, lead(ts) OVER (PARTITION BY orderId ORDER BY ts, seq) AS vt
  FROM order_event),
instrument_version AS (
  SELECT * EXCLUDE (ts, seq), ts AS ivf,
         lead(ts) OVER (PARTITION BY instrumentId ORDER BY ts, seq) AS ivt
  FROM instrument),
version AS (
  SELECT 'HOLDING' AS recordType, * FROM holding_version
  UNION ALL BY NAME SELECT 'ORDER' AS recordType, * FROM order_version),
known_tick AS (
  SELECT t.* EXCLUDE (ts, seq), t.ts AS tickTime, t.seq AS tickSequence,
         i.* EXCLUDE (instrumentId, ivf, ivt)
  FROM tick t JOIN instrument_version i ON t.instrumentId = i.instrumentId
    AND i.ivf <= t.ts AND (i.ivt IS NULL OR t.ts < i.ivt)),
log AS (
  SELECT v.*, t.* EXCLUDE (instrumentId),
         price * CASE WHEN recordType = 'HOLDING' THEN position ELSE orderQuantity END AS mv,
         CASE WHEN recordType = 'ORDER' THEN price * coalesce(filledQuantity, 0) END AS fmv
  FROM version v JOIN known_tick t ON v.instrumentId = t.instrumentId
    AND v.vf <= t.tickTime AND (v.vt IS NULL OR t.tickTime < v.vt))"""

UNIFIED_KEY = (
    "CASE WHEN recordType = 'HOLDING' THEN 'HOLDING#' || strftime(date, '%Y-%m-%d') || '#' "
    "|| instrumentId || '#' || accountId ELSE 'ORDER#' || orderId END"
)
TABLE_NOW = f"""
table_now AS (
  SELECT *, {UNIFIED_KEY} AS unifiedKey FROM log
  QUALIFY row_number() OVER (PARTITION BY {UNIFIED_KEY}
                             ORDER BY tickTime DESC, tickSequence DESC) = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


SOD = "sum(CASE WHEN recordType = 'HOLDING' THEN mv ELSE 0 END)"
CURRENT = "sum(CASE WHEN recordType = 'HOLDING' THEN mv ELSE fmv END)"
EXPECTED = "sum(mv)"


def overview(
    source: str,
    fields: dict[str, str],
    navs: tuple[str, ...] = ("sodNavUSD", "currentNavUSD", "expectedNavUSD"),
    price_time: bool = True,
    where: str = "TRUE",
    name_join: bool = True,
) -> str:
    """Overview of a valued relation; ``fields`` maps output names to expressions."""
    exprs = {"sodNavUSD": SOD, "currentNavUSD": CURRENT, "expectedNavUSD": EXPECTED}
    columns = ", ".join(f"{expr} AS {name}" for name, expr in fields.items())
    key = " || '#' || ".join(f"coalesce({name}, 'null')" for name in fields)
    names = ", ".join(fields)
    time = ", " + ts("priceTime", "priceTimestamp") if price_time else ""
    join = "LEFT JOIN account a ON a.accountId = s.accountId" if name_join else ""
    return f"""
SELECT 'view' AS viewId, {key} AS rowKey, {names}, {', '.join(m(n) for n in navs)}{time},
       recordCount
FROM (SELECT {columns}, {', '.join(f'{e} AS {n}' for n, e in exprs.items())},
             count(*) AS recordCount, max(priceTimestamp) AS priceTime
      FROM {source} s {join}
      WHERE price > 0 AND {where} GROUP BY ALL)
WHERE sodNavUSD <> 0 OR currentNavUSD <> 0 OR expectedNavUSD <> 0"""


NAME = "coalesce(a.accountName, s.accountId)"
ON_ORDERS = {
    name: f"CASE WHEN recordType = 'ORDER' THEN {name} END"
    for name in ("orderStatus", "orderType", "venue")
}
UNIFIED = f"""recordType, instrumentId, accountId, {ts('ts', 'timestamp')}, holdingId, {day('date')},
  {m('position')}, orderId, {m('orderQuantity')}, {m('filledQuantity')}, orderStatus,
  {m('orderPrice')}, orderType, venue, instrumentName, instrumentType, currency, countryOfRisk,
  countryOfDomicile, sector, subSectors, {m('price')}, priceCurrency, priceSource,
  {ts('priceTimestamp')}, {m('mv', 'marketValueLocal')}, {m('mv', 'marketValueUSD')},
  {m('fmv', 'filledMarketValueLocal')}, {m('fmv', 'filledMarketValueUSD')}"""
