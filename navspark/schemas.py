"""Record types of the engine.

Identifiers are text, quantities DECIMAL(18,4), prices DECIMAL(18,6). Times carry
no zone, so they are TIMESTAMP_NTZ and never depend on the session zone. Every
record of a feed has a ``sequence``: its arrival order, used to break ties.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

QUANTITY = "DECIMAL(18,4)"
PRICE = "DECIMAL(18,6)"
RAW_MONEY = "DECIMAL(38,10)"
TYPED_MONEY = "DECIMAL(38,2)"

ACCOUNT_FIELDS = "accountId STRING, accountName STRING, timestamp TIMESTAMP_NTZ"
INSTRUMENT_FIELDS = (
    "instrumentId STRING, instrumentName STRING, instrumentType STRING, currency STRING, "
    "countryOfRisk STRING, countryOfDomicile STRING, sector STRING, subSectors ARRAY<STRING>, "
    "timestamp TIMESTAMP_NTZ"
)
HOLDING_FIELDS = (
    "holdingId STRING, date DATE, instrumentId STRING, accountId STRING, "
    f"position {QUANTITY}, timestamp TIMESTAMP_NTZ"
)
PRICE_FIELDS = (
    f"date TIMESTAMP_NTZ, instrumentId STRING, price {PRICE}, currency STRING, "
    "source STRING, timestamp TIMESTAMP_NTZ"
)
ORDER_FIELDS = (
    "orderId STRING, instrumentId STRING, accountId STRING, date TIMESTAMP_NTZ, "
    f"orderQuantity {QUANTITY}, filledQuantity {QUANTITY}, orderStatus STRING, "
    f"orderPrice {PRICE}, orderType STRING, venue STRING, timestamp TIMESTAMP_NTZ"
)
CASH_FIELDS = (
    f"date TIMESTAMP_NTZ, instrumentId STRING, accountId STRING, quantity {QUANTITY}, "
    "movementType STRING, referenceId STRING, timestamp TIMESTAMP_NTZ"
)
UNIFIED_FIELDS = (
    "recordType STRING, instrumentId STRING, accountId STRING, timestamp TIMESTAMP_NTZ, "
    f"holdingId STRING, date DATE, position {QUANTITY}, "
    f"orderId STRING, orderQuantity {QUANTITY}, filledQuantity {QUANTITY}, orderStatus STRING, "
    f"orderPrice {PRICE}, orderType STRING, venue STRING, "
    "instrumentName STRING, instrumentType STRING, currency STRING, countryOfRisk STRING, "
    "countryOfDomicile STRING, sector STRING, subSectors ARRAY<STRING>, "
    f"price {PRICE}, priceCurrency STRING, priceSource STRING, priceTimestamp TIMESTAMP_NTZ, "
    f"marketValueLocal {RAW_MONEY}, marketValueUSD {RAW_MONEY}, "
    f"filledMarketValueLocal {RAW_MONEY}, filledMarketValueUSD {RAW_MONEY}, "
    "calculationTimestamp TIMESTAMP_NTZ"
)
TOPIC_FIELDS = (
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
)

FIELDS = {
    "account": ACCOUNT_FIELDS,
    "instrument": INSTRUMENT_FIELDS,
    "holding": HOLDING_FIELDS,
    "price": PRICE_FIELDS,
    "order": ORDER_FIELDS,
    "cash": CASH_FIELDS,
    "unified": UNIFIED_FIELDS,
}


def columns_of(dataset: str) -> list[str]:
    return [field.split(" ")[0] for field in FIELDS[dataset].split(", ")]


def schema_of(dataset: str) -> StructType:
    return StructType.fromDDL(FIELDS[dataset])


# Topic of each dataset, and where its bad records go.
TOPICS = {
    "account": "base.account",
    "instrument": "base.instrument",
    "holding": "base.sod-holding",
    "price": "base.price",
    "order": "base.order-events",
    "cash": "base.intraday-cash",
    "unified": "aggregation.unified-mv",
}
DEAD_LETTER_TOPICS = {
    "account": "dlt.base-data",
    "instrument": "dlt.base-data",
    "holding": "dlt.base-data",
    "price": "dlt.base-data",
    "order": "dlt.base-data",
    "cash": "dlt.base-data",
    "unified": "dlt.aggregation",
}

# Domains.
ORDER_STATUSES = ("CREATED", "PARTIALLY_FILLED", "FILLED", "CANCELLED", "REJECTED")
WORKING_STATUSES = ("CREATED", "PARTIALLY_FILLED")
TERMINAL_STATUSES = ("FILLED", "CANCELLED", "REJECTED")
INSTRUMENT_TYPES = ("EQUITY", "BOND", "CURRENCY", "FUND")
MOVEMENT_TYPES = (
    "DIVIDEND", "TRADE_SETTLEMENT", "SUBSCRIPTION", "REDEMPTION", "FEE", "INTEREST",
)

# Units of each currency in US dollars.
USD_RATES = {
    "USD": "1.0000",
    "EUR": "1.0850",
    "GBP": "1.2650",
    "JPY": "0.0067",
    "CHF": "1.1200",
    "CAD": "0.7350",
    "AUD": "0.6580",
}

# How long the latest row of a key stays live, in hours.
LIVE_HOURS = {
    "account": 720,
    "instrument": 720,
    "price": 24,
    "order": 24,
    "holding": 168,
    "cash": 168,
    "unified": 168,
}
