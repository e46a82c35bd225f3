"""Small hand-made feeds."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from navspark.schemas import schema_of

NOON = datetime(2024, 1, 15, 12)


def at(minute):
    return datetime(2024, 1, 15, 12) + timedelta(minutes=minute)


def frame(spark, dataset, rows):
    schema = schema_of(dataset).add("sequence", "long")
    blank = {name: None for name in schema.names}
    return spark.createDataFrame(
        [tuple({**blank, **row}[name] for name in schema.names) for row in rows], schema
    )


def holding(minute, position, account="ACC001", instrument="AAPL", day=15, sequence=None):
    return {
        "holdingId": f"H{minute}-{account}", "date": date(2024, 1, day), "instrumentId": instrument,
        "accountId": account, "timestamp": at(minute),
        "position": None if position is None else Decimal(position),
        "sequence": minute if sequence is None else sequence,
    }


def order(minute, quantity, filled=None, status="CREATED", order_id="O1", account="ACC001",
          instrument="AAPL"):
    return {
        "orderId": order_id, "instrumentId": instrument, "accountId": account, "date": at(minute),
        "orderQuantity": Decimal(quantity),
        "filledQuantity": None if filled is None else Decimal(filled),
        "orderStatus": status, "venue": "NYSE", "orderType": "LIMIT", "timestamp": at(minute),
        "sequence": minute,
    }


def instrument(minute, name="AAPL", sector="Technology", kind="EQUITY"):
    return {
        "instrumentId": name, "instrumentName": name + " Inc", "instrumentType": kind,
        "currency": "USD", "sector": sector, "subSectors": ["a", "b"], "timestamp": at(minute),
        "sequence": minute,
    }


def price(minute, value, name="AAPL"):
    return {
        "date": at(minute), "instrumentId": name, "price": Decimal(value), "currency": "USD",
        "source": "X", "timestamp": at(minute), "sequence": minute,
    }


def feeds(spark, holdings=(), orders=(), instruments=(), prices=()):
    return (
        frame(spark, "holding", holdings), frame(spark, "order", orders),
        frame(spark, "instrument", instruments), frame(spark, "price", prices),
    )
