"""Worked values of valuation, conversion, keys, predicates and requests."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from navspark.functions import keys as K
from navspark.functions import predicates as P
from navspark.functions import valuation as V
from navspark.plans.request import ALL_EXPOSURES, GROUP_FIELDS, Exposure, ViewRequest


def one(spark, ddl, values, *columns):
    return spark.createDataFrame([values], ddl).select(*columns).first()


def dec(text):
    return None if text is None else Decimal(text)


@pytest.mark.parametrize(
    ("kind", "price", "quantity", "face", "expected"),
    [
        ("EQUITY", "150", "100", None, "15000.00"),
        ("equity", "150", "50", None, "7500.00"),
        ("FUND", "0.005", "1", None, "0.01"),
        ("BOND", "98.50", "10", None, "985.00"),
        ("BOND", "98.123456", "1000", None, "98123.50"),
        ("BOND", "98.50", "10", 1000, "9850.00"),
        ("CURRENCY", None, "250.005", None, "250.01"),
        ("CURRENCY", "3", "250.005", None, "250.01"),
        ("SWAP", "1.115", "3", None, "3.35"),
        (None, "150", "100", None, "0"),
        ("EQUITY", None, "100", None, "0"),
        ("BOND", None, "100", None, "0"),
        ("EQUITY", "150", None, None, "0"),
        ("EQUITY", "150", "0", None, "0"),
        ("EQUITY", "300", "-10", None, "-3000.00"),
    ],
)
def test_typed_value(spark, kind, price, quantity, face, expected):
    face_column = None if face is None else F.lit(face)
    value = V.typed_value(F.col("k"), F.col("p"), F.col("q"), face_column)
    row = one(
        spark, "k STRING, p DECIMAL(18,6), q DECIMAL(18,4)", (kind, dec(price), dec(quantity)),
        value,
    )
    assert row[0] == Decimal(expected)


def test_raw_value_is_exact(spark):
    row = one(
        spark, "p DECIMAL(18,6), q DECIMAL(18,4), f DECIMAL(18,4)",
        (dec("151.123456"), dec("100.0001"), None),
        V.raw_value(F.col("p"), F.col("q")), V.raw_filled_value(F.col("p"), F.col("f")),
    )
    assert row[0] == Decimal("151.123456") * Decimal("100.0001")
    assert row[1] == 0


@pytest.mark.parametrize(
    ("amount", "currency", "converted", "usd_value"),
    [
        ("100", " eur ", "108.50", "108.50"),
        ("1000", "JPY", "6.70", "6.70"),
        ("10.005", "XXX", "10.01", "10.01"),
        ("10.005", "  ", "10.005", "10.005"),
        ("10.005", None, "10.005", "10.005"),
        ("10.005", "usd", "10.01", "10.005"),
        ("10.005", " USD", "10.01", "10.01"),
        ("0", "EUR", "0", "0"),
        (None, "EUR", "0", "0"),
    ],
)
def test_conversion(spark, amount, currency, converted, usd_value):
    row = one(
        spark, "a DECIMAL(18,4), c STRING", (dec(amount), currency),
        V.convert_to_usd(F.col("a"), F.col("c")), V.typed_usd_value(F.col("a"), F.col("c")),
    )
    assert tuple(row) == (Decimal(converted), Decimal(usd_value))


def test_rate_lookup(spark):
    df = spark.createDataFrame([("gbp",), ("XXX",), (" ",), (None,)], "c STRING")
    rows = df.select(V.rate_to_usd(F.col("c")), V.is_supported_currency(F.col("c"))).collect()
    assert [r[0] for r in rows] == [Decimal("1.2650"), 1, 1, 1]
    assert [r[1] for r in rows] == [True, False, False, False]


def test_signed_fills(spark):
    ddl = (
        "recordType STRING, price DECIMAL(18,6), position DECIMAL(18,4), "
        "orderQuantity DECIMAL(18,4), filledQuantity DECIMAL(18,4)"
    )
    df = spark.createDataFrame([("ORDER", dec("2"), None, dec("-10"), dec("4"))], ddl)
    as_is = V.value_positions(df).first()
    signed = V.value_positions(df, signed_fills=True).first()
    assert (as_is.marketValueUSD, as_is.filledMarketValueUSD) == (-20, 8)
    assert signed.filledMarketValueUSD == -8
    with pytest.raises(ValueError):
        V.value_positions(df, "other")


def test_keys(spark):
    ddl = "recordType STRING, date DATE, instrumentId STRING, accountId STRING, orderId STRING"
    df = spark.createDataFrame(
        [
            ("HOLDING", None, "INST001", "ACC001", None),
            ("ORDER", None, "INST001", "ACC001", "ORD_123"),
            ("OTHER", None, "INST001", "ACC001", None),
            (None, None, "INST001", "ACC001", None),
        ],
        ddl,
    )
    assert [r[0] for r in df.select(K.unified_key()).collect()] == [
        "HOLDING#null#INST001#ACC001", "ORDER#ORD_123", "UNKNOWN#INST001#ACC001",
        "UNKNOWN#INST001#ACC001",
    ]
    dated = df.withColumn("date", F.lit("2024-01-15 10:30:00").cast("timestamp_ntz")).limit(1)
    row = dated.select(K.holding_key(), K.price_key(), K.cash_key(), K.split_key(K.price_key()))
    assert tuple(row.first()) == (
        "2024-01-15#INST001#ACC001", "INST001#2024-01-15", "2024-01-15#INST001#ACC001",
        ["INST001", "2024-01-15"],
    )


def test_predicates(spark):
    df = spark.createDataFrame(
        [
            ("HOLDING", dec("5"), None, None, "Cash", "EQUITY"),
            ("ORDER", None, dec("-10"), dec("10"), "x", "currency"),
            ("ORDER", None, dec("0"), None, None, None),
            ("OTHER", dec("1"), dec("1"), None, "CASH", None),
        ],
        "recordType STRING, position DECIMAL(18,4), orderQuantity DECIMAL(18,4), "
        "filledQuantity DECIMAL(18,4), sector STRING, instrumentType STRING",
    )
    rows = df.select(
        P.side(), P.unified_remaining_quantity(), P.completely_filled(), P.is_cash(),
        P.quantity_for_calculation(),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (None, 0, None, True, 5),
        ("SELL", 0, True, True, -10),
        (None, 0, None, False, 0),
        ("BUY", 0, None, True, 0),
    ]


def test_market_value_pick(spark):
    df = spark.createDataFrame(
        [("HOLDING", 1, 2, None, None), ("ORDER", 3, 4, 5, 6), ("ORDER", 3, 4, None, None)],
        "recordType STRING, marketValueLocal INT, marketValueUSD INT, filledMarketValueLocal INT, "
        "filledMarketValueUSD INT",
    )
    rows = df.select(
        P.pick_market_value("USD"), P.pick_market_value("usd", "FILLED"),
        P.pick_market_value("EUR"), P.pick_market_value("LOCAL", "filled"),
    ).collect()
    assert [tuple(r) for r in rows] == [(2, 2, 1, 1), (4, 6, 3, 5), (4, None, 3, None)]


def test_request_rules():
    with pytest.raises(ValueError):
        ViewRequest(()).validate()
    with pytest.raises(ValueError):
        ViewRequest(("A",), ()).validate()
    with pytest.raises(ValueError):
        ViewRequest(("A",), ("sector",), ()).validate()
    request = ViewRequest(("B", "A"), ("SECTOR", "accountname"), (Exposure.CURRENT, Exposure.SOD))
    assert request.validate().fields == ("sector", "accountName")
    assert request.with_account_first.fields == ("accountName", "sector")
    assert request.configuration_key == (
        "accounts:A,B|groupBy:sector,accountName|exposures:[SOD, CURRENT]"
    )
    assert len(GROUP_FIELDS) == 10
    assert [e.column for e in ALL_EXPOSURES] == ["sodNavUSD", "currentNavUSD", "expectedNavUSD"]


def test_value_of_large_sums_is_exact(spark):
    """Sums far beyond single prices and quantities keep all ten places."""
    from decimal import Decimal, localcontext

    from navspark.functions.valuation import summed_value

    cases = [
        ("1.500000", "2.2500"), ("123456789012.345679", "98765432.1234"), ("-0.000001", "0.0001"),
        ("9999999999999.999999", "-12345678.9876"), ("-123456789012.345679", "98765432.1234"),
        ("0.999999", "9999999999999999.9999"), ("1000000000000000.000001", "100000000.0001"), ("0", "5"),
    ]
    rows = [(Decimal(p), Decimal(q)) for p, q in cases]
    df = spark.createDataFrame(rows, "p DECIMAL(38,6), q DECIMAL(38,4)")
    found = [r[0] for r in df.select(summed_value(F.col("p"), F.col("q"))).collect()]
    with localcontext() as c:
        c.prec = 60
        assert found == [p * q for p, q in rows]
