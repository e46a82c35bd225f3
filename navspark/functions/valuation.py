"""Market values as column expressions.

Raw valuation multiplies price and quantity and takes the result as dollars. Typed
valuation follows the instrument type, rounds to cents and converts by currency.
Products are exact: DECIMAL(18,6) x DECIMAL(18,4) needs 37 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.schemas import PRICE, QUANTITY, RAW_MONEY, TYPED_MONEY, USD_RATES

BOND_FACE_VALUE = 100
RATE = "DECIMAL(16,10)"


def _typed(value: Column) -> Column:
    return value.cast(TYPED_MONEY)


def raw_value(price: Column, quantity: Column) -> Column:
    return (price.cast(PRICE) * quantity.cast(QUANTITY)).cast(RAW_MONEY)


def summed_value(price_sum: Column, quantity_sum: Column) -> Column:
    """Product of two sums, exact at every size that the amount itself can have.

    A product of two wide decimals would lose places, so the price is split at its point: both
    partial products keep all of theirs, and one digit is left free for their sum.
    """
    price, quantity = price_sum.cast("DECIMAL(28,6)"), quantity_sum.cast("DECIMAL(28,4)")
    whole = F.floor(price).cast("DECIMAL(22,0)")
    part = (price - whole).cast("DECIMAL(7,6)")
    return (
        (whole * quantity).cast("DECIMAL(37,10)") + (part * quantity).cast("DECIMAL(37,10)")
    ).cast(RAW_MONEY)


def raw_filled_value(price: Column, filled: Column) -> Column:
    return raw_value(price, F.coalesce(filled, F.lit(0)))


def bond_value(price: Column, quantity: Column, face: Column | None = None) -> Column:
    """Price per hundred, rounded to six places before it meets face and quantity."""
    face = F.lit(BOND_FACE_VALUE) if face is None else face
    fraction = F.round(price.cast(PRICE) * F.lit("0.01").cast("DECIMAL(3,2)"), 6)
    unit = (fraction.cast("DECIMAL(16,6)") * face.cast("DECIMAL(14,2)")).cast("DECIMAL(22,8)")
    amount = unit * quantity.cast(QUANTITY)
    return _typed(F.coalesce(F.round(amount, 2), F.lit(0)))


def typed_value(
    instrument_type: Column, price: Column, quantity: Column, face: Column | None = None
) -> Column:
    kind = F.upper(instrument_type)
    plain = F.round(price.cast(PRICE) * quantity.cast(QUANTITY), 2)
    zero = F.lit(0).cast(TYPED_MONEY)
    return (
        F.when(instrument_type.isNull() | quantity.isNull() | (quantity == 0), zero)
        .when(kind == "CURRENCY", _typed(F.round(quantity.cast(QUANTITY), 2)))
        .when(price.isNull(), zero)
        .when(kind == "BOND", bond_value(price, quantity, face))
        .otherwise(_typed(plain))
    )


def currency_code(currency: Column) -> Column:
    return F.trim(F.upper(currency))


def _is_blank(currency: Column) -> Column:
    return currency.isNull() | (F.trim(currency) == "")


def fixed_rate(currency: Column) -> Column:
    """Rate of a code in the fixed table; null if the code is not in it."""
    entries = []
    for code, rate in USD_RATES.items():
        entries += [F.lit(code), F.lit(rate).cast(RATE)]
    return F.try_element_at(F.create_map(*entries), currency_code(currency))


def rate_to_usd(currency: Column) -> Column:
    return F.coalesce(fixed_rate(currency), F.lit(1).cast(RATE))


def is_supported_currency(currency: Column) -> Column:
    return fixed_rate(currency).isNotNull()


def convert_to_usd(amount: Column, currency: Column, rate: Column | None = None) -> Column:
    """Amount in dollars to the cent. A blank code leaves it as it is; an unknown one is 1:1."""
    rate = rate_to_usd(currency) if rate is None else F.coalesce(rate, F.lit(1))
    converted = F.round(amount.cast("DECIMAL(28,6)") * rate.cast(RATE), 2)
    kept = amount.cast("DECIMAL(38,6)")
    return (
        F.when(amount.isNull() | (amount == 0), F.lit(0).cast("DECIMAL(38,6)"))
        .when(_is_blank(currency), kept)
        .otherwise(converted.cast("DECIMAL(38,6)"))
    )


def typed_usd_value(amount: Column, currency: Column, rate: Column | None = None) -> Column:
    """As ``convert_to_usd``, but the plain code USD in any case leaves the amount unrounded."""
    return (
        F.when(amount.isNull() | (amount == 0), F.lit(0).cast("DECIMAL(38,6)"))
        .when(F.upper(currency) == "USD", amount.cast("DECIMAL(38,6)"))
        .otherwise(convert_to_usd(amount, currency, rate))
    )


def with_rates(df: DataFrame, rates: DataFrame, currency: str = "currency") -> DataFrame:
    """Add ``rateToUSD`` from a table (currency, rate) in place of the fixed rates."""
    lookup = rates.select(
        currency_code(F.col("currency")).alias("_code"),
        F.col("rate").cast(RATE).alias("rateToUSD"),
    )
    keyed = df.withColumn("_code", currency_code(F.col(currency)))
    return keyed.join(lookup, "_code", "left").drop("_code")


def value_positions(
    df: DataFrame,
    mode: str = "raw",
    signed_fills: bool = False,
    rate: Column | None = None,
    face: Column | None = None,
) -> DataFrame:
    """Add the four market values to position rows that carry price and instrument.

    ``signed_fills`` gives the filled amount the sign of the order; by default a filled
    sell counts as a positive amount. ``face`` is the face value of a bond, 100 by default.
    """
    price = F.col("price")
    order = F.col("recordType") == "ORDER"
    quantity = F.when(order, F.col("orderQuantity")).otherwise(F.col("position"))
    filled = F.coalesce(F.col("filledQuantity"), F.lit(0).cast(QUANTITY))
    if signed_fills:
        filled = (filled * F.signum("orderQuantity").cast("DECIMAL(1,0)")).cast(QUANTITY)
    if mode == "raw":
        local, fill = raw_value(price, quantity), raw_filled_value(price, filled)
        usd, fill_usd = F.col("marketValueLocal"), F.col("filledMarketValueLocal")
    elif mode == "typed":
        kind, currency = F.col("instrumentType"), F.col("currency")
        local = typed_value(kind, price, quantity, face)
        fill = typed_value(kind, price, filled, face)
        usd = typed_usd_value(F.col("marketValueLocal"), currency, rate)
        fill_usd = typed_usd_value(F.col("filledMarketValueLocal"), currency, rate)
    else:
        raise ValueError(f"unknown valuation mode: {mode}")
    return (
        df.withColumn("marketValueLocal", local.cast(RAW_MONEY))
        .withColumn("filledMarketValueLocal", F.when(order, fill).cast(RAW_MONEY))
        .withColumn("marketValueUSD", usd.cast(RAW_MONEY))
        .withColumn("filledMarketValueUSD", F.when(order, fill_usd).cast(RAW_MONEY))
    )
