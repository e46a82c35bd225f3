"""Account overviews: start-of-day, current and expected net asset value per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.functions.keys import join_key
from navspark.functions.predicates import (
    has_any_nav,
    has_valid_price,
    in_accounts,
    is_holding,
    is_order,
)
from navspark.functions.valuation import summed_value
from navspark.operators import skew
from navspark.operators.positions import INSTRUMENT_COLUMNS
from navspark.operators.replay import BY_INSTRUMENT, known_ticks, position_versions, ticked_positions
from navspark.plans.request import ViewRequest, field_column
from navspark.schemas import QUANTITY, RAW_MONEY

NAVS = ("sodNavUSD", "currentNavUSD", "expectedNavUSD")
ORDER_FIELDS = ("orderStatus", "orderType", "venue")


def _money(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast(RAW_MONEY)


def contributions(
    exclude_statuses: Sequence[str] = (), include_statuses: Sequence[str] | None = None
) -> dict[str, Column]:
    """What one valued row adds to each NAV.

    A holding counts in all three. An order adds its filled value to current and its full
    value to expected NAV, whatever its status, unless statuses are excluded.
    """
    held = F.when(is_holding(), F.col("marketValueUSD"))
    counted = is_order()
    if exclude_statuses:
        counted = counted & ~F.col("orderStatus").isin(*exclude_statuses)
    if include_statuses is not None:
        counted = counted & F.col("orderStatus").isin(*include_statuses)
    filled = F.when(counted, F.col("filledMarketValueUSD"))
    full = F.when(counted, F.col("marketValueUSD"))
    return {
        "sodNavUSD": _money(held),
        "currentNavUSD": _money(F.coalesce(held, filled)),
        "expectedNavUSD": _money(F.coalesce(held, full)),
    }


def _named_accounts(df: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """Account name by id, the id itself where the name is unknown or no table is given."""
    if accounts is None:
        return df.withColumn("accountName", F.col("accountId"))
    names = accounts.select("accountId", F.col("accountName").alias("_name"))
    return (
        df.join(names, "accountId", "left")
        .withColumn("accountName", F.coalesce("_name", "accountId"))
        .drop("_name")
    )


def _group_columns(request: ViewRequest) -> list[Column]:
    """Grouping columns of the first aggregation; names are resolved after it."""
    columns = []
    for name in request.fields:
        if name == "accountName":
            continue
        columns.append(field_column(name).alias(name))
    if "accountName" in request.fields and "accountId" not in request.fields:
        columns.append(F.col("accountId"))
    return columns


def _finish(
    sums: DataFrame,
    request: ViewRequest,
    accounts: DataFrame | None,
    carried: Sequence[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """Resolve account names on the small result, drop empty rows, add key and field map."""
    fields = list(request.fields)
    if "accountName" in fields:
        sums = _named_accounts(sums, accounts)
        if "accountId" not in fields and accounts is not None:
            # Two accounts of one name are one row.
            sums = sums.groupBy(*fields).agg(
                *[F.sum(nav).cast(RAW_MONEY).alias(nav) for nav in NAVS],
                F.sum("recordCount").alias("recordCount"),
                *[F.max(name).alias(name) for name in carried],
            )
    rows = sums if keep_empty else sums.filter(has_any_nav())
    pairs = [x for name in fields for x in (F.lit(name), F.col(name).cast("string"))]
    shown = [e.column for e in request.exposures]
    return rows.select(
        F.lit(request.view_id).alias("viewId"),
        join_key([F.col(name) for name in fields]).alias("rowKey"),
        *fields,
        F.create_map(*pairs).alias("groupingFields"),
        *[nav for nav in NAVS if nav in shown],
        *carried,
        "recordCount",
    )


def account_overview(
    valued: DataFrame,
    request: ViewRequest,
    accounts: DataFrame | None = None,
    exclude_statuses: Sequence[str] = (),
    last_instrument_by: Sequence[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """Overview of latest-state valued rows.

    Groups by the field values themselves; the row key is derived afterwards, so values that
    hold the separator do not merge. ``accounts`` resolves account names, without it the name
    is the id. ``last_instrument_by`` names the arrival order that picks the last instrument
    name of a group. All three NAVs decide whether a row is empty; only the requested
    exposures are returned.
    """
    request.validate()
    rows = valued.filter(in_accounts(request.accounts)).filter(has_valid_price())
    parts = contributions(exclude_statuses)
    measures = [F.sum(parts[nav]).cast(RAW_MONEY).alias(nav) for nav in NAVS]
    measures += [
        F.count("*").alias("recordCount"),
        F.max("priceTimestamp").alias("priceTimestamp"),
    ]
    carried = ["priceTimestamp"]
    if "calculationTimestamp" in valued.columns:
        measures.append(F.max("calculationTimestamp").alias("lastUpdated"))
        carried.append("lastUpdated")
    if last_instrument_by:
        newest = F.max(F.struct(*last_instrument_by, "instrumentName"))
        measures.append(newest.getField("instrumentName").alias("lastInstrumentName"))
        carried.append("lastInstrumentName")
    sums = rows.groupBy(*_group_columns(request)).agg(*measures)
    return _finish(sums, request, accounts, carried, keep_empty)


def cumulative_overview(
    event_log: DataFrame,
    request: ViewRequest,
    accounts: DataFrame | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Overview that adds every message of a valued event log, re-valuations included.

    A changelog needs ``keep_empty``: the row of a group that returns to zero replaces the last
    one, and readers drop empty rows.
    """
    return account_overview(event_log, request, accounts, keep_empty=keep_empty)


def cumulative_from_versions(
    holdings: DataFrame,
    orders: DataFrame,
    instruments: DataFrame,
    prices: DataFrame,
    request: ViewRequest,
    accounts: DataFrame | None = None,
    tie_breakers: Sequence[str] = ("sequence",),
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """``cumulative_overview`` of the replayed log, without building the log.

    A version that is live on [from, to) adds its quantity times the prices that tick in that
    interval, which is S(from) - S(to) with S the sum of the prices from a time on. So each
    version becomes a plus and a minus entry. The ticks of an instrument fall into eras, runs with
    equal grouping data of the instrument. An entry looks up S within the era it lies in; what it
    adds to the eras after that is carried on by the sum of its group's entries so far, one row per
    group and era that still holds something. So work grows with versions, ticks, eras and what
    the result is made of, and no version ever meets an era. Raw valuation only: the typed one
    rounds every product.
    """
    request.validate()
    holdings = holdings.filter(in_accounts(request.accounts))
    orders = orders.filter(in_accounts(request.accounts))
    holdings, orders, load = ticked_positions(holdings, orders, prices)
    live = position_versions(holdings, orders, tie_breakers, load=load)
    described = [name for name in request.fields if name in INSTRUMENT_COLUMNS]
    ticks, eras = _eras(known_ticks(prices, instruments).filter(has_valid_price()), described)

    zero = F.lit(0).cast(QUANTITY)
    held = F.coalesce("position", zero)
    filled = F.when(is_order(), F.coalesce("filledQuantity", zero)).otherwise(zero)
    ordered = F.coalesce("orderQuantity", zero)
    own = [name for name in _group_names(request) if name not in described]
    borders = F.filter(
        F.array(
            F.struct(F.col("validFrom").alias("tickTime"), F.lit(1).alias("sign")),
            F.struct(F.col("validTo").alias("tickTime"), F.lit(-1).alias("sign")),
        ),
        lambda entry: entry.tickTime.isNotNull(),
    )
    signed = live.select(
        "instrumentId", *[field_column(name).alias(name) for name in own], F.inline(borders),
        held.alias("sodNavUSD"), (held + filled).alias("currentNavUSD"),
        (held + ordered).alias("expectedNavUSD"),
    )
    measures = [*NAVS, "recordCount"]
    # Before an instrument's first tick nothing ticks: such entries count from there on.
    first = eras.groupBy("instrumentId").agg(
        F.min("firstTick").alias("_start_of_ticks"), F.max("era").alias("_final")
    )
    entries = (
        signed.groupBy("instrumentId", *own, "tickTime")
        .agg(
            *[F.sum(F.col(nav) * F.col("sign")).alias(nav) for nav in NAVS],
            F.sum("sign").alias("recordCount"),
        )
        .join(first, "instrumentId")
        .withColumn("tickTime", F.greatest("tickTime", "_start_of_ticks"))
        .drop("_start_of_ticks")
    )
    heavy = skew.heavy_of(load, BY_INSTRUMENT, rows_per_task)
    placed = skew.as_of(
        entries, eras.select("instrumentId", "firstTick", "era"), ["instrumentId"], "tickTime",
        "firstTick", ["era"], spread=heavy,
    )

    within = skew.later_sums(
        ticks.select("instrumentId", "era", "tickTime", "price", F.lit(1).cast("bigint").alias("ticks")),
        placed, ["instrumentId", "era"], "tickTime", ["price", "ticks"], heavy=heavy,
    )
    by_era = placed.groupBy("instrumentId", *own, "era", "_final").agg(
        *[F.sum(name).alias(name) for name in measures]
    )
    group = Window.partitionBy("instrumentId", *own).orderBy("era")
    so_far = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    something = F.lit(False)
    for name in measures:
        something = something | (F.col(name) != 0)
    carried = (
        by_era.withColumns({name: F.sum(name).over(so_far) for name in measures})
        .withColumn("_next", F.coalesce(F.lead("era").over(group), F.col("_final")))
        .filter(something & (F.col("_next") > F.col("era")))
        .withColumn("era", F.explode(F.sequence(F.col("era") + 1, F.col("_next"))))
        .join(eras.select("instrumentId", "era", "price", "ticks"), ["instrumentId", "era"])
    )
    kept = ["instrumentId", "era", *own, *measures, "price", "ticks"]
    found = within.select(*kept).unionByName(carried.select(*kept))
    if described:
        found = found.join(eras.select("instrumentId", "era", *described), ["instrumentId", "era"])
    sums = found.groupBy(*own, *described).agg(
        *[F.sum(summed_value(F.col("price"), F.col(nav))).cast(RAW_MONEY).alias(nav) for nav in NAVS],
        F.sum(F.col("ticks") * F.col("recordCount")).alias("recordCount"),
    )
    # A group whose versions met no tick has no row.
    return _finish(sums.filter("recordCount > 0"), request, accounts)


def _group_names(request: ViewRequest) -> list[str]:
    """The columns of ``_group_columns``."""
    names = [name for name in request.fields if name != "accountName"]
    if "accountName" in request.fields and "accountId" not in names:
        names.append("accountId")
    return names


def _eras(ticks: DataFrame, described: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Ticks with the era they fall in, and the eras: first tick, sums, grouping data."""
    known = ticks.groupBy("instrumentId", "knownSince").agg(
        F.min("tickTime").alias("firstTick"), F.sum("price").alias("price"),
        F.count("*").alias("ticks"), *[F.first(name).alias(name) for name in described],
    )
    order = Window.partitionBy("instrumentId").orderBy("knownSince")
    opens = F.lag("knownSince").over(order).isNull()
    for name in described:
        opens = opens | ~F.col(name).eqNullSafe(F.lag(name).over(order))
    numbered = known.withColumn("_opens", opens.cast("int")).withColumn(
        "era", F.sum("_opens").over(order)
    )
    eras = numbered.groupBy("instrumentId", "era").agg(
        F.min("firstTick").alias("firstTick"), F.sum("price").alias("price"),
        F.sum("ticks").alias("ticks"), *[F.first(name).alias(name) for name in described],
    )
    places = numbered.select("instrumentId", "knownSince", "era")
    return ticks.join(places, ["instrumentId", "knownSince"]), eras


def account_nav(valued: DataFrame, abs_orders: bool = False) -> DataFrame:
    """Holding, order and total NAV per account and instrument.

    ``abs_orders`` counts orders as absolute amounts.
    """
    amount = F.abs("marketValueUSD") if abs_orders else F.col("marketValueUSD")
    holding = F.sum(_money(F.when(is_holding(), F.col("marketValueUSD"))))
    order = F.sum(_money(F.when(is_order(), amount)))
    return (
        valued.groupBy("accountId", "instrumentId")
        .agg(
            holding.cast(RAW_MONEY).alias("holdingValue"),
            order.cast(RAW_MONEY).alias("orderValue"),
        )
        .withColumn("totalValue", (F.col("holdingValue") + F.col("orderValue")).cast(RAW_MONEY))
    )


def account_nav_totals(valued: DataFrame, abs_orders: bool = False) -> DataFrame:
    names = ("holdingValue", "orderValue", "totalValue")
    return (
        account_nav(valued, abs_orders)
        .groupBy("accountId")
        .agg(
            *[F.sum(name).cast(RAW_MONEY).alias(name) for name in names],
            F.count("*").alias("instruments"),
        )
    )


def account_nav_maps(
    valued: DataFrame, accounts: Sequence[str], abs_orders: bool = False
) -> DataFrame:
    """The breakdown as one row per chosen account with maps instrument -> value.

    A map holds every instrument of its account, so accounts must be named.
    """
    if not accounts:
        raise ValueError("name the accounts to build maps for")
    def as_map(name: str) -> Column:
        entries = F.collect_list(F.struct("instrumentId", name))
        return F.map_from_entries(F.sort_array(entries)).alias(name + "s")
    chosen = account_nav(valued.filter(in_accounts(accounts)), abs_orders)
    return chosen.groupBy("accountId").agg(
        as_map("holdingValue"), as_map("orderValue"),
        F.sum("totalValue").cast(RAW_MONEY).alias("totalNav"),
    )


def preaggregated_overview(
    positions: DataFrame,
    quotes: DataFrame,
    request: ViewRequest,
    accounts: DataFrame | None = None,
) -> DataFrame:
    """Overview that sums quantities per account and instrument before prices are joined.

    Equal to ``account_overview`` under raw valuation.
    """
    request.validate()
    chosen = [name for name in ORDER_FIELDS if name in request.fields]
    quantity = {
        "held": F.when(is_holding(), F.col("position")),
        "filled": F.when(is_order(), F.col("filledQuantity")),
        "ordered": F.when(is_order(), F.col("orderQuantity")),
    }
    summed = (
        positions.filter(in_accounts(request.accounts))
        .withColumns({name: field_column(name) for name in chosen})
        .groupBy("accountId", "instrumentId", *chosen)
        .agg(
            *[
                F.coalesce(F.sum(value), F.lit(0)).alias(name)
                for name, value in quantity.items()
            ],
            F.count("*").alias("rows"),
        )
        .withColumn("recordType", F.lit("ORDER"))
    )
    priced = summed.join(quotes.filter(has_valid_price()), "instrumentId")
    navs = {
        "sodNavUSD": summed_value(F.col("price"), F.col("held")),
        "currentNavUSD": summed_value(F.col("price"), F.col("held") + F.col("filled")),
        "expectedNavUSD": summed_value(F.col("price"), F.col("held") + F.col("ordered")),
    }
    sums = priced.groupBy(*_group_columns(request)).agg(
        *[F.sum(value).cast(RAW_MONEY).alias(name) for name, value in navs.items()],
        F.sum("rows").alias("recordCount"),
        F.max("priceTimestamp").alias("priceTimestamp"),
    )
    return _finish(sums, request, accounts, ["priceTimestamp"])


def with_empty_accounts(
    overview: DataFrame, accounts: DataFrame, request: ViewRequest
) -> DataFrame:
    """Every selected account, with zero NAV where the overview has no row for it.

    The overview must be grouped by ``accountId`` alone or together with the account name.
    """
    navs = [e.column for e in request.exposures]
    chosen = accounts.filter(in_accounts(request.accounts)).select("accountId", "accountName")
    sums = overview.select("accountId", *navs, "recordCount")
    return chosen.join(sums, "accountId", "left").select(
        "accountId",
        "accountName",
        *[_money(F.col(nav)).alias(nav) for nav in navs],
        F.coalesce("recordCount", F.lit(0)).alias("recordCount"),
    )


def nav_change(before: DataFrame, after: DataFrame, abs_orders: bool = False) -> DataFrame:
    """Total NAV of every account in two valued states, and the difference."""
    old = account_nav_totals(before, abs_orders).select(
        "accountId", F.col("totalValue").alias("navBefore")
    )
    new = account_nav_totals(after, abs_orders).select(
        "accountId", F.col("totalValue").alias("navAfter")
    )
    both = old.join(new, "accountId", "full")
    return both.select(
        "accountId",
        _money(F.col("navBefore")).alias("navBefore"),
        _money(F.col("navAfter")).alias("navAfter"),
        (_money(F.col("navAfter")) - _money(F.col("navBefore"))).cast(RAW_MONEY).alias("change"),
    )
