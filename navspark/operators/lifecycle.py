"""Order histories and their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.functions.predicates import completely_filled, is_terminal, is_working
from navspark.operators import skew
from navspark.operators.latest import latest


def order_history(
    orders: DataFrame, rows_per_task: int = skew.ROWS_PER_TASK
) -> DataFrame:
    """Every step of every order with the step before it and the rules it breaks."""
    stepped = skew.neighbour(
        orders, ["orderId"], ["timestamp", "sequence"], ["orderStatus", "filledQuantity"],
        "_before", False, rows_per_task=rows_per_task,
    )
    filled = F.coalesce("filledQuantity", F.lit(0))
    before = F.coalesce("previousFilled", F.lit(0))
    full = F.coalesce(completely_filled(), F.lit(False))
    return (
        stepped.withColumn("previousStatus", F.col("_before.orderStatus"))
        .withColumn("previousFilled", F.col("_before.filledQuantity"))
        .drop("_before")
        .withColumn(
            "afterTerminal", F.coalesce(is_terminal("previousStatus"), F.lit(False))
        )
        .withColumn("fillFalls", F.col("previousStatus").isNotNull() & (filled < before))
        .withColumn("overfilled", filled > F.abs("orderQuantity"))
        .withColumn("filledMismatch", (F.col("orderStatus") == "FILLED") != full)
    )


RULES = ("afterTerminal", "fillFalls", "overfilled", "filledMismatch")


def violations(orders: DataFrame, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    broken = F.lit(False)
    for rule in RULES:
        broken = broken | F.col(rule)
    return order_history(orders, rows_per_task).filter(broken)


def working_orders(orders: DataFrame) -> DataFrame:
    return latest(orders, "order").filter(is_working())


def working_order_count(orders: DataFrame) -> DataFrame:
    return working_orders(orders).agg(F.count("*").alias("workingOrders"))
