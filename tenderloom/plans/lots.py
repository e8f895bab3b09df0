"""Lot arithmetic on flat lot tables: merge, budgets, amounts, reconciliation.

Everything groups by (notice, index) or by notice with mergeable aggregates, so a
notice with a third of all lots is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.money import as_money, clamp, lot_value, to_double
from tenderloom.functions.notice_text import BUDGET_TOLERANCE


def merge_lots(purchase: DataFrame, result: DataFrame) -> DataFrame:
    """Result lots take name and budget of the purchase lot with the same index.

    One purchase lot may meet several result lots (one lot, several suppliers).
    """
    planned = purchase.select("id", "index", F.col("name").alias("p_name"), F.col("budget").alias("p_budget"))
    return (
        result.join(planned, ["id", "index"], "left")
        .withColumn("name", F.coalesce("p_name", "name"))
        .withColumn("budget", F.coalesce("p_budget", "budget"))
        .drop("p_name", "p_budget")
    )


def lot_count_mismatch(purchase: DataFrame, result: DataFrame) -> DataFrame:
    """Notices whose number of purchase lots differs from the greatest result index."""
    planned = purchase.groupBy("id").agg(F.count("*").alias("purchase_count"))
    reached = result.groupBy("id").agg(F.max("index").alias("result_max"))
    both = planned.join(reached, "id", "full")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("purchase_count", "result_max")]
    return both.select("id", *counts).filter(F.col("purchase_count") != F.col("result_max"))


def budget_of_lots(lots: DataFrame) -> DataFrame:
    """Total budget per notice, each lot index counted once.

    Lots of one index carry the same budget; where they differ the greatest counts.  An unassigned
    budget (-1) adds nothing; without any budget the total is unassigned too.
    """
    once = lots.groupBy("id", "index").agg(F.max(as_money("budget")).alias("budget"))
    known = F.sum(F.when(F.col("budget") >= 0, F.col("budget")))
    return once.groupBy("id").agg(to_double(F.coalesce(known, F.min("budget"))).alias("lot_budget"))


def amount_of_lots(lots: DataFrame) -> DataFrame:
    """Total won amount per notice; 0 for a notice that is not a win.  An unread price (-1) adds nothing.

    ``lots`` carries ``is_win_bid`` and ``total_budget`` of its notice.
    """
    value = lot_value(clamp("amount"), F.col("is_percent"), clamp("total_budget"))
    counted = F.sum(F.when(F.col("is_win_bid") & F.col("is_win"), value))
    return lots.groupBy("id").agg(F.coalesce(to_double(counted), F.lit(0.0)).alias("lot_amount"))


def budget_mismatch(notices: DataFrame, lots: DataFrame) -> DataFrame:
    """Notices whose declared budget is not the sum of their lots."""
    declared = notices.filter(F.col("total_budget") != 0).select("id", "total_budget")
    return (
        declared.join(budget_of_lots(lots), "id")
        .filter(F.abs(F.col("total_budget") - F.col("lot_budget")) > BUDGET_TOLERANCE)
    )
