"""Batch reports over notices.

Reports over lots take the flat form of :func:`lots_of`, so the same report runs
on nested notice records and on a normalised lot table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.money import as_money, clamp, lot_value, to_double
from tenderloom.operators.cube import (
    GRAINS,
    SCOPES,
    calendar_cube,
    count_if,
    count_of,
    count_rows,
    cube_from_partials,
    day_partials,
    money_avg,
    money_max,
    money_sum,
)
from tenderloom.operators.ranking import first_per_group, nulls_last, top_per_group
from tenderloom.operators.selection import exact_quantiles, first_bins
from tenderloom.operators.tables import stored
from tenderloom.schemas import PROVINCE_CODE, PROVINCE_ROOT_CODE

_WIN = "is_win_bid"
_ENDED = "is_termination"
_LOST = "not is_win_bid and not is_termination"
_HAS_OUTCOME = f"({_WIN}) or ({_LOST}) or ({_ENDED})"
_HAS_MONEY = "total_amount >= 0 or total_budget >= 0"


def lots_of(notices: DataFrame, *notice_cols: str) -> DataFrame:
    """Flat lots with the asked columns of their notice; notices without lots drop out."""
    keep = list(notice_cols) or [c for c in notices.columns if c != "bid_items"]
    return notices.select(*keep, F.explode("bid_items").alias("lot")).select(*keep, "lot.*")


def outcome_measures() -> list:
    return [
        count_if("win_count", _WIN),
        count_if("lose_count", _LOST),
        count_if("terminate_count", _ENDED),
    ]


def win_counts(notices: DataFrame) -> DataFrame:
    return calendar_cube(notices.filter(_WIN), [], [count_rows("win_count")])


def lose_counts(notices: DataFrame) -> DataFrame:
    return calendar_cube(notices.filter(_LOST), [], [count_rows("lose_count")])


def terminate_counts(notices: DataFrame) -> DataFrame:
    return calendar_cube(notices.filter(_ENDED), [], [count_rows("terminate_count")])


def outcome_counts(notices: DataFrame, grains=tuple(GRAINS), scopes=SCOPES) -> DataFrame:
    """Win, void and terminated notices per district and period, in one pass.

    A period stays when it has any of the three outcomes.
    """
    return calendar_cube(notices.filter(_HAS_OUTCOME), [], outcome_measures(), grains, scopes)


def budget_measures(where: Column | None = None) -> list:
    amount, budget = (c if where is None else F.when(where, c) for c in (clamp("total_amount"), clamp("total_budget")))
    return [
        money_sum("amount_sum", amount),
        money_max("amount_max", amount),
        money_avg("amount_avg", amount),
        money_sum("budget_sum", budget),
        money_max("budget_max", budget),
        money_avg("budget_avg", budget),
    ]


def budget_situation(notices: DataFrame) -> DataFrame:
    return calendar_cube(notices.filter(_HAS_MONEY), [], budget_measures())


def level_of(code: Column) -> Column:
    """1 province, 2 city (also the city itself, ``..99``), 3 district."""
    return (
        F.when(code.isin(PROVINCE_CODE, PROVINCE_ROOT_CODE), 1)
        .when((code % 100).isin(0, 99), 2)
        .when(code.isNotNull(), 3)
    )


def _level_row(rows: DataFrame) -> DataFrame:
    """One row from rows (level, rows, amount): count and amount of each level and of all."""
    aggs = []

    def count(n: Column) -> Column:
        return F.coalesce(F.sum(n), F.lit(0))

    def money(amount: Column) -> Column:
        return F.coalesce(to_double(F.sum(amount)), F.lit(0.0))

    for level, prefix in ((1, "provincial"), (2, "municipal"), (3, "district")):
        at = F.col("level") == level
        aggs.append(count(F.when(at, F.col("rows"))).alias(f"{prefix}_count"))
        aggs.append(money(F.when(at, F.col("amount"))).alias(f"{prefix}_amount"))
    return rows.agg(*aggs, money(F.col("amount")).alias("total_amount"), count(F.col("rows")).alias("total_count"))


def district_levels(notices: DataFrame) -> DataFrame:
    """One row: count and amount of each level, all from one aggregation."""
    return _level_row(
        notices.select(
            level_of(F.col("district_code")).alias("level"),
            F.lit(1).cast("bigint").alias("rows"),
            as_money(clamp("total_amount")).alias("amount"),
        )
    )


def volume_measures() -> list:
    return [money_sum("transactions_volume", "total_amount")]


def volumes(notices: DataFrame, grains=tuple(GRAINS), scopes=SCOPES) -> DataFrame:
    """Amount of won notices per district and period."""
    return calendar_cube(notices.filter(_WIN), [], volume_measures(), grains, scopes)


def method_measures() -> list:
    return [
        count_of("count", "procurement_method"),
        money_sum("total_amount", clamp("total_amount", keep_null=True)),
    ]


def method_counts(notices: DataFrame, grains=tuple(GRAINS), scopes=SCOPES) -> DataFrame:
    return calendar_cube(notices, ["procurement_method"], method_measures(), grains, scopes)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def catalog_counts(notices: DataFrame) -> DataFrame:
    return count_by(notices, "catalog")


def _named_agency(notices: DataFrame) -> DataFrame:
    return notices.filter(F.length("purchasing_agency") > 1)


def agency_counts(notices: DataFrame) -> DataFrame:
    return count_by(_named_agency(notices), "purchasing_agency")


def agency_top_catalog(notices: DataFrame) -> DataFrame:
    """The catalog an agency handles most often; ties go to the first name."""
    return _first_catalog(count_by(_named_agency(notices), "purchasing_agency", "catalog"))


def _first_catalog(counts: DataFrame) -> DataFrame:
    return first_per_group(
        counts, ["purchasing_agency"], [-F.col("count"), *nulls_last("catalog")], ["catalog", "count"]
    )


def purchaser_counts(notices: DataFrame) -> DataFrame:
    return calendar_cube(notices, ["purchaser"], [count_rows("count")])


def purchaser_catalogs(notices: DataFrame) -> DataFrame:
    return count_by(notices, "purchaser", "catalog")


def purchaser_agencies(notices: DataFrame) -> DataFrame:
    return count_by(notices, "purchaser", "purchasing_agency")


def top_catalogs_of_purchaser(notices: DataFrame, n: int = 3) -> DataFrame:
    order = [F.desc("count"), F.asc_nulls_last("catalog")]
    return top_per_group(purchaser_catalogs(notices), ["purchaser"], order, n)


def top_agencies_of_purchaser(notices: DataFrame, n: int = 3) -> DataFrame:
    order = [F.desc("count"), F.asc_nulls_last("purchasing_agency")]
    return top_per_group(purchaser_agencies(notices), ["purchaser"], order, n)


def supplier_counts(lots: DataFrame) -> DataFrame:
    return calendar_cube(lots.filter(F.col("supplier").isNotNull()), ["supplier"], [count_rows("count")])


def supplier_volumes(
    lots: DataFrame, grains=tuple(GRAINS), scopes=SCOPES, percent_scale: str = "0.01"
) -> DataFrame:
    """Won amount and number of won lots per supplier, district and period."""
    won = lots.filter("is_win_bid and is_win and amount >= 0")
    value = lot_value(F.col("amount"), F.col("is_percent"), F.col("total_budget"), percent_scale)
    measures = [money_sum("transactions_volume", value, cast=False), count_rows("bidding_count")]
    return calendar_cube(won, ["supplier"], measures, grains, scopes)


def supplier_catalogs(lots: DataFrame) -> DataFrame:
    return count_by(lots.filter(F.col("supplier").isNotNull()), "supplier", "catalog")


def supplier_addresses(lots: DataFrame) -> DataFrame:
    """The address seen most often for each supplier."""
    named = lots.filter(F.length("supplier") >= 2).withColumnRenamed("supplier_address", "address")
    counts = count_by(named, "supplier", "address")
    return first_per_group(
        counts, ["supplier"], [-F.col("count"), *nulls_last("address")], ["address"]
    )


FREQUENCY_ATTRIBUTES = (
    "author",
    "catalog",
    "procurement_method",
    "is_win_bid",
    "purchaser",
    "purchasing_agency",
    "is_termination",
)


def value_frequencies(notices: DataFrame) -> DataFrame:
    """(attribute, value, count) of the descriptive columns."""
    texts = notices.select([F.col(c).cast("string").alias(c) for c in FREQUENCY_ATTRIBUTES])
    long = texts.unpivot([], list(FREQUENCY_ATTRIBUTES), "attribute", "value")
    return count_by(long, "attribute", "value")


QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def amount_summary(notices: DataFrame) -> DataFrame:
    """count, mean, stddev, min, quartiles and max of budget and amount, one row per metric.

    Only notices with both values above 0 count.  Moments come from decimal sums, which the first
    histogram round of the quartiles carries along, so the notices are read twice in all.
    """
    columns = ["total_budget", "total_amount"]
    both = notices.filter((F.col("total_budget") > 0) & (F.col("total_amount") > 0))
    long = both.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    v = F.col("value").cast("decimal(18,4)")
    moments = [
        F.sum(v).alias("total"),
        F.sum(v * v).alias("squares"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    ]
    bins = first_bins(long, "column", "value", moments)
    stats = bins.groupBy("column").agg(
        F.sum("rows").alias("n"),
        F.sum("total").alias("total"),
        F.sum("squares").alias("squares"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
    )
    n, total, squares = (F.col(c).cast("double") for c in ("n", "total", "squares"))
    variance = F.try_divide(squares - total * total / n, n - 1)
    plain = {
        "count": n,
        "mean": F.round(F.try_divide(total, n), 2),
        "stddev": F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), 2),
        "min": F.col("least"),
        "max": F.col("greatest"),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in plain.items()])
    quartiles = exact_quantiles(long, bins, "column", "value", QUARTILES)
    metrics = stats.select("column", F.inline(rows)).unionByName(quartiles)
    return metrics.groupBy("metric").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )


# --- the report set ----------------------------------------------------------

JOINT_KEY = "procurement_method"


def joint_cells(notices: DataFrame) -> DataFrame:
    """Day cells by district and method that hold every partial of outcomes, volumes, budgets and methods.

    One pass over the notices.  ``outcome_rows`` and ``budget_rows`` say how many notices of the cell
    belong to those reports, so that a period without any stays out.
    """
    won = F.when(F.expr(_WIN), F.col("total_amount"))
    measures = [
        *outcome_measures(),
        money_sum("transactions_volume", won),
        *budget_measures(F.expr(_HAS_MONEY)),
        *method_measures(),
        count_rows("rows"),
        money_sum("amount", clamp("total_amount")),
        count_if("outcome_rows", _HAS_OUTCOME),
        count_if("budget_rows", _HAS_MONEY),
    ]
    return day_partials(notices, [JOINT_KEY], measures)


def joint_reports(cells: DataFrame) -> dict[str, DataFrame]:
    """The reports of :func:`joint_cells`, each rolled up from the cells."""

    def only(name: str) -> DataFrame:
        return cube_from_partials(cells.filter(F.col(name) > 0), [], [count_rows(name)])

    return {
        "outcomes": cube_from_partials(cells.filter("outcome_rows > 0"), [], outcome_measures()),
        **{name: only(name) for name in ("win_count", "lose_count", "terminate_count")},
        "volumes": cube_from_partials(cells.filter("win_count > 0"), [], volume_measures()),
        "budgets": cube_from_partials(cells.filter("budget_rows > 0"), [], budget_measures()),
        "methods": cube_from_partials(cells, [JOINT_KEY], method_measures()),
        "levels": _level_row(cells.select(level_of(F.col("district_code")).alias("level"), "rows", "amount")),
    }


def name_cells(notices: DataFrame) -> DataFrame:
    """Notices per purchaser, agency and catalog: what the count tables are folded from."""
    return count_by(notices, "purchaser", "purchasing_agency", "catalog")


def name_reports(cells: DataFrame) -> dict[str, DataFrame]:
    """The count tables of :func:`name_cells`."""

    def fold(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("count").alias("count"))

    named = _named_agency(cells)
    return {
        "purchaser_catalogs": fold(cells, "purchaser", "catalog"),
        "purchaser_agencies": fold(cells, "purchaser", "purchasing_agency"),
        "catalogs": fold(cells, "catalog"),
        "agencies": fold(named, "purchasing_agency"),
        "agency_catalogs": _first_catalog(fold(named, "purchasing_agency", "catalog")),
    }


def all_reports(notices: DataFrame) -> dict[str, DataFrame]:
    """Every table of the serving layer, by its table name.

    ``notices`` should be a stored table.  Two passes write the cells that most reports are rolled up
    from; purchasers and the three lot reports read the table themselves, only their own columns.
    """
    lots = lots_of(
        notices,
        "scrape_timestamp",
        "district_code",
        "catalog",
        "is_win_bid",
        "total_budget",
    )
    joint = joint_reports(stored(joint_cells(notices), "joint-cells"))
    names = name_reports(stored(name_cells(notices), "name-cells"))
    return {
        "bidding_district_stats": joint["levels"],
        "procurement_stats": joint["methods"],
        "bidding_stats": joint["outcomes"],
        "bidding_budget_stats": joint["budgets"],
        "transactions_volumes": joint["volumes"],
        "supplier_transactions": supplier_volumes(lots),
        "supplier_catalogs": supplier_catalogs(lots),
        "supplier_address": supplier_addresses(lots),
        "purchaser_stats": purchaser_counts(notices),
        "purchaser_catalog_stats": names["purchaser_catalogs"],
        "purchaser_agency_stats": names["purchaser_agencies"],
        "catalog_stats": names["catalogs"],
        "agency_stats": names["agencies"],
        "agency_catalog_stats": names["agency_catalogs"],
    }
