"""Serving queries over the cube and notice tables.

Each function takes the stored table it reads, so a filter on year, district or
grain is pushed into the scan of that table.  Nested results come as long rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.calendar import date_to_ms, in_period
from tenderloom.functions.labels import method_name
from tenderloom.functions.money import as_money, lot_value, to_double
from tenderloom.operators.cube import district_rows, grain_rows, province_rows
from tenderloom.operators.ranking import check_page, page, page_after, rank_with_bounds, running_total
from tenderloom.plans.districts import (
    fold_to_city,
    self_and_children,
    short_place_name,
    with_city_name,
)
from tenderloom.schemas import PROVINCE_CODE, TOTAL_YEAR


def money_total(col: str) -> Column:
    return to_double(F.sum(as_money(col)))


def basic_situation(
    notices: DataFrame, outcomes: DataFrame, volume: DataFrame, suppliers: DataFrame
) -> DataFrame:
    """One row of headline figures.  The parts are stacked and folded, not cross-joined."""
    kinds = {
        "announcement_count": "bigint",
        "transactions_count": "bigint",
        "latest_timestamp": "bigint",
        "transactions_volume": "decimal(38,4)",
        "supplier_count": "bigint",
    }

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.agg(
            *[
                values.get(n, F.lit(None)).cast(t).alias(n)
                for n, t in kinds.items()
            ]
        )

    wins = grain_rows(province_rows(outcomes), "year")
    money = grain_rows(province_rows(volume), "year")
    stacked = (
        part(notices, announcement_count=F.count("*"), latest_timestamp=F.max("scrape_timestamp"))
        .unionByName(part(wins, transactions_count=F.sum("win_count")))
        .unionByName(part(money, transactions_volume=F.sum(as_money("transactions_volume"))))
        .unionByName(part(suppliers, supplier_count=F.count("*")))
    )
    folded = stacked.agg(*[F.max(n).alias(n) for n in kinds])
    return folded.withColumn("transactions_volume", to_double("transactions_volume"))


def quarter_series(outcomes: DataFrame, volume: DataFrame) -> DataFrame:
    """Province quarters: notices, wins and volume."""
    counts = grain_rows(province_rows(outcomes), "quarter").select(
        "year",
        "quarter",
        (F.col("win_count") + F.col("lose_count") + F.col("terminate_count")).alias("announcement_count"),
        F.col("win_count").alias("transactions_count"),
    )
    money = grain_rows(province_rows(volume), "quarter").select("year", "quarter", "transactions_volume")
    return counts.join(money, ["year", "quarter"], "left").orderBy("year", "quarter")


def scale_by_grain(volume: DataFrame, years: Iterable[int] | None = None) -> DataFrame:
    """Province volume as day, month and quarter series per year, of all years unless some are named."""
    rows = province_rows(volume).filter(F.col("year") != 10000)
    if years is not None:
        rows = rows.filter(F.col("year").isin(*years))
    grain = (
        F.when(F.col("day") != 0, "day")
        .when(F.col("month") != 0, "month")
        .when(F.col("quarter") != 0, "quarter")
    )
    idx = (
        F.when(F.col("day") != 0, F.col("day"))
        .when(F.col("month") != 0, F.col("month"))
        .otherwise(F.col("quarter"))
    )
    return (
        rows.withColumn("grain", grain)
        .filter(F.col("grain").isNotNull())
        .select(
            "year",
            "grain",
            F.when(F.col("grain") == "day", F.col("month")).otherwise(0).alias("month"),
            idx.alias("idx"),
            F.col("transactions_volume").alias("value"),
        )
        .orderBy("year", "grain", "month", "idx")
    )


def _notices_where(
    notices: DataFrame, district: int, year: int, month: int, day: int, quarter: int
) -> DataFrame:
    rows = notices.filter(in_period("scrape_timestamp", year, month, day, quarter))
    # A stored table has year and month folders, which the filter on the time alone would not prune.
    folders = {"year": year, "month": month if year else 0}
    for name, value in folders.items():
        if value and name in notices.columns:
            rows = rows.filter(F.col(name) == value)
    if year and quarter and not month and "month" in notices.columns:
        rows = rows.filter(F.col("month").between(3 * quarter - 2, 3 * quarter))
    return rows.filter(F.col("district_code") == district) if district else rows


def notices_page(
    notices: DataFrame,
    page_no: int,
    page_size: int,
    district: int = 0,
    year: int = 0,
    month: int = 0,
    day: int = 0,
    quarter: int = 0,
    key: str = "id",
) -> DataFrame:
    """One page of notices in time order; district 0 means all."""
    rows = _notices_where(notices, district, year, month, day, quarter)
    return page(rows, ["scrape_timestamp", key], page_no, page_size)


def notices_total(
    notices: DataFrame, district: int = 0, year: int = 0, month: int = 0, day: int = 0, quarter: int = 0
) -> DataFrame:
    return _notices_where(notices, district, year, month, day, quarter).agg(F.count("*").alias("total"))


# Deep pages: a count of the stored notices by folder and district says in which folders a page lies.

TIME_ORDER = ("scrape_timestamp", "id")


def folder_counts(notices: DataFrame) -> DataFrame:
    """(year, month, district_code, rows): the index of a notice table in month folders; write it beside
    the table.  At most districts times months rows."""
    dated = notices.filter(F.col("scrape_timestamp").isNotNull())
    return dated.groupBy("year", "month", "district_code").agg(F.count("*").alias("rows"))


def _folders(counts: DataFrame, district: int) -> list[tuple[int, int, int]]:
    """(year, month, rows) of the folders with rows, in time order: one for each calendar month."""
    rows = counts.filter(F.col("district_code") == district) if district else counts
    return [tuple(r) for r in rows.groupBy("year", "month").agg(F.sum("rows")).orderBy("year", "month").collect()]


def _in_folders(notices: DataFrame, folders: list[tuple[int, int, int]], district: int) -> DataFrame:
    if not folders:
        return notices.filter(F.lit(False))
    months = F.lit(False)
    for year, month, _ in folders:
        months = months | ((F.col("year") == year) & (F.col("month") == month))
    rows = notices.filter(months & F.col("scrape_timestamp").isNotNull())
    return rows.filter(F.col("district_code") == district) if district else rows


def indexed_page(
    notices: DataFrame, counts: DataFrame, page_no: int, page_size: int, district: int = 0, order: Sequence[str] = TIME_ORDER
) -> DataFrame:
    """One page in time order of a table in month folders.

    Prefix sums of ``folder_counts`` find the folders the page lies in; only these are read, and the
    offset counts from the first of them.
    """
    check_page(page_no, page_size)
    begin, end = (page_no - 1) * page_size, page_no * page_size
    here, skip, reached = [], 0, 0
    for folder in _folders(counts, district):
        if reached < end and reached + folder[2] > begin:
            skip = begin - reached if not here else skip
            here.append(folder)
        reached += folder[2]
    return _in_folders(notices, here, district).orderBy(*order).offset(skip).limit(page_size)


def indexed_page_after(
    notices: DataFrame, counts: DataFrame, after: Sequence[object], page_size: int, district: int = 0, order: Sequence[str] = TIME_ORDER
) -> DataFrame:
    """The page that follows a known last row, from its month's folder on as far as the page can reach."""
    last = datetime.fromtimestamp(after[0] // 1000, UTC)
    here, reached = [], 0
    for folder in _folders(counts, district):
        if folder[:2] >= (last.year, last.month) and reached < page_size:
            here.append(folder)
            reached += folder[2] if folder[:2] > (last.year, last.month) else 0
    return page_after(_in_folders(notices, here, district), order, after, page_size)


def level_rows(levels: DataFrame) -> DataFrame:
    """The one-row level report as three rows."""
    return levels.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("name"),
                        F.col(f"{prefix}_amount").alias("value"),
                        F.col(f"{prefix}_count").alias("count"),
                    )
                    for name, prefix in (("省级", "provincial"), ("市级", "municipal"), ("区级", "district"))
                ]
            )
        )
    )


def outcomes_by_year(outcomes: DataFrame) -> DataFrame:
    return grain_rows(province_rows(outcomes), "year").groupBy("year").agg(
        *[F.sum(c).alias(c) for c in ("win_count", "lose_count", "terminate_count")]
    )


def method_by_year(methods: DataFrame, with_total: bool = True) -> DataFrame:
    """Count and amount per method and year; the all-years total is year 10000."""
    rows = grain_rows(province_rows(methods), "year").select(
        "year", method_name(F.col("procurement_method")).alias("name"), "count", "total_amount"
    )
    return _with_year_total(
        rows,
        ["name"],
        [F.sum("count").alias("count"), money_total("total_amount").alias("amount")],
        with_total,
    )


def _with_year_total(rows: DataFrame, keys: list[str], aggs: list[Column], with_total: bool = True) -> DataFrame:
    sets = [["year", *keys]] + ([keys] if with_total else [])
    grouped = rows.groupingSets(sets, "year", *keys).agg(*aggs, F.grouping("year").alias("_all"))
    year = F.when(F.col("_all") == 1, F.lit(TOTAL_YEAR)).otherwise(F.col("year")).alias("year")
    return grouped.select(year, *[c for c in grouped.columns if c not in ("year", "_all")])


def city_volume_by_year(volume: DataFrame, districts: DataFrame) -> DataFrame:
    """Year volume per city, and the all-years total as year 10000 under the short name."""
    rows = grain_rows(district_rows(volume), "year").filter(F.col("district_code") != PROVINCE_CODE)
    folded = fold_to_city(rows, districts)
    summed = _with_year_total(folded, ["city_code"], [money_total("transactions_volume").alias("volume")])
    name = F.when(F.col("year") == TOTAL_YEAR, short_place_name("district_name")).otherwise(
        F.col("district_name")
    )
    return with_city_name(summed, districts).select(
        "year", F.col("city_code").alias("district_code"), name.alias("district_name"), "volume"
    )


def child_volume_by_year(volume: DataFrame, districts: DataFrame, code: int) -> DataFrame:
    """Year volume of a district and its children, with the all-years total."""
    family = self_and_children(districts, code).select(
        F.col("code").alias("district_code"), short_place_name("name").alias("district_name")
    )
    rows = grain_rows(district_rows(volume), "year").join(family, "district_code")
    return _with_year_total(
        rows, ["district_code", "district_name"], [money_total("transactions_volume").alias("volume")]
    )


def city_growth(volume: DataFrame, districts: DataFrame) -> DataFrame:
    """Running volume per city over its months, stamped with the first day of the month."""
    rows = grain_rows(district_rows(volume), "month").filter(F.col("district_code") != PROVINCE_CODE)
    months = (
        fold_to_city(rows, districts)
        .groupBy("city_code", "year", "month")
        .agg(F.sum(as_money("transactions_volume")).alias("month_volume"))
    )
    grown = running_total(months, ["city_code"], ["year", "month"], "month_volume", "grown")
    return with_city_name(grown, districts).select(
        F.col("city_code").alias("district_code"),
        "district_name",
        date_to_ms(F.make_date("year", "month", F.lit(1))).alias("timestamp"),
        to_double("grown").alias("value"),
    )


def city_rank(city_volumes: DataFrame) -> DataFrame:
    """Cities of each year by volume, with the year's least and greatest volume."""
    return rank_with_bounds(city_volumes, ["year"], "volume")


def supplier_page(suppliers: DataFrame, page_no: int, page_size: int) -> DataFrame:
    check_page(page_no, page_size)
    return page(suppliers.select("supplier"), ["supplier"], page_no, page_size)


def supplier_catalogs_of(catalogs: DataFrame, supplier: str) -> DataFrame:
    return catalogs.filter(F.col("supplier") == supplier).select(
        F.col("catalog").alias("name"), F.col("count").alias("value")
    )


def supplier_detail(lots: DataFrame, supplier: str, percent_scale: str = "0.01") -> DataFrame:
    """Most frequent address, catalogs and won volume by year of one supplier, as long rows.

    All sections are grouping sets of one aggregate over the supplier's lots (with the columns of
    their notice), so the lots are read once.  No row at all means the supplier is unknown.
    """
    won = F.expr("is_win_bid and is_win and amount >= 0")
    value = lot_value(F.col("amount"), F.col("is_percent"), F.col("total_budget"), percent_scale)
    year = F.year(F.timestamp_millis("scrape_timestamp"))
    rows = lots.filter(F.col("supplier") == supplier).select(
        "supplier",
        F.col("supplier_address").alias("address"),
        "catalog",
        year.alias("year"),
        F.when(won, value).alias("won_value"),
        won.alias("won"),
    )
    keys = ("address", "catalog", "year")
    grouped = rows.groupingSets([["supplier", k] for k in keys], "supplier", *keys).agg(
        F.count("*").alias("lots"),
        F.count_if("won").alias("won"),
        F.sum("won_value").alias("volume"),
        *[F.grouping(k).alias(f"_all_{k}") for k in keys],
    )
    section = F.coalesce(*[F.when(F.col(f"_all_{k}") == 0, F.lit(k)) for k in keys])
    parts = grouped.select(
        "supplier",
        section.alias("section"),
        F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("label"),
        *("lots", "won", "volume"),
    ).filter((F.col("section") != "year") | (F.col("won") > 0))
    parts = parts.filter((F.col("section") != "address") | (F.length("supplier") >= 2))
    # One address, the most frequent one; each catalog and year keeps its row.
    each = F.when(F.col("section") != "address", F.struct("label"))
    order = F.struct(-F.col("lots"), F.col("label").isNull(), "label", "lots", "won", "volume")
    best = parts.groupBy("supplier", "section", each.alias("_each")).agg(F.min(order).alias("b"))
    return best.select(
        "supplier",
        "section",
        F.col("b.label").alias("label"),
        F.when(F.col("section") == "year", to_double("b.volume")).alias("volume"),
        F.when(F.col("section") == "catalog", F.col("b.lots")).when(F.col("section") == "year", F.col("b.won")).alias("count"),
    )


def yearly_from_months(volume: DataFrame) -> DataFrame:
    """Yearly totals as the sum of the province's month rows."""
    return grain_rows(province_rows(volume), "month").groupBy("year").agg(
        money_total("transactions_volume").alias("value")
    )
