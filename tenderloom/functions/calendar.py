"""Calendar columns, period ranges and month scaffolds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def quarter_of_month(month: Column) -> Column:
    return F.floor((month + 2) / 3).cast("int")


def with_calendar(df: DataFrame, ms_col: str = "scrape_timestamp", quarter: bool = True) -> DataFrame:
    """Replace the epoch-millisecond column by year, month, day (and quarter)."""
    ts = F.timestamp_millis(F.col(ms_col))
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}
    if quarter:
        parts["quarter"] = F.quarter(ts)
    return df.withColumns(parts).drop(ms_col)


def period_range(year: int, month: int = 0, day: int = 0, quarter: int = 0) -> tuple[Column, Column]:
    """Half-open range in epoch milliseconds of a day, month, quarter or year.

    Both ends fold to literals, so the filter reaches the scan.
    """
    if year <= 0:
        raise ValueError("a period needs a year")
    if month > 0 and day > 0:
        begin = F.make_date(F.lit(year), F.lit(month), F.lit(day))
        end = F.date_add(begin, 1)
    elif month > 0:
        begin = F.make_date(F.lit(year), F.lit(month), F.lit(1))
        end = F.add_months(begin, 1)
    elif quarter > 0:
        begin = F.make_date(F.lit(year), F.lit(3 * quarter - 2), F.lit(1))
        end = F.add_months(begin, 3)
    else:
        begin = F.make_date(F.lit(year), F.lit(1), F.lit(1))
        end = F.add_months(begin, 12)
    return date_to_ms(begin), date_to_ms(end)


def in_period(ms: Column | str, year: int = 0, month: int = 0, day: int = 0, quarter: int = 0) -> Column:
    """Rows of the period; without a year all rows with a time."""
    c = F.col(ms) if isinstance(ms, str) else ms
    if year <= 0:
        return c.isNotNull()
    begin, end = period_range(year, month, day, quarter)
    return (c >= begin) & (c < end)


def date_to_ms(d: Column) -> Column:
    return F.unix_millis(d.cast("timestamp"))


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def format_ms(ms: Column | str, with_time: bool = False) -> Column:
    """``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm`` in the session time zone."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm" if with_time else "yyyy-MM-dd")


def month_scaffold(bounds: DataFrame, begin: str = "begin_date", end: str = "end_date") -> DataFrame:
    """One row per month between the two dates of each row of ``bounds``."""
    first = F.trunc(F.col(begin), "month")
    last = F.trunc(F.col(end), "month")
    months = F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month_begin")
    return bounds.select(months).select(
        F.year("month_begin").alias("year"),
        F.month("month_begin").alias("month"),
        F.date_format("month_begin", "yyyy-MM-dd").alias("begin_day"),
        F.date_format(F.last_day("month_begin"), "yyyy-MM-dd").alias("end_day"),
        days_in_month(F.col("month_begin")).alias("days"),
    )
