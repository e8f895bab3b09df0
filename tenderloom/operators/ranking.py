"""Top rows per group, running totals, ranks and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Page bounds.
PAGE_SIZE_RANGE = (10, 50)
PAGE_NO_RANGE = (1, 3000)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows per group in a total order, with their ``rank``.

    Spark turns the ``rank <= n`` filter into a group limit before the shuffle, so
    a hot group sends ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], pick: Sequence[str]
) -> DataFrame:
    """One row per group, the least in ``order``.

    A struct minimum combines on the map side; no group is ever sorted in one task.
    """
    parts = [c.alias(f"o{i}") for i, c in enumerate(order)] + [F.col(c) for c in pick]
    best = df.groupBy(*keys).agg(F.min(F.struct(*parts)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in pick])


def nulls_last(col: str) -> list[Column]:
    """Sort keys that put null behind every value."""
    return [F.col(col).isNull(), F.col(col)]


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Running sum in time order.  Meant for rows already folded to a calendar grain."""
    w = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(name, F.sum(value).over(w))


def rank_with_bounds(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rank by ``value`` descending together with the least and greatest value of the group."""
    group = Window.partitionBy(*keys)
    return df.withColumns(
        {
            "rank": F.rank().over(group.orderBy(F.col(value).desc())),
            "min_value": F.min(value).over(group),
            "max_value": F.max(value).over(group),
        }
    )


def check_page(page_no: int, page_size: int) -> None:
    lo, hi = PAGE_SIZE_RANGE
    if not lo <= page_size <= hi:
        raise ValueError(f"page size must be {lo} to {hi}")
    lo, hi = PAGE_NO_RANGE
    if not lo <= page_no <= hi:
        raise ValueError(f"page number must be {lo} to {hi}")


def page(df: DataFrame, order: Sequence[str | Column], page_no: int, page_size: int) -> DataFrame:
    """Rows of one page (numbered from 1); ``order`` must end in a unique column.

    The plan is a top-k: each task keeps ``offset + size`` rows, at most 150,000
    by the page bounds.
    """
    check_page(page_no, page_size)
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def page_after(
    df: DataFrame, order: Sequence[str], after: Sequence[object], page_size: int
) -> DataFrame:
    """The ``page_size`` rows that follow the row with the values ``after`` in ``order`` (ascending, ending
    in a unique column; values are not null)."""
    check_page(1, page_size)
    later, same = F.lit(False), F.lit(True)
    for name, value in zip(order, after, strict=True):
        later = later | (same & (F.col(name) > F.lit(value)))
        same = same & (F.col(name) == F.lit(value))
    # The first condition alone follows from the whole and reaches the scan.
    return df.filter(F.col(order[0]) >= F.lit(after[0])).filter(later).orderBy(*order).limit(page_size)
