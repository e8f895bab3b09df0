"""Display columns: outcome labels, amounts with units, axis labels, JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tenderloom.schemas import LOT_SCHEMA

# Outcome codes and names.
OUTCOMES = {1: "成交", 2: "废标", 3: "终止"}

# Amount units, greatest first (threshold, factor, unit).
AMOUNT_UNITS = (
    (1e8, "0.00000001", "亿"),
    (1e7, "0.0000001", "千万"),
    (1e6, "0.000001", "百万"),
    (1e4, "0.0001", "万"),
    (1.0, "1", ""),
)

# Texts for missing data.
NO_DATA = "暂无数据"
EMPTY = "/"
OTHER_METHOD = "其他-未知"


def outcome_code(is_win: Column, is_termination: Column) -> Column:
    return (
        F.when(is_win, 1)
        .when(F.coalesce(is_termination, F.lit(False)), 3)
        .otherwise(2)
    )


def outcome_name(code: Column) -> Column:
    return F.element_at(
        F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), code
    )


def amount_text(amount: Column, digits: int = 4) -> Column:
    """``12345.5`` as ``1.2346万元``; amounts below 1 are shown as they are.

    The division is a decimal product, so halves round up on every platform.
    """
    plain = F.regexp_replace(amount.cast("string"), r"\.0$", "")
    text = F.when(amount.isNull(), F.lit(None).cast("string"))
    for threshold, factor, unit in AMOUNT_UNITS:
        scaled = amount.cast("decimal(24,4)") * F.lit(factor).cast("decimal(9,8)")
        shown = F.round(scaled, digits).cast(f"decimal(30,{digits})").cast("string")
        text = text.when(amount >= threshold, F.concat(shown, F.lit(f"{unit}元")))
    return text.otherwise(plain)


def text_or(value: Column, label: str = NO_DATA) -> Column:
    """Null or empty text becomes the label."""
    return F.when(value.isNull() | (F.length(value) == 0), F.lit(label)).otherwise(value)


def number_or(value: Column, label: str = NO_DATA) -> Column:
    """Null or negative numbers become the label."""
    shown = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.when(value.isNull() | (value < 0), F.lit(label)).otherwise(shown)


def axis_label(month: Column, day: Column, quarter: Column) -> Column:
    """``03月09日`` for a day row, ``3月`` for a month row, ``第1季度`` for a quarter row."""
    return (
        F.when(
            day != 0,
            F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("月"), F.lpad(day.cast("string"), 2, "0"), F.lit("日")),
        )
        .when(month != 0, F.concat(month.cast("string"), F.lit("月")))
        .when(quarter != 0, F.concat(F.lit("第"), quarter.cast("string"), F.lit("季度")))
    )


def method_name(method: Column) -> Column:
    return F.coalesce(method, F.lit(OTHER_METHOD))


def decode_lots(text: Column) -> Column:
    return F.from_json(text, ArrayType(LOT_SCHEMA))


def decode_names(text: Column) -> Column:
    return F.from_json(text, ArrayType(StringType()))
