"""Notice records as JSON values, as table rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from tenderloom.functions.labels import decode_lots, decode_names
from tenderloom.functions.money import clamp
from tenderloom.operators.frames import compute_once
from tenderloom.plans.ingest import quarantine
from tenderloom.schemas import NOTICE_SCHEMA

_CORRUPT = "_corrupt"

# What a null means to a reader of the stored notice table.
NOTICE_DEFAULTS = {
    "scrape_timestamp": -1,
    "district_code": -1,
    "is_win_bid": False,
    "is_termination": False,
    "result_article_id": "[]",
    "result_publish_date": "[]",
    "purchase_article_id": "[]",
    "purchase_publish_date": "[]",
    "bid_items": "[]",
    "review_expert": "[]",
    "purchase_representative": "[]",
    "total_budget": -1.0,
    "total_amount": -1.0,
    "tender_duration": 0,
    "purchaser": "",
    "purchasing_agency": "",
    "id": -1,
}

# Defaults of the statistics tables.
CUBE_DEFAULTS = {
    "district_code": -1,
    "year": -1,
    "month": -1,
    "day": -1,
    "quarter": -1,
    "transactions_volume": -1.0,
    "id": -1,
}


def _parsed(df: DataFrame) -> DataFrame:
    """Parsed fields and the corrupt text; each value is parsed once."""
    schema = StructType([*NOTICE_SCHEMA.fields, StructField(_CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    value = df.filter(F.col("value").isNotNull()).select(F.col("value").cast("string").alias("value"))
    rows = compute_once(value, {"json": F.from_json("value", schema, options)}).select("value", "json.*")
    empty = F.trim("value") == ""
    return rows.withColumn(_CORRUPT, F.when(empty, F.col("value")).otherwise(F.col(_CORRUPT))).drop("value")


def parse_notices(df: DataFrame) -> DataFrame:
    """Notices of a ``value`` column (Kafka bytes or text).

    Deletion marks (null values) hold no record; values that do not parse go to
    :func:`corrupt_notices`.
    """
    return _parsed(df).filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def corrupt_notices(df: DataFrame) -> DataFrame:
    """Quarantine rows of the values that do not parse."""
    bad = _parsed(df).filter(F.col(_CORRUPT).isNotNull())
    return quarantine(
        bad, "notice: json not understood", F.lit(None).cast("string"), F.lit(None), F.col(_CORRUPT)
    )


def with_int_district(notices: DataFrame) -> DataFrame:
    """District code as int; text that is no number becomes null."""
    return notices.withColumn("district_code", F.col("district_code").try_cast("int"))


def clamped(notices: DataFrame) -> DataFrame:
    return notices.withColumns({c: clamp(c) for c in ("total_amount", "total_budget")})


def to_row_format(df: DataFrame) -> DataFrame:
    """Arrays to JSON text and booleans to 1/0 (null to 0), for stores without either."""

    def convert(field: StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, ArrayType):
            return F.to_json(c).alias(field.name)
        if isinstance(field.dataType, BooleanType):
            return F.coalesce(c.cast("int"), F.lit(0)).alias(field.name)
        return c

    return df.select(*[convert(f) for f in df.schema])


def from_row_format(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Stored rows with the defaults of their nulls; 1/0 columns become boolean."""
    values = NOTICE_DEFAULTS if defaults is None else defaults

    def convert(name: str) -> Column:
        c, default = F.col(name), values.get(name)
        if isinstance(default, bool):
            return F.coalesce(c.cast("int") == 1, F.lit(default)).alias(name)
        return c if default is None else F.coalesce(c, F.lit(default)).alias(name)

    return df.select(*[convert(c) for c in df.columns])


def decode_json_columns(df: DataFrame) -> DataFrame:
    """JSON text columns of stored notices back to arrays."""
    return df.withColumns(
        {
            "bid_items": decode_lots(F.col("bid_items")),
            "review_expert": decode_names(F.col("review_expert")),
            "purchase_representative": decode_names(F.col("purchase_representative")),
        }
    )
