"""Declared schemas and the fixed codes of the notice model.

Schemas are never inferred: a 100 TB JSON topic must not be read twice just to
learn its columns.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

# Sentinels of the notice model.
BUDGET_UNASSIGNED = -1.0
AMOUNT_NOT_DEAL = -1.0
AMOUNT_UNASSIGNED = -2.0

# District codes.
PROVINCE_CODE = 459900
PROVINCE_ROOT_CODE = 450000
PROVINCE_STATS_CODE = 0

# Detail types of usable result notices.
DETAIL_TYPES = {
    "win_and_deal": 3004,
    "win": 4005,
    "not_win": 3007,
    "deal": 4006,
    "termination": 3015,
}

# Fixed value: year label of an all-years total.
TOTAL_YEAR = 10000

# Fixed value: purchase notices before 2022-01-01 (Beijing time) are not usable.
FIRST_USABLE_MS = 1640966400000

LOT_SCHEMA = StructType(
    [
        StructField("name", StringType()),
        StructField("index", IntegerType()),
        StructField("is_win", BooleanType()),
        StructField("budget", DoubleType()),
        StructField("amount", DoubleType()),
        StructField("is_percent", BooleanType()),
        StructField("supplier", StringType()),
        StructField("supplier_address", StringType()),
        StructField("reason", StringType()),
    ]
)

_ids = ArrayType(StringType(), containsNull=False)
_times = ArrayType(LongType(), containsNull=False)

NOTICE_SCHEMA = StructType(
    [
        StructField("result_source_article_id", StringType()),
        StructField("purchase_source_article_id", StringType()),
        StructField("title", StringType()),
        StructField("purchase_title", StringType()),
        StructField("scrape_timestamp", LongType()),
        StructField("project_name", StringType()),
        StructField("project_code", StringType()),
        StructField("district_code", StringType()),
        StructField("district_name", StringType()),
        StructField("author", StringType()),
        StructField("catalog", StringType()),
        StructField("procurement_method", StringType()),
        StructField("bid_opening_time", LongType()),
        StructField("is_win_bid", BooleanType()),
        StructField("result_article_id", _ids),
        StructField("result_publish_date", _times),
        StructField("purchase_article_id", _ids),
        StructField("purchase_publish_date", _times),
        StructField("total_budget", DoubleType()),
        StructField("bid_items", ArrayType(LOT_SCHEMA)),
        StructField("total_amount", DoubleType()),
        StructField("tender_duration", LongType()),
        StructField("purchaser", StringType()),
        StructField("purchasing_agency", StringType()),
        StructField("review_expert", _ids),
        StructField("purchase_representative", _ids),
        StructField("is_termination", BooleanType()),
        StructField("termination_reason", StringType()),
    ]
)

DISTRICT_SCHEMA = StructType(
    [
        StructField("code", IntegerType(), False),
        StructField("name", StringType()),
        StructField("full_name", StringType()),
        StructField("short_name", StringType()),
        StructField("parent_code", IntegerType()),
        StructField("type", ShortType()),
    ]
)

RAW_LIST_SCHEMA = StructType(
    [
        StructField("title", StringType()),
        StructField("publishDate", LongType()),
        StructField("pathName", StringType()),
        StructField("articleId", StringType()),
        StructField("author", StringType()),
        StructField("districtCode", StringType()),
        StructField("districtName", StringType()),
        StructField("gpCatalogName", StringType()),
        StructField("procurementMethod", StringType()),
        StructField("bidOpeningTime", LongType()),
    ]
)

RAW_LINK_SCHEMA = StructType(
    [
        StructField("order", IntegerType()),
        StructField("isExist", BooleanType()),
        StructField("publishDateTime", LongType()),
        StructField("typeName", StringType()),
        StructField("articleId", StringType()),
    ]
)

RAW_DETAIL_SCHEMA = StructType(
    [
        StructField("articleId", StringType()),
        StructField("title", StringType()),
        StructField("projectCode", StringType()),
        StructField("projectName", StringType()),
        StructField("districtCode", StringType()),
        StructField("announcementType", IntegerType()),
        StructField("publishDate", LongType()),
        StructField("content", StringType()),
        StructField("announcementLinkDtoList", ArrayType(RAW_LINK_SCHEMA)),
    ]
)


#: A district document; ``children`` keeps the JSON text of the next generation.
DISTRICT_NODE = StructType(
    [
        StructField("code", StringType()),
        StructField("name", StringType()),
        StructField("fullName", StringType()),
        StructField("shortName", StringType()),
        StructField("isLeaf", BooleanType()),
        StructField("children", StringType()),
    ]
)
