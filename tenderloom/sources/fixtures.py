"""Maps the star-schema test tables to the notice model.

The joins and text columns below stand in for a stored notice table, a lot table
and raw announcement tables; nothing is sampled and every row is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.plans.districts import OWN_LEVEL_SUFFIX
from tenderloom.plans.reports import level_of
from tenderloom.schemas import PROVINCE_ROOT_CODE


#: Least parts per core of a join of large tables.
PARTS_PER_CORE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(col: str):
    return F.col(col).cast("string")


def district_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as districts of every kind: city, city itself, district, province."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    tail = F.when(n < 5, 0).when(n < 10, 99).when(n < 15, 2).when(n < 20, 3).otherwise(4)
    code = F.when(n == 24, 459900).otherwise(450000 + (r + 1) * 100 + tail)
    return table(spark, sf_dir, "nation").select(
        n.alias("nation"), code.cast("int").alias("code"), F.col("n_name").alias("name")
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District dimension with the province root."""
    base = district_codes(spark, sf_dir).select("code", "name")
    # The root row takes its place from the table as well: one row, whatever its size.
    root = base.agg(F.lit(PROVINCE_ROOT_CODE).alias("code"), F.max(F.lit("ROOT")).alias("name"))
    code = F.col("code")
    parent = (
        F.when(code == PROVINCE_ROOT_CODE, -1)
        .when((code % 100 == 0) | (code == 459900), PROVINCE_ROOT_CODE)
        .otherwise(code - code % 100)
    )
    own = F.when((code % 100 == 99), F.concat("name", F.lit(OWN_LEVEL_SUFFIX))).otherwise(F.col("name"))
    return base.unionByName(root).select(
        "code",
        own.alias("name"),
        F.concat(F.lit("FULL-"), "name").alias("full_name"),
        F.col("name").alias("short_name"),
        parent.cast("int").alias("parent_code"),
        level_of(code).cast("smallint").alias("type"),
    )


def notices(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders as notices, one row per order, without their lots; ``orders`` may be a stream."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    customer = table(spark, sf_dir, "customer")
    place = district_codes(spark, sf_dir)
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        place, F.col("c_nationkey") == F.col("nation")
    )
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    return joined.select(
        key.alias("id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("scrape_timestamp"),
        F.col("code").alias("district_code"),
        F.col("name").alias("district_name"),
        F.concat(F.lit("AUTHOR-"), (cust % 7).cast("string")).alias("author"),
        F.col("c_mktsegment").alias("catalog"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("procurement_method"),
        F.col("c_name").alias("purchaser"),
        F.when(cust % 10 == 0, F.lit(None).cast("string"))
        .when(cust % 10 == 1, F.lit("/"))
        .otherwise(F.concat(F.lit("AGENCY-"), (cust % 10).cast("string")))
        .alias("purchasing_agency"),
        (status == "F").alias("is_win_bid"),
        (status == "P").alias("is_termination"),
        F.when(status == "F", F.col("o_totalprice"))
        .when(key % 5 == 0, F.lit(-1.0))
        .otherwise(F.lit(0.0))
        .alias("total_amount"),
        F.when(key % 11 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice") * 1.1).alias("total_budget"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lots, keyed by notice id; several lots may share an index."""
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )
    percent, lost = F.col("l_linenumber") == 7, F.col("l_returnflag") == "R"
    rest = 1 - F.col("l_discount")
    return joined.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("index"),
        F.col("p_name").alias("name"),
        (~lost).alias("is_win"),
        F.col("l_extendedprice").alias("budget"),
        F.when(percent, 100 * rest).otherwise(F.col("l_extendedprice") * rest).alias("amount"),
        percent.alias("is_percent"),
        F.when(F.col("l_quantity") != 50, F.col("s_name")).alias("supplier"),
        F.concat(F.lit("ADDR-"), (F.col("l_partkey") % 3).cast("string")).alias("supplier_address"),
        F.when(lost, F.concat(F.lit("REASON-"), "l_linestatus")).alias("reason"),
    )


def notice_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat lots with the columns of their notice: what ``lots_of`` gives on nested records.

    Both sides are dealt alike to a fixed number of parts: by the size of the moved rows Spark would make
    few, and the joined rows and what is grouped from them in the same tasks are many times larger."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_CORE * spark.sparkContext.defaultParallelism)
    both = (df.repartition(parts, "id") for df in (lots(spark, sf_dir), notices(spark, sf_dir)))
    return next(both).join(next(both), "id")
