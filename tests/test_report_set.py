"""The report set shares passes over the notices and gives the rows of the single reports."""

import os

import pytest
from pyspark.sql import functions as F

from tenderloom.plans import reports as R
from tenderloom.schemas import LOT_SCHEMA

SINGLE = {
    "bidding_district_stats": R.district_levels,
    "procurement_stats": R.method_counts,
    "bidding_stats": R.outcome_counts,
    "bidding_budget_stats": R.budget_situation,
    "transactions_volumes": R.volumes,
    "purchaser_catalog_stats": R.purchaser_catalogs,
    "purchaser_agency_stats": R.purchaser_agencies,
    "catalog_stats": R.catalog_counts,
    "agency_stats": R.agency_counts,
    "agency_catalog_stats": R.agency_top_catalog,
}
OWN_PASS = ("purchaser_stats", "supplier_transactions", "supplier_catalogs", "supplier_address")


@pytest.fixture(scope="module")
def notices(spark, tmp_path_factory):
    """Nulls in every column, a hot district, unknown codes, amounts below 0."""
    k = F.col("id")
    some = lambda every, value: F.when(k % every != 0, value)
    path = str(tmp_path_factory.mktemp("set") / "notices")
    spark.range(0, 900, 1, 3).select(
        some(97, F.lit(1680000000000) + k * 3600000 * 11).alias("scrape_timestamp"),
        some(31, F.when(k % 3 == 0, 450100).otherwise(450000 + (k % 40) * 5)).cast("int").alias("district_code"),
        some(7, F.concat(F.lit("M"), k % 3)).alias("procurement_method"),
        some(29, k % 2 == 0).alias("is_win_bid"),
        some(37, k % 5 == 0).alias("is_termination"),
        some(19, (k % 90 - 10) * 1.25).cast("double").alias("total_amount"),
        some(23, (k % 70 - 20) * 2.5).cast("double").alias("total_budget"),
        some(11, F.concat(F.lit("B"), k % 13)).alias("purchaser"),
        some(13, F.when(k % 6 == 0, "/").otherwise(F.concat(F.lit("A"), k % 4))).alias("purchasing_agency"),
        some(17, F.concat(F.lit("C"), k % 3)).alias("catalog"),
        F.array().cast(f"array<{LOT_SCHEMA.simpleString()}>").alias("bid_items"),
    ).write.parquet(path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_and_passes(spark, notices):
    table = spark.read.parquet(notices)
    found = R.all_reports(table)
    assert set(found) == {*SINGLE, *OWN_PASS}
    for name, single in SINGLE.items():
        got, want = found[name], single(table)
        assert got.schema.fieldNames() == want.schema.fieldNames()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
        assert os.path.dirname(notices) in plan(want) and os.path.dirname(notices) not in plan(got)
    for name in OWN_PASS:
        assert plan(found[name]).count(os.path.dirname(notices)) == 1, name


def test_two_passes_are_read(spark, notices):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.read.parquet(notices)
    found = R.all_reports(table.mapInArrow(count, table.schema))
    for name in SINGLE:
        found[name].collect()
    assert read.value == 2 * 900


def test_single_outcomes(spark, notices):
    table = spark.read.parquet(notices)
    joint = R.joint_reports(R.joint_cells(table))
    for name, single in (("win_count", R.win_counts), ("lose_count", R.lose_counts), ("terminate_count", R.terminate_counts)):
        assert sorted(map(str, joint[name].collect())) == sorted(map(str, single(table).collect()))
    empty = R.joint_reports(R.joint_cells(table.limit(0)))
    assert {name: df.count() for name, df in empty.items() if df.count()} == {"levels": 1}
