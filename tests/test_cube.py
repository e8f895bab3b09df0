"""The calendar cube on small frames: grains, nulls and invariants."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tenderloom.operators.cube import (
    calendar_cube,
    complete_time_columns,
    count_rows,
    cube_from_partials,
    day_partials,
    grain_rows,
    money_avg,
    money_sum,
)
from tenderloom.plans import reports as R

SCHEMA = (
    "id long, scrape_timestamp long, district_code int, is_win_bid boolean, is_termination boolean, "
    "total_amount double, total_budget double, procurement_method string"
)


def ms(*day):
    return int(datetime(*day, tzinfo=timezone.utc).timestamp() * 1000)


def frame(spark):
    rows = [
        (1, ms(2023, 1, 31, 23, 59, 59), 450100, True, False, 10.0, 12.0, "open"),
        (2, ms(2023, 2, 1), 450100, True, False, 5.5, -1.0, None),
        (3, ms(2023, 4, 1), None, True, None, 1.25, 2.0, "open"),
        (4, ms(2024, 2, 29), 450199, False, False, -1.0, 3.0, "talks"),
        (5, ms(2024, 2, 29), 450102, False, True, None, None, "talks"),
        (6, None, 450102, None, None, 7.0, 8.0, "open"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_grains_and_scopes(spark):
    cube = R.volumes(frame(spark))
    rows = as_dict(cube, "district_code", "year", "month", "day", "quarter")
    assert rows[(450100, 2023, 0, 0, 1)].transactions_volume == 15.5
    assert rows[(450100, 2023, 1, 31, 0)].transactions_volume == 10.0
    assert rows[(0, 2023, 0, 0, 0)].transactions_volume == 16.75
    assert rows[(0, 2023, 4, 0, 0)].transactions_volume == 1.25


def test_null_district_is_not_the_province(spark):
    rows = as_dict(R.volumes(frame(spark)), "district_code", "year", "month", "day", "quarter")
    assert rows[(None, 2023, 0, 0, 0)].transactions_volume == 1.25


def test_null_time_keeps_its_own_cell(spark):
    cube = calendar_cube(frame(spark), [], [count_rows("n")])
    years = grain_rows(cube.filter(F.col("district_code") == 450102), "year").collect()
    assert {(r.year, r.n) for r in years} == {(2024, 1), (None, 1)}


def test_outcomes_keep_periods_without_a_win(spark):
    rows = as_dict(R.outcome_counts(frame(spark)), "district_code", "year", "month", "day", "quarter")
    row = rows[(0, 2024, 2, 29, 0)]
    assert (row.win_count, row.lose_count, row.terminate_count) == (0, 1, 1)


def test_null_method_counts_zero(spark):
    rows = as_dict(
        R.method_counts(frame(spark)), "district_code", "procurement_method", "year", "month", "day", "quarter"
    )
    row = rows[(450100, None, 2023, 2, 1, 0)]
    assert (row["count"], row.total_amount) == (0, 5.5)


def test_budget_situation_clamps_before_averaging(spark):
    rows = as_dict(R.budget_situation(frame(spark)), "district_code", "year", "month", "day", "quarter")
    year = rows[(450100, 2023, 0, 0, 0)]
    assert (year.amount_sum, year.amount_max, year.amount_avg) == (15.5, 10.0, 7.75)
    assert (year.budget_sum, year.budget_avg) == (12.0, 6.0)


def test_every_grain_adds_up(spark):
    cube = calendar_cube(frame(spark).filter("scrape_timestamp is not null"), [], [count_rows("n")])
    province = cube.filter("district_code = 0")
    totals = {g: grain_rows(province, g).agg(F.sum("n")).first()[0] for g in ("day", "month", "quarter", "year")}
    assert set(totals.values()) == {5}
    districts = grain_rows(cube.filter("district_code <> 0 or district_code is null"), "year")
    assert districts.agg(F.sum("n")).first()[0] == 5


def test_partials_of_two_batches_merge(spark):
    df = frame(spark)
    measures = [money_sum("s", "total_budget"), money_avg("a", "total_budget"), count_rows("n")]
    cells = day_partials(df.filter("id <= 2"), [], measures).unionByName(
        day_partials(df.filter("id > 2"), [], measures)
    )
    merged = cube_from_partials(cells, [], measures)
    whole = calendar_cube(df, [], measures)
    key = ["district_code", "year", "month", "day", "quarter"]
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0
    assert key == merged.columns[:5]


def test_hot_key_shuffles_one_row_per_task(spark):
    rows = spark.range(0, 60000, 1, 4).select(
        (F.lit(ms(2023, 1, 1)) + F.col("id") % 7).alias("scrape_timestamp"),
        F.lit(450100).alias("district_code"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("supplier"),
    )
    cube = calendar_cube(rows, ["supplier"], [count_rows("n")], ("year",), ("province",))
    assert cube.filter("supplier = 'hot'").first().n == 20000
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1 and plan.count("Exchange") == 2


def test_complete_time_columns(spark):
    df = spark.createDataFrame([(2023, 1)], "year int, quarter int")
    assert complete_time_columns(df).first().asDict() == {"year": 2023, "quarter": 1, "month": 0, "day": 0}


def test_levels_are_exclusive_and_complete(spark):
    codes = [459900, 450000, 450100, 450199, 450102, None]
    df = spark.createDataFrame([(c, 1.0) for c in codes], "district_code int, total_amount double")
    row = R.district_levels(df).first()
    assert (row.provincial_count, row.municipal_count, row.district_count) == (2, 2, 1)
    assert row.total_count == 6 and row.total_amount == 6.0


def test_levels_of_nothing_are_zero(spark):
    df = spark.createDataFrame([], "district_code int, total_amount double")
    row = R.district_levels(df).first()
    assert row.provincial_amount == 0.0 and row.total_count == 0


def test_lots_of_nested_notices(spark):
    rows = [
        (ms(2023, 1, 1), 450100, "goods", True, 200.0, [("a", 1, True, 1.0, 50.0, True, "S1", "A1", None)]),
        (ms(2023, 1, 1), 450100, "goods", True, -1.0, [("a", 1, True, 1.0, 50.0, True, "S1", "A2", None),
                                                     ("b", 2, True, 1.0, 9.5, False, "S1", "A2", None),
                                                     ("c", 3, False, 1.0, -1.0, False, None, None, "x")]),
        (ms(2023, 1, 1), 450100, "works", True, 5.0, []),
    ]
    from tenderloom.schemas import LOT_SCHEMA

    df = spark.createDataFrame(
        rows,
        "scrape_timestamp long, district_code int, catalog string, is_win_bid boolean, total_budget double, "
        f"bid_items array<{LOT_SCHEMA.simpleString()}>",
    )
    lots = R.lots_of(df)
    assert lots.count() == 4
    year = grain_rows(R.supplier_volumes(lots), "year").filter("district_code = 0").first()
    # 50 % of 200, 50 % of an unknown budget, 9.5 in money
    assert (year.transactions_volume, year.bidding_count) == (109.5, 3)
    fraction = grain_rows(R.supplier_volumes(lots, percent_scale="1"), "year").filter("district_code = 0").first()
    assert fraction.transactions_volume == 10009.5
    assert [tuple(r) for r in R.supplier_addresses(lots).collect()] == [("S1", "A2")]
    assert [tuple(r) for r in R.supplier_catalogs(lots).collect()] == [("S1", "goods", 3)]


def test_quartiles_are_exact(spark):
    df = spark.range(0, 50001, 1, 8).select(
        (F.col("id") * 5 % 50001 + 1).cast("double").alias("total_budget"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") + 10.0).alias("total_amount"),
    )
    rows = {r.metric: r for r in R.amount_summary(df).collect()}
    assert [rows[q].total_budget for q in ("25%", "50%", "75%")] == [12501.0, 25001.0, 37501.0]
    # A third of all rows is one value: the first quartile lies in it.
    values = sorted([5.0 if i % 3 == 0 else i + 10.0 for i in range(50001)])
    assert [rows[q].total_amount for q in ("25%", "50%", "75%")] == [values[12500], values[25000], values[37500]]
    assert rows["count"].total_budget == 50001 and rows["max"].total_budget == 50001.0
    assert R.amount_summary(df.limit(0)).filter("metric = 'count'").count() == 0


def test_text_district_codes_are_read_as_numbers(spark):
    df = frame(spark).withColumn("district_code", F.coalesce(F.col("district_code").cast("string"), F.lit("?")))
    for cube in (R.volumes(df), R.method_counts(df)):
        assert {r.district_code for r in cube.select("district_code").distinct().collect()} >= {0, 450100, None}
