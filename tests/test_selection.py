"""Order-keeping numbers and exact quantiles against sorting."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from tenderloom.operators.selection import exact_quantiles, first_bins, ordered_bits
from tenderloom.plans.reports import QUARTILES, amount_summary


def java_bits(x):
    bits = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_bits_are_those_of_the_double(spark):
    values = [0.0, 5e-324, 2.2250738585072014e-308, 1.1e-310, 1.0, 0.1, 1.7976931348623157e308, math.inf, 3.0, 1e16 + 2]
    for e in range(-1074, 1024, 7):
        values += [2.0**e, math.nextafter(2.0**e, 0), math.nextafter(2.0**e, math.inf)]
    values += [-v for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "value double").select("value", ordered_bits(F.col("value")).alias("bits"))
    assert all(r.bits == java_bits(r.value) for r in rows.collect())
    nan = spark.createDataFrame([(math.nan,)], "value double").select(ordered_bits(F.col("value")).alias("bits"))
    assert nan.first().bits > java_bits(math.inf)


def nearest_rank(values, share):
    values = sorted(values)
    return values[max(1, math.ceil(len(values) * share)) - 1]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles(spark, seed):
    shares = {"none": 0.0, **QUARTILES, "99%": 0.99, "all": 1.0}
    rows = spark.range(0, 3000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("column"),
        F.when(F.col("id") % 3 == 0, F.exp(20 * F.randn(seed)))
        .when(F.col("id") % 3 == 1, F.round(F.randn(seed + 9), 2))
        .otherwise(7.25 + F.rand(seed) * 1e-13)
        .alias("value"),
    )
    rows = rows.unionByName(spark.createDataFrame([("one", 3.5)] + [("same", -1.0)] * 50, rows.schema)).checkpoint()
    bins = first_bins(rows, "column", "value")
    got = {(r.column, r.metric): r.value for r in exact_quantiles(rows, bins, "column", "value", shares).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r.column, []).append(r.value)
    assert got == {(c, m): nearest_rank(v, p) for c, v in values.items() for m, p in shares.items()}


def test_summary_reads_the_notices_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 1000, 1, 4).select((F.col("id") + 1.0).alias("total_budget"), (F.col("id") * 2.0).alias("total_amount"))
    got = {r.metric: (r.total_budget, r.total_amount) for r in amount_summary(rows.mapInArrow(count, rows.schema)).collect()}
    assert read.value == 2000
    assert got["count"] == (999, 999) and got["50%"] == (501.0, 1000.0)


def test_summary_of_nothing(spark):
    assert amount_summary(spark.createDataFrame([], "total_budget double, total_amount double")).count() == 0
