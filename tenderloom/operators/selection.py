"""Exact quantiles by refined histograms.

Doubles are mapped to 64-bit numbers in the same order.  A round counts the rows of 2^16 bins of
the numbers and keeps, for each quantile, the bin that holds it; the next round looks 16 bits
deeper inside that bin.  After four rounds the bin is a single value.  The first round reads all
rows and the second all again, to write those of the kept bins; the other rounds read only these.
Counting combines on the map side, so no value is ever sorted or ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.session import checkpoint_root

BIN_BITS = 16
_SHIFTS = (48, 32, 16, 0)
_MANTISSA = 52


def ordered_bits(value: Column) -> Column:
    """A 64-bit number for each double, in the order of the doubles (infinity included, NaN last)."""
    size = F.abs(value)
    # The logarithm may be off by one next to a power of two.
    near = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(power(near) > size, near - 1).when(power(near + 1) <= size, near + 1).otherwise(near)
    exponent = F.greatest(exponent, F.lit(-1022))
    # The fraction is exact; subnormal numbers have one below 1.
    whole = (exponent + 1022) * (1 << _MANTISSA) + (size / power(exponent) * float(1 << _MANTISSA)).cast("bigint")
    top = F.lit(2047 << _MANTISSA)
    bits = (
        F.when(F.isnan(value), top + 1)
        .when(size == float("inf"), top)
        .when(size == 0, F.lit(0).cast("bigint"))
        .otherwise(whole)
    )
    return F.when((value < 0) & ~F.isnan(value), -bits).otherwise(bits)


def first_bins(rows: DataFrame, group: str, value: str, aggregates: Sequence[Column] = ()) -> DataFrame:
    """Round one: at most 2^16 rows (group, bin, rows) of each group, with other mergeable aggregates."""
    checkpoint_root(rows.sparkSession)
    bits = ordered_bits(F.col(value))
    bins = rows.groupBy(group, F.shiftright(bits, _SHIFTS[0]).alias("bin"))
    return bins.agg(F.count("*").alias("rows"), *aggregates).checkpoint()


def _reached(bins: DataFrame, by: list[str]) -> DataFrame:
    """The bin of each group in which the ``wanted``-th row lies, and its number inside."""
    # At most 2^16 bins of a group, whatever the rows.
    upward = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("reached") - F.col("rows")
    placed = bins.withColumn("reached", F.sum("rows").over(upward))
    inside = placed.filter((F.col("reached") >= F.col("wanted")) & (before < F.col("wanted")))
    return inside.withColumn("wanted", F.col("wanted") - before).drop("reached", "rows")


def exact_quantiles(
    rows: DataFrame, bins: DataFrame, group: str, value: str, shares: dict[str, float]
) -> DataFrame:
    """(group, metric, value): the least value with at least that share of its group's rows at or below it.

    ``bins`` are the ``first_bins`` of the rows; groups must be few.  Null values belong to no
    group.  Runs its rounds at once.
    """
    spark = rows.sparkSession
    by = [group, "metric"]
    sizes = bins.groupBy(group).agg(F.sum("rows").alias("n"))
    asked = [F.struct(F.lit(m).alias("metric"), F.greatest(F.ceil(F.col("n") * p), F.lit(1)).alias("wanted")) for m, p in shares.items()]
    wanted = sizes.select(group, F.inline(F.array(*asked)))
    chosen = _reached(bins.select(group, "bin", "rows").join(wanted, group), by)

    def kept(found: DataFrame) -> DataFrame:
        """One row of each group and quantile, as literals: nothing is computed twice."""
        return spark.createDataFrame(found.select(*by, "bin", "wanted").collect(), f"{group} string, metric string, bin long, wanted long")

    chosen = kept(chosen)
    numbered = rows.withColumn("bits", ordered_bits(F.col(value))).withColumn("bin", F.shiftright("bits", _SHIFTS[0]))
    inside = numbered.join(F.broadcast(chosen.drop("wanted")), [group, "bin"]).select(*by, "bits", value).checkpoint()
    for deeper, shift in zip(_SHIFTS, _SHIFTS[1:], strict=False):
        here = inside.withColumn("prefix", F.shiftright("bits", deeper)).join(
            F.broadcast(chosen.withColumnRenamed("bin", "prefix")), [*by, "prefix"]
        )
        counted = here.groupBy(*by, "wanted", F.shiftright("bits", shift).alias("bin")).agg(
            F.count("*").alias("rows"), F.min(value).alias(value)
        )
        last = _reached(counted, by)
        chosen = last if shift == 0 else kept(last)
    return chosen.select(*by, value)
