"""Dense ids, keyed upserts and counted writes of tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tenderloom.session import checkpoint_root

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_dense_id(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Add a 0-based dense id in ``order``.

    Rows are range-partitioned and sorted, numbered inside their partition and
    written once; the number of rows per partition then gives the offset of each.
    The written copy keeps both readings of the partitions equal when an executor
    is lost.  ``order`` should be unique, else equal rows may swap ids.
    """
    checkpoint_root(df.sparkSession)
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    )
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per partition of the sort, so the single window partition stays small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + in_part)
        .drop("_mid", "_part", "_offset")
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once: written to the shared folder and read back, with its columns prunable."""
    return stored_and_counted(df, name, {})[0]


def stored_and_counted(df: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`stored`, with aggregates over the rows as they are written."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    found = {}
    if counts:
        found = save_counted(df, path, counts)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), found


def latest_rows(rows: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """One row of each key: the one with the greatest ``latest``, ties by the row's values."""
    rest = [c for c in rows.columns if c != key]
    order = ([latest] if latest else []) + [c for c in rest if c != latest]
    winner = rows.groupBy(key).agg(F.max(F.struct(*order)).alias("row"))
    return winner.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key.

    Several new rows of one key: the winner of :func:`latest_rows`.
    """
    fresh = latest_rows(new, key, latest)
    if latest and latest not in old.columns:
        fresh = fresh.drop(latest)
    return old.join(fresh, key, "left_anti").unionByName(fresh)


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Affected keys of an upsert, each marked as inserted or updated."""
    keys = new.select(key).distinct()
    known = old.select(key).distinct().withColumn("known", F.lit(True))
    return keys.join(known, key, "left").select(
        key, F.when(F.col("known"), F.lit("updated")).otherwise(F.lit("inserted")).alias("action")
    )


def without_keys(seen: DataFrame, remove: DataFrame, key: str) -> DataFrame:
    """Take keys out of a set; write the result over the set."""
    return seen.join(remove.select(key).distinct(), key, "left_anti")


def save_counted(
    df: DataFrame, path: str, counts: dict[str, Column], keep: Column | None = None
) -> dict[str, int]:
    """Replace a parquet table and return ``counts``, aggregates over the rows as they are written.

    Rows that ``keep`` rejects are counted, but not written.  The counts are taken in the tasks that
    write, where Spark counts each partition once however often its task ran, so they cost no scan and
    equal a recount.  ``df`` should not be read by another action.
    """
    seen = Observation()
    rows = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
    (rows if keep is None else rows.filter(keep)).write.mode("overwrite").parquet(path)
    return seen.get
