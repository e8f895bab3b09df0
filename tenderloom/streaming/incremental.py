"""Incremental reports: day cells per micro-batch, cubes on demand.

The state of a cube is its table of day cells.  A micro-batch writes its own cells
under ``batch=<id>``; a replayed batch overwrites its folder, so the table is the
same after a failure.  The cube merges the cells of all batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderloom.operators.cube import GRAINS, SCOPES, Measure, cube_from_partials, day_partials
from tenderloom.operators.tables import stored
from tenderloom.sources.sinks import for_each_batch


def fold_stream(
    notices: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    measures: Callable[[], Sequence[Measure]],
) -> StreamingQuery:
    """Fold a stream of notices into day cells under ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cells = day_partials(batch, keys, measures())
        cells.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return for_each_batch(notices, write, checkpoint)


def cube_of_cells(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    measures: Callable[[], Sequence[Measure]],
    grains: Sequence[str] = tuple(GRAINS),
    scopes: Sequence[str] = SCOPES,
) -> DataFrame:
    cells = spark.read.parquet(path).drop("batch")
    return cube_from_partials(cells, keys, measures(), grains, scopes)


def compact_cells(
    spark: SparkSession, path: str, target: str, keys: Sequence[str], measures: Callable[[], Sequence[Measure]]
) -> None:
    """Merge the cells of all batches into one table at ``target`` (a new folder)."""
    how = {n: way for m in measures() for n, (_, way) in m.partials.items()}
    merge = {"sum": F.sum, "max": F.max, "min": F.min}
    cells = spark.read.parquet(path)
    merged = cells.groupBy(*keys, "district_code", "year", "month", "day").agg(
        *[merge[w](n).alias(n) for n, w in how.items()]
    )
    merged.write.mode("errorifexists").parquet(f"{target}/batch=0")


def daily_counts(notices: DataFrame, delay: str = "2 days", time_col: str = "ts") -> DataFrame:
    """Notices per district and tumbling day window, with late rows up to ``delay``."""
    return (
        notices.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, "1 day"), "district_code")
        .agg(F.count("*").alias("count"))
        .select(F.col("window.start").alias("day"), "district_code", "count")
    )


def window_counts(rows: DataFrame, time_col: str, keys: Sequence[str]) -> DataFrame:
    """(day, keys, count) of the rows with a time."""
    day = F.date_trunc("day", time_col)
    return rows.filter(F.col(time_col).isNotNull()).groupBy(day.alias("day"), *keys).agg(F.count("*").alias("count"))


def fold_windows(
    rows: DataFrame, path: str, checkpoint: str, time_col: str, keys: Sequence[str], delay_hours: int = 48
) -> StreamingQuery:
    """Day counts of a stream whose rows come out of order, each day written once, when it is closed.

    The watermark of a micro-batch is the greatest time of the batches before it less ``delay_hours``, as
    in Spark's own append mode.  That mode drops rows of closed days and cannot hand them on; here they
    go to a table of their own, as do rows without a time, so closed, open and late rows together are
    all rows.  Under ``path``: ``closed`` counts, ``late`` rows, and ``open``, the counts of days that are
    not closed, which is the whole state and is carried from batch to batch.  A batch reads its rows and
    the open days of the one before; a replayed batch writes its own folders again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, seen = None, None
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/open/batch={batch_id - 1}")
            seen = spark.read.parquet(f"{path}/bounds/batch={batch_id - 1}").first().seen
        end = F.date_trunc("day", time_col) + F.expr("interval 1 day")
        mark = F.lit(seen).cast("timestamp") - F.expr(f"interval {delay_hours} hours")
        late = F.col(time_col).isNull() | F.coalesce(end <= mark, F.lit(False))
        batch = batch.persist()
        try:
            batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            bounds = batch.agg(F.greatest(F.max(time_col), F.lit(seen).cast("timestamp")).alias("seen"))
            bounds.write.mode("overwrite").parquet(f"{path}/bounds/batch={batch_id}")
            now = spark.read.parquet(f"{path}/bounds/batch={batch_id}").first().seen
            counts = window_counts(batch.filter(~late), time_col, keys)
            if before is not None:
                counts = counts.unionByName(before).groupBy("day", *keys).agg(F.sum("count").alias("count"))
            mark = F.lit(now).cast("timestamp") - F.expr(f"interval {delay_hours} hours")
            done = F.coalesce(F.col("day") + F.expr("interval 1 day") <= mark, F.lit(False))
            counts = stored(counts.withColumn("_closed", done), "day-counts")
            for name, keep in (("closed", F.col("_closed")), ("open", ~F.col("_closed"))):
                counts.filter(keep).drop("_closed").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return for_each_batch(rows, write, checkpoint)


def read_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closed counts, the counts still open after the last batch, and all late rows."""
    last = spark.read.parquet(f"{path}/bounds").agg(F.max("batch")).first()[0]
    closed, late = (spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("closed", "late"))
    return closed, spark.read.parquet(f"{path}/open/batch={last}"), late


def running_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts for a complete-mode stream."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))


def fold_unique(rows: DataFrame, path: str, checkpoint: str, key: str, files: int = 8) -> StreamingQuery:
    """One row of each key for ever, under ``path``; late rows and late repeats are treated like any other.

    The keys are Spark's keyed state, without a watermark, so none is ever forgotten.  A micro-batch
    looks up its own keys and uploads the new ones; what earlier batches stored is not read again.
    Of several rows of a key in its first micro-batch one is kept, which one is not defined.  Null is
    a key like others.  The rows of a batch are written once, into ``batch=<id>``; a replayed batch
    starts from the state before it and overwrites its folder.  A batch writes ``files`` files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The state has a fixed number of partitions, which Spark does not merge; files follow the batch.
        batch.repartition(files).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return for_each_batch(rows.dropDuplicates([key]), write, checkpoint)


def latest_seen(rows: DataFrame, time_col: str = "scrape_timestamp") -> DataFrame:
    """Greatest publish time so far, for a complete-mode stream."""
    return rows.agg(F.max(time_col).alias("latest_timestamp"))


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of parquet files with the schema of those that are there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
