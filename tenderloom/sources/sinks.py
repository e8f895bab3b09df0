"""Table, console, JDBC and JSON sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderloom.operators.tables import with_dense_id
from tenderloom.sources.notices import from_row_format, to_row_format


def jdbc_options(url: str, table: str, **options: str) -> dict[str, str]:
    """JDBC write options; credentials come from the caller."""
    return {
        "url": url,
        "dbtable": table,
        "batchsize": "10000",
        "isolationLevel": "NONE",
        "truncate": "true",
        **options,
    }


def numbered_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Row format plus the dense ``id`` column of the stored tables."""
    return with_dense_id(to_row_format(df), order)


def save_jdbc(df: DataFrame, url: str, table: str, order: Sequence[str], **options: str) -> None:
    """Replace the rows of a database table, keeping its definition."""
    rows = numbered_rows(df, order)
    rows.write.mode("overwrite").format("jdbc").options(**jdbc_options(url, table, **options)).save()


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a parquet table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, defaults: dict | None = None) -> DataFrame:
    return from_row_format(spark.read.parquet(path), defaults)


def by_month(notices: DataFrame) -> DataFrame:
    """Add year and month and bring the rows of a month together: small months share a task, the rows of
    a large one are split over several by their measured size."""
    ts = F.timestamp_millis("scrape_timestamp")
    return notices.withColumns({"year": F.year(ts), "month": F.month(ts)}).hint("rebalance", "year", "month")


def save_notices(notices: DataFrame, path: str) -> None:
    """Notice table in year and month folders, so that period filters prune files."""
    save_table(by_month(notices), path, ("year", "month"))


def save_json_by_month(notices: DataFrame, path: str) -> None:
    """Notices as JSON lines, one folder per month of publication."""
    by_month(notices).write.mode("overwrite").partitionBy("year", "month").json(path)


def show(df: DataFrame, rows: int = 25, truncate: bool = False) -> None:
    if df.isStreaming:
        raise ValueError("use show_stream for a streaming frame")
    df.show(n=rows, truncate=truncate)


def show_stream(df: DataFrame, mode: str = "complete", rows: int = 25, truncate: bool = False) -> StreamingQuery:
    if not df.isStreaming:
        raise ValueError("use show for a frame that is not streaming")
    return (
        df.writeStream.outputMode(mode).format("console").options(truncate=truncate, numRows=rows).start()
    )


def for_each_batch(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run a batch function on every micro-batch until the available data is used up."""
    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
