"""Kafka readers and writer.  The connector jar comes with spark-submit ``--packages``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter


def kafka_options(servers: str, topics: Sequence[str], starting: str = "earliest") -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }


def kafka_table(spark: SparkSession, servers: str, topics: Sequence[str], **options: str) -> DataFrameReader:
    """Bounded read from the earliest offset."""
    return spark.read.format("kafka").options(**{**kafka_options(servers, topics), **options})


def kafka_stream(spark: SparkSession, servers: str, topics: Sequence[str], **options: str) -> DataStreamReader:
    return spark.readStream.format("kafka").options(**{**kafka_options(servers, topics), **options})


def as_values(df: DataFrame) -> DataFrame:
    """Rows as JSON in a ``value`` column."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def kafka_writer(
    df: DataFrame, servers: str, topic: str, checkpoint: str, mode: str = "append"
) -> DataStreamWriter:
    """Streaming writer of JSON values; call ``start`` on it."""
    return (
        as_values(df)
        .writeStream.outputMode(mode)
        .format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
