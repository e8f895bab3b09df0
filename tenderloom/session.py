"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state of streams: on local disk beside the executor, only changes are uploaded at a commit.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Set unless the session has a value of its own: by Spark's 64 MB of moved rows, which are packed and
# compressed, a task that groups them holds a gigabyte.
SIZE_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def get_session(app_name: str = "tenderloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's settings; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_engine_settings(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else made."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    for key, value in SIZE_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; a folder of our own is set
    only when that is missing and the session runs inside one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if root:
        if not current:
            spark.sparkContext.setCheckpointDir(root)
        return root
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"tenderloom-{spark.sparkContext.applicationId}")
    spark.sparkContext.setCheckpointDir(root)
    return root
