"""A stored table with one row per key, in hash buckets that are replaced alone.

Rows lie in folders ``_bucket=<n>`` by a hash of their key.  An upsert reads and replaces only the
buckets in which a key changes, by dynamic partition overwrite; the files of all others stay as
they are.  The merged buckets are written beside the store first.  If the run is cut off while
buckets are replaced, ``replace`` with that copy finishes it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.operators.tables import latest_rows, stored

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedStore:
    """``buckets`` is fixed for the life of a store; take about one for each file's worth of rows."""

    path: str
    key: str
    buckets: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame, latest: str | None = None) -> None:
        """A new store of the winners of ``rows`` (see :func:`latest_rows`)."""
        self.replace(latest_rows(rows, self.key, latest).withColumn(BUCKET, self.bucket()))

    def replace(self, merged: DataFrame) -> None:
        """Replace the buckets that ``merged`` has rows in; large ones become several files."""
        merged.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(BUCKET)

    def _as_stored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the types of the store: the bucket of a key depends on its type."""
        kept = rows.sparkSession.read.parquet(self.path).drop(BUCKET).schema
        return rows.select([F.col(f.name).cast(f.dataType) for f in kept if f.name in rows.columns])

    def touched(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the buckets in which ``keys`` lie; the other folders are not read."""
        buckets = self._as_stored(keys).select(self.bucket().alias(BUCKET)).distinct()
        here = [r[BUCKET] for r in buckets.collect()]  # at most ``buckets`` rows
        return keys.sparkSession.read.parquet(self.path).filter(F.col(BUCKET).isin(here))

    def look_up(self, keys: DataFrame) -> DataFrame:
        """Stored rows of the asked keys."""
        return self.touched(keys).drop(BUCKET).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def upsert(self, new: DataFrame, latest: str | None = None) -> None:
        """Insert the rows of ``new`` or put them in place of those with their key.  The columns of the
        store stay: those it does not have are left out, those ``new`` does not have become null."""
        fresh = stored(self._as_stored(latest_rows(new, self.key, latest)), "upsert-winners")
        old = self.touched(fresh).drop(BUCKET)
        replaced = fresh.select(F.col(self.key).alias("_replaced"))
        kept = old.join(replaced, F.col(self.key).eqNullSafe(F.col("_replaced")), "left_anti")
        merged = kept.unionByName(fresh, allowMissingColumns=True)
        self.replace(stored(merged.withColumn(BUCKET, self.bucket()), "upsert-merged"))
