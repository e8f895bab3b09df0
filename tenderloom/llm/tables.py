"""Shared helpers of this subpackage: written lineage cuts, Arrow batch passes, bounded bit maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tenderloom.session import checkpoint_root

#: JVM to Python batches are closed at this size, so very long texts do not pile up in one batch.
BATCH_BYTES = 8 << 20
#: Texts are handed to a pass in slices of about this many bytes.
SLICE_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Limit Arrow batches by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes; single rows stay whole."""
    values = batch.column(column)
    if not (pa.types.is_string(values.type) or pa.types.is_binary(values.type)):
        yield from (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024))
        return
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(values).to_pylist()):
        n = n or 0
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def map_column(
    df: DataFrame,
    columns: str | Sequence[str],
    make: Callable[[], Callable[..., dict[str, Sequence]]],
    out: T.StructType,
    carry: Sequence[str],
) -> DataFrame:
    """One Arrow pass: ``make()`` runs once per task and returns a function from the values of
    ``columns`` (a list for each) to the columns of ``out``.  ``carry`` columns pass through
    untouched; a carried column with the name of an output column is replaced by it."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    names = {f.name for f in out.fields}
    carry = [c for c in dict.fromkeys(carry) if c not in names]
    given = [f"_in{i}" for i in range(len(columns))]
    # A column that is carried anyway is not sent twice.
    sources = [c if c in carry else g for c, g in zip(columns, given, strict=True)]
    fields = [df.schema[c] for c in carry]
    types = [pa.field(f.name, to_arrow_type(f.dataType)) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, sources[0]):
                found = work(*[part.column(c).to_pylist() for c in sources])
                arrays = [part.column(c) for c in carry]
                arrays += [
                    v if isinstance(v := found[f.name], pa.Array) else pa.array(v, f.type, from_pandas=False)
                    for f in types
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *(f.name for f in types)])

    extra = [F.col(f"`{c}`").alias(s) for c, s in zip(columns, sources, strict=True) if c != s]
    rows = df.select(*[F.col(f"`{c}`") for c in carry], *extra)
    return rows.mapInArrow(run, T.StructType([*fields, *out.fields]))


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the new name of each, so that no result column can clash."""
    short = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*short.values()), short


def named_again(df: DataFrame, short: dict[str, str]) -> DataFrame:
    """The columns that ``numbered_columns`` renamed, under their own names."""
    return df.select(*[F.col(s).alias(c) for c, s in short.items()])


# A bit map over 64-bit hashes: a superset test of bounded size that spares a shuffle of wide rows.


def bit_map(hashes: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """(word, mask) rows of the bits of column ``h``; at most ``bits / 64`` rows whatever the input."""
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(bits // 64 - 1))
    return hashes.select(word.alias("_word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy(
        "_word"
    ).agg(F.bit_or("bit").alias("_mask"))


def with_bit(df: DataFrame, h: Column, bits_of: DataFrame, name: str, bits: int = 1 << 22) -> DataFrame:
    """Add ``name``: true for every row whose hash is in the map, and for few others.

    The map is broadcast: it has at most ``bits / 64`` rows of two longs (1 MB by default).
    """
    rows = df.withColumn("_h", h).withColumn(
        "_word", F.shiftrightunsigned("_h", 6).bitwiseAND(F.lit(bits // 64 - 1))
    )
    hit = F.expr("_mask is not null and (_mask & shiftleft(1L, cast(_h & 63 as int))) != 0")
    return (
        rows.join(F.broadcast(bits_of), "_word", "left").withColumn(name, hit).drop("_word", "_mask", "_h")
    )
