"""Token-id files: documents in ascending id order, their ids Simple-8b coded.

A file is a sorted run of segments.  Each segment is a row: the document ids, how many token ids
each has, the coded words, the first word of each block, and the escapes (see ``simple8b``).
Spark's Parquet writer holds the rows, so a lost task leaves nothing half written.

Defined results: a null text is encoded as empty (its end id remains); a null document id comes
last; rows with the same id follow one another, equal ids in the order of their texts; an empty
table gives an empty file set.  Other columns do not matter.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm import simple8b
from tenderloom.llm.pieces import encoder
from tenderloom.llm.tables import slices
from tenderloom.session import checkpoint_root

END_ID = 1
#: Text bytes of one segment; a longer text is a segment of its own.
SEGMENT_BYTES = 1 << 20

SEGMENT = T.StructType(
    [
        T.StructField("run", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("n_ids", T.LongType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("offsets", T.BinaryType()),
        T.StructField("escapes", T.BinaryType()),
    ]
)
READ = T.StructType(
    [
        T.StructField("run", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("inside", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The end id after the ids of each document."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = ids
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write the segments, documents in ascending id order."""

    def pack(batches):
        tokens, run, n = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                ids, counts = tokens.encode(part.column("text").to_pylist())
                ids = _with_end(ids, counts, end_id)
                words, offsets, escapes = simple8b.encode(ids)
                row = [run, n, part.column("doc_id").to_pylist(), (counts + 1).tolist(), len(ids)]
                row += [x.astype(x.dtype.newbyteorder("<")).tobytes() for x in (words, offsets, escapes)]
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=SEGMENT.names
                )
                n += 1

    order = (F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    ordered = docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    ordered.mapInArrow(pack, SEGMENT).write.option("compression", "zstd").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    # One row per sorted run, so the window over all runs stays small.
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = segments.groupBy("run").agg(F.sum("n_ids").alias("ids")).select(
        "run", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("run").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select("run", "segment", "n_ids").withColumn(
        "inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    )
    starts = places.join(runs, "run").select("run", "segment", (F.col("base") + F.col("inside")).alias("base"))

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, escapes = (np.frombuffer(row[c], "<u8") for c in ("words", "escapes"))
                ids = simple8b.decode(words, escapes).astype("<u4")
                n = np.array(row["lengths"], np.int64)
                first = np.cumsum(n) - n
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                place = [pa.array(np.full(len(n), row[c], np.int32)) for c in ("run", "segment")]
                yield pa.RecordBatch.from_arrays(
                    [*place, pa.array(row["doc_ids"], pa.int64()), pa.array(first), pa.array(n), pa.array(crc, pa.int64())],
                    names=READ.names,
                )

    # The wide words are decoded where they are read; only their documents' few numbers move.
    read = segments.select("run", "segment", "doc_ids", "lengths", "words", "escapes").mapInArrow(unpack, READ)
    return read.join(starts, ["run", "segment"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/llm/token-files-{uuid.uuid4().hex}"
    write_token_files(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json")
    )
    return read_token_files(spark, path)
