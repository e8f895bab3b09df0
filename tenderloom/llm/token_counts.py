"""Token counts through a digest cache.

The digest of a text's normal form and the digest of the tokenizer file look up stored counts;
only distinct contents that the cache lacks are encoded, and their counts are appended to it.
The normal form ("blanks") folds runs of blanks, tabs and line ends, which a tokenizer that
drops white space cannot see; for any other tokenizer ("exact") it is the text itself.

Texts are not shuffled: a content's representative is encoded where it is read.  Which rows are
no representatives is told by a bit map of fixed size; the few representatives that share a bit
with another row are found exactly by a join afterwards.

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows and ids each get
their row; an empty table gives no rows and leaves the cache as it is.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.pieces import encoder
from tenderloom.llm.tables import bit_map, map_column, with_bit, written
from tenderloom.session import checkpoint_root

CACHE = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("tokenizer", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
LIMIT = 2048


def content_digest(text: Column, normal: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    if normal == "blanks":
        text = F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))
    return F.sha2(text, 256)


def tokenizer_digest(path: str) -> str:
    """Version of the tokenizer: digest of its file, which lies beside the code on every machine."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer, one row per content; a folder without files is an empty cache."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)
    return stored.filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(rows: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text)."""

    def make():
        tokens = encoder(path)
        return lambda texts: {"n_tokens": tokens.count(texts)}

    return map_column(rows, "text", make, T.StructType([T.StructField("n_tokens", T.LongType())]), ["content"])


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, normal: str) -> DataFrame:
    """Append the counts of contents the cache lacks; returns (doc_id, n_bytes, content) of all rows."""
    spark, tokenizer = docs.sparkSession, tokenizer_digest(tokenizer_path)
    content = content_digest(F.col("text"), normal)
    rows = docs.select("doc_id", "text", content.alias("content"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    listed = written(rows.select("doc_id", n_bytes, "content"), "count-rows")

    first = listed.groupBy("content").agg(F.min("doc_id").alias("first"))
    missing = written(first.join(read_cache(spark, cache_path, tokenizer), "content", "left_anti"), "count-missing")
    row_hash = F.xxhash64("content", "doc_id")
    others = listed.join(missing, "content", "left").filter(~F.expr("first <=> doc_id") | F.col("first").isNull())
    # A content whose ids are all null has no single representative row: it takes the exact way.
    skip = written(bit_map(others.select(row_hash.alias("h"))), "count-bits")
    marked = with_bit(rows, row_hash, skip, "skip")

    def append(found: DataFrame) -> None:
        found.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).select(
            "content", F.lit(tokenizer).alias("tokenizer"), "n_tokens"
        ).write.mode("append").parquet(f"{cache_path}")

    append(_encoded(marked.filter(~F.col("skip")).select("content", "text"), tokenizer_path))
    left = missing.join(read_cache(spark, cache_path, tokenizer), "content", "left_anti")
    maybe = marked.filter("skip").select("doc_id", "content", "text").join(
        left.withColumnRenamed("content", "_content"),
        F.expr("content = _content and doc_id <=> first"),
    )
    append(_encoded(maybe.select("content", "text"), tokenizer_path))
    return listed


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str, normal: str = "exact", limit: int = LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``."""
    listed = fill_cache(docs, tokenizer_path, cache_path, normal)
    # Written, so that the join below is between two plain shuffles and a hot content can be split.
    cache = written(read_cache(docs.sparkSession, cache_path, tokenizer_digest(tokenizer_path)), "count-cache")
    return listed.join(cache, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content"
    )


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Starts from an empty cache in the shared folder, so every distinct content is encoded here."""
    return token_counts(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        public_tokenizers.path("word_bpe_49k.json"),
        f"{checkpoint_root(spark)}/llm/token-cache-{uuid.uuid4().hex}",
        normal="blanks",
    )
