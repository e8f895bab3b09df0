"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source, a target is derived for each source, and each document is
emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy whose probability is the
fraction, where ``rate = target / size of the source``.

Defined results: a null text has size 0; a null source is a source of its own, last in the
order of the weights; repeated rows and repeated ids are mixed row by row (equal ids draw
equal numbers); a null id draws as the empty text; an empty table gives no rows.  Columns
with the names of the results are replaced, all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.tables import named_again, numbered_columns, written
from tenderloom.operators.tables import with_dense_id

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed, return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from 52 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Weights repeat along the sources in the order of code points, null last.  A target stops
    at ``cap`` times its source's size; the excess is shared again by weight until no target
    is above.  Each sharing round is one aggregate over the table of sources.
    """
    per_source = written(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources"
    ).withColumn("last", F.col("source").isNull())
    ordered = with_dense_id(per_source, ["last", "source"], "place")
    turn = F.col("place") % len(weights)
    weight = F.coalesce(*[F.when(turn == i, F.lit(w)) for i, w in enumerate(weights)])
    sources = written(ordered.select("source", "source_size", weight.alias("weight")), "mix-weights")

    most = F.lit(cap) * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        above = F.col("weight") * F.lit(level) > most
        capped, free = sources.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        before = level
        level = max(level, (share * total - capped) / free) if free else level
    target = F.least(F.col("weight") * F.lit(level), most)
    return sources.select("source", "source_size", target.alias("target"))


def with_copies(
    docs: DataFrame, targets: DataFrame, seed: str = SEED, doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to the rows of ``docs``."""
    t = targets.withColumnRenamed("source", "_source")
    joined = docs.join(t, docs[source].eqNullSafe(t["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = F.when(draw(F.col(doc_id), seed) < rate - whole, 1).otherwise(0)
    return joined.withColumn("copies", (whole + extra).cast("long"))


def mixed(docs: DataFrame, seed: str = SEED, **params: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    targets = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), **params)
    plain, short = numbered_columns(docs)
    taken = with_copies(plain, targets, seed, short["doc_id"], short["source"])
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return named_again(taken.select(*plain.columns, again), short)


def mix_counts(docs: DataFrame, seed: str = SEED, **params: object) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken of it."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    rows = with_copies(sized, source_targets(sized, **params), seed)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS k FROM s
), p AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         sum(source_size) OVER () AS total
  FROM r
), levels AS (
  SELECT (1.5::DOUBLE * total - capped) / free AS level FROM p
  WHERE w * ((1.5::DOUBLE * total - capped) / free) <= 2.0::DOUBLE * source_size ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(w * (SELECT level FROM levels), 2.0::DOUBLE * source_size) AS target FROM s
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (floor(target / source_size) + CASE WHEN u < target / source_size - floor(target / source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
