"""Hard negatives of anchors by angular triangle filtering.

Reference directions are taken, farthest first, from a bounded sample.  Every row stores its
angles to them.  For an anchor and a row, each reference gives an interval of their angle: at
least the difference of the two stored angles, at most their sum (or 2 pi less the sum).  The
intersection of the intervals, as cosines times both norms, bounds the integer score.  Only rows
whose bounds overlap a window that is still open are scored, in exact integers:

* positives: rows of the anchor's label, window from the least of the best scores so far upwards;
* negatives: rows of other labels, a window of scores for each positive, whose lower end rises to
  the least of the best scores so far once enough are known.

Stored angles are rounded to 32 bits; the bounds are widened by more than that and by one unit of
score, so a filtered row can never have been a result.  Where vectors are nearly orthogonal and
angles tell little, most rows are scored.

Defined results: rows with a null label take no part; otherwise rows and ids are as
``vector_grid`` defines them (of an id with several rows the least counts).  Equal scores go to the
smaller id.  Anchors without a positive, and positives with a negative score, give no rows; an empty
table gives none.  Labels that nobody shares are allowed, in any number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.tables import written
from tenderloom.llm.vector_grid import (
    QUERY_BYTES,
    ROW_BYTES,
    blocks,
    exact,
    integer_vectors,
    matrix,
    over_grid,
    unpacked,
)

POSITIVES = 5
NEGATIVES = 10
#: A negative's score is LOW to HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Reference directions, and the sample they are taken from.
REFERENCES = 8
SAMPLE = 2048
#: Slack of an angle: far above the rounding of 32-bit angles and of the arccosine near 0 and pi.
ANGLE_SLACK = 1e-6

POSITIVE = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_id", "positive_score")])
NEGATIVE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")]
)


def norms_of(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def references(sample: list[tuple[int, bytes]], n: int = REFERENCES) -> dict[int, np.ndarray]:
    """Unit directions for each vector length of the sample, each as far from the others as there are."""
    found = {}
    for size in sorted({s for s, _ in sample}):
        x = np.stack([matrix([v], size)[0].astype(np.float64) for s, v in sample if s == size])
        x = x[norms_of(x) > 0]
        if not len(x):
            continue
        x /= norms_of(x)[:, None]
        chosen, nearest = [0], np.full(len(x), -1.0)
        while len(chosen) < min(n, len(x)):
            nearest = np.maximum(nearest, x @ x[chosen[-1]])
            if nearest.min() > 1 - 1e-9:
                break
            chosen.append(int(nearest.argmin()))
        found[size] = x[chosen]
    return found


def angles_to(x: np.ndarray, refs: np.ndarray | None) -> np.ndarray:
    """Angles (reference, row) as 32-bit numbers; pi/2 for a zero vector, whose scores are 0 anyway."""
    if refs is None:
        return np.zeros((0, len(x)), "<f4")
    n = norms_of(x)
    cosine = (refs @ x.T.astype(np.float64)) / np.where(n > 0, n, 1)
    return np.arccos(np.clip(cosine, -1, 1)).astype("<f4")


@dataclass
class Rows:
    """A block with its stored angles."""

    ids: np.ndarray
    x: np.ndarray
    labels: np.ndarray
    norms: np.ndarray
    angles: np.ndarray  # (reference, row)

    @classmethod
    def of(cls, size: int, row: dict) -> Rows:
        ids, x = unpacked(size, row)
        labels = np.frombuffer(row["labels"], "<i8")
        return cls(ids, x, labels, norms_of(x), np.frombuffer(row["angles"], "<f4").reshape(-1, len(ids)))

    def overlapping(self, at: np.ndarray, angles: np.ndarray, norm: float, windows: list[tuple[float, float]]) -> np.ndarray:
        """Those of the rows ``at`` whose score with a vector of these angles and norm can lie in a window."""
        least, most = np.zeros(len(at)), np.full(len(at), np.pi)
        for own, theirs in zip(angles, self.angles, strict=True):
            t = theirs[at].astype(np.float64)
            np.maximum(least, np.abs(t - own), out=least)
            total = t + own
            np.minimum(most, np.minimum(total, 2 * np.pi - total), out=most)
        length = norm * self.norms[at]
        slack = 1 + 1e-9 * length
        upper = np.cos(np.maximum(least - ANGLE_SLACK, 0)) * length + slack
        lower = np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) * length - slack
        return at[np.any([(upper >= low) & (lower <= high) for low, high in windows], axis=0)]

    def scores(self, at: np.ndarray, vector: np.ndarray) -> np.ndarray:
        x = self.x[at]
        kind = exact(np.stack([np.abs(vector), np.abs(x).max(axis=0, initial=0)])).dtype
        return (x.astype(kind) @ vector.astype(kind)).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest scores, ties to the smaller id."""
    top = np.lexsort((ids, -scores))[:k]
    return scores[top], ids[top]


def _join(a: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return best(np.concatenate((a[0], scores)), np.concatenate((a[1], ids)), k)


NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _positives(k: int):
    def work(size: int, block: dict, others: Iterator[dict]) -> pa.Table:
        asks = Rows.of(size, block)
        found = [NONE] * len(asks.ids)
        for row in others:
            rows = Rows.of(size, row)
            of_label = {}
            order = np.argsort(rows.labels, kind="stable")
            values, first = np.unique(rows.labels[order], return_index=True)
            for value, at in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                of_label[value] = at
            for i, own in enumerate(asks.ids):
                at = of_label.get(int(asks.labels[i]))
                if at is None:
                    continue
                low = found[i][0][-1] if len(found[i][0]) == k else -np.inf
                at = rows.overlapping(at, asks.angles[:, i], asks.norms[i], [(low, np.inf)])
                at = at[rows.ids[at] != own]
                if len(at):
                    found[i] = _join(found[i], rows.scores(at, asks.x[i]), rows.ids[at], k)
        n = [len(s) for s, _ in found]
        score, ids = (np.concatenate([f[j] for f in found]) for j in (0, 1))
        return pa.table({"anchor_id": np.repeat(asks.ids, n), "positive_id": ids, "positive_score": score})

    return work


def _negatives(k: int, low: int, high: int):
    def ends(score: int) -> tuple[int, int]:
        """Least and greatest integer score s with low * score <= 100 * s <= high * score."""
        return -(-low * score // 100), high * score // 100

    def work(size: int, block: dict, others: Iterator[dict]) -> pa.Table:
        asks = Rows.of(size, block)
        sets = np.split(np.frombuffer(block["pairs"], "<i8").reshape(-1, 3), np.cumsum(np.frombuffer(block["counts"], "<i8"))[:-1])
        # A window of Python integers for each pair, so that products of large scores do not overflow.
        windows = [[ends(int(score)) for _, _, score in pairs] for pairs in sets]
        found = [[NONE] * len(pairs) for pairs in sets]
        for row in others:
            rows = Rows.of(size, row)
            for i in range(len(asks.ids)):
                spans = []
                for (least, most), (scores, _) in zip(windows[i], found[i], strict=True):
                    spans.append((max(least, int(scores[-1])) if len(scores) == k else least, most))
                still_open = [s for s in spans if s[0] <= s[1]]
                if not still_open:
                    continue
                at = np.flatnonzero(rows.labels != asks.labels[i])
                at = rows.overlapping(at, asks.angles[:, i], asks.norms[i], still_open)
                if not len(at):
                    continue
                score = rows.scores(at, asks.x[i])
                for j, (least, most) in enumerate(spans):
                    inside = (score >= least) & (score <= most)
                    if inside.any():
                        found[i][j] = _join(found[i][j], score[inside], rows.ids[at[inside]], k)
        pairs = np.concatenate(sets) if sets else np.zeros((0, 3), np.int64)
        lists = [f for of_anchor in found for f in of_anchor]
        each = np.repeat(pairs, [len(s) for s, _ in lists], axis=0)
        score, ids = (np.concatenate([f[j] for f in lists]) if lists else NONE[j] for j in (0, 1))
        columns = (each[:, 0], each[:, 1], ids, each[:, 2], score)
        return pa.table(dict(zip(NEGATIVE.names, columns, strict=True)))

    return work


def _first(df: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of
    ``integer_vectors`` that ``is_anchor`` (of the column ``id``) names."""
    rows = rows.filter("label is not null")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).select("size", "v").collect()
    refs = rows.sparkSession.sparkContext.broadcast(references([(size, bytes(v)) for size, v in sample]))

    def with_angles(size: int, table: pa.Table, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"labels": table.column("label").to_numpy().astype("<i8"), "angles": angles_to(x, refs.value.get(size))}

    extra = ["labels", "angles"]
    row_blocks = written(blocks(rows, n, ROW_BYTES, with_angles, extra), "angled-rows")
    anchors = rows.filter(is_anchor)
    n_anchors = anchors.count()
    asked = written(blocks(anchors, n_anchors, QUERY_BYTES, with_angles, extra), "anchors")
    near = over_grid(asked, n_anchors, row_blocks, n, _positives(n_positives), POSITIVE)
    positives = _first(near, ["anchor_id"], "positive_score", "positive_id", n_positives).drop("rank")

    # At most n_positives pairs of an anchor.
    pairs = positives.filter("positive_score >= 0").groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score"))).alias("pairs")
    )
    with_pairs = written(anchors.join(pairs.withColumnRenamed("anchor_id", "id"), "id"), "anchor-pairs")

    def with_windows(size: int, table: pa.Table, x: np.ndarray) -> dict[str, np.ndarray]:
        lists = table.column("pairs").to_pylist()
        flat = np.array([[p[c] for c in POSITIVE.names] for pairs in lists for p in pairs], "<i8").reshape(-1, 3)
        return with_angles(size, table, x) | {"counts": np.array([len(p) for p in lists], "<i8"), "pairs": flat}

    n_open = with_pairs.count()
    windows = written(blocks(with_pairs, n_open, QUERY_BYTES, with_windows, [*extra, "counts", "pairs"]), "windows")
    found = over_grid(windows, n_open, row_blocks, n, _negatives(n_negatives, low, high), NEGATIVE)
    return _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = integer_vectors(table, "vec_id", "embedding", label)
    return mine(rows, F.col("id") % 100 == 0)


OP13_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
near AS (
  SELECT a.vec_id AS anchor_id, p.vec_id AS positive_id, CAST(list_dot_product(a.v, p.v) AS BIGINT) AS positive_score
  FROM usable a JOIN usable p ON a.label = p.label AND a.vec_id <> p.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM near
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id) <= 5),
apart AS (
  SELECT a.vec_id AS anchor_id, n.vec_id AS negative_id, CAST(list_dot_product(a.v, n.v) AS BIGINT) AS negative_score
  FROM usable a JOIN usable n ON a.label <> n.label WHERE a.vec_id % 100 = 0),
inside AS (
  SELECT p.anchor_id, p.positive_id, n.negative_id, p.positive_score, n.negative_score
  FROM positives p JOIN apart n ON p.anchor_id = n.anchor_id
    AND 30 * p.positive_score <= 100 * n.negative_score AND 100 * n.negative_score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (
    PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank,
  negative_id, positive_score, negative_score
FROM inside
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= 10
"""
