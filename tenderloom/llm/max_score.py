"""Exact top-k search of integer vectors by MaxScore.

A component of the vectors is a term.  Every block of rows is a shard with an inverted index: a
term has two posting lists, the rows with positive and those with negative weight, and the
greatest weight of each is stored.  A query reads the list whose sign is its own; the product of
its weight with the stored one bounds what the term can add.  Terms are sorted by that bound.
Those whose bounds together stay below the query's k-th best score so far are non-essential: a
row on none of the other lists cannot be a result.  The rows of the essential lists are scored on
the essential terms; the non-essential ones are probed from the greatest bound down, and only
for rows whose score with all bounds still to come reaches the k-th best.  The k best of a query
are carried from shard to shard of a grid cell, and those of all cells are merged at the end.

Scores are exact integers, so bounds need no margin; equal scores go to the smaller id, and rows
that only tie are never cut.  Rows and ids are as ``vector_grid`` defines them: a null, too large or
non-finite vector and a null id take no part, repeated ids count once, an empty table gives no
rows.  A query with fewer than k other rows of its length returns them all.
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
from tenderloom.llm.vector_grid import QUERY_BYTES, ROW_BYTES, blocks, exact, integer_vectors, over_grid, unpacked

TOP = 5
EVERY = 50
#: Non-essential terms that are probed between two tests of the bound.
PROBE = 4

FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])


@dataclass
class Shard:
    """Postings of one block: rows by term and sign, the weights by term, the greatest of each list."""

    ids: np.ndarray  # ascending
    weights: np.ndarray  # (term, row)
    postings: tuple[list[np.ndarray], list[np.ndarray]]  # rows with positive, with negative weights
    most: tuple[np.ndarray, np.ndarray]  # greatest weight and greatest negated weight, 0 at least

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Shard:
        w = np.ascontiguousarray(x.T)
        top = w.max(axis=1, initial=0), (-w).max(axis=1, initial=0)
        return cls(ids, w, ([np.flatnonzero(r > 0) for r in w], [np.flatnonzero(r < 0) for r in w]), top)

    def candidates(self, query: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Rows on the list of the query's sign of any of ``terms``."""
        on = np.zeros(len(self.ids), bool)
        left = len(on)
        for t in terms[::-1]:
            on[self.postings[int(query[t] < 0)][t]] = True
            left = left - len(self.postings[int(query[t] < 0)][t])
            if left <= 0 and on.all():
                break
        return np.flatnonzero(on)

    def search(self, query: np.ndarray, own: int, best: np.ndarray, best_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of the rows here and the given ones, best first; ties to the smaller id."""
        bound = np.where(query > 0, query * self.most[0], -query * self.most[1])
        order = np.argsort(bound, kind="stable")
        reach = np.cumsum(bound[order])
        full = len(best) == k
        # A row that shares no term has a score of 0 at most, so without a positive k-th score all terms are essential.
        first = int(np.searchsorted(reach, best[-1])) if full and best[-1] > 0 else 0
        essential, others = order[first:], order[:first][::-1]
        if full and best[-1] > 0:
            rows = self.candidates(query, essential)
        else:
            rows = np.arange(len(self.ids))
        if len(rows) == len(self.ids):
            score = query[essential] @ self.weights[essential]
        else:
            score = query[essential] @ self.weights[np.ix_(essential, rows)]
        for i in range(0, len(others) + 1, PROBE):
            if full:
                left = reach[first - i - 1] if first > i else 0
                keep = score + left >= best[-1]
                rows, score = rows[keep], score[keep]
            terms = others[i : i + PROBE]
            if not len(rows):
                return best, best_ids
            if len(terms):
                score = score + query[terms] @ self.weights[np.ix_(terms, rows)]
        rows, score = (x[self.ids[rows] != own] for x in (rows, score))
        if len(rows) > k:  # all that tie with the k-th stay for the sort
            rows, score = (x[score >= np.partition(score, len(score) - k)[len(score) - k]] for x in (rows, score))
        best, best_ids = np.concatenate((best, score.astype(np.int64))), np.concatenate((best_ids, self.ids[rows]))
        top = np.lexsort((best_ids, -best))[:k]
        return best[top], best_ids[top]


def top_rows(rows: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best other rows of each row of ``integer_vectors`` that
    ``is_query`` (of the column ``id``) names."""
    asked = rows.filter(is_query)
    n, n_asked = rows.count(), asked.count()
    row_blocks = written(blocks(rows, n, ROW_BYTES), "shards")
    query_blocks = written(blocks(asked, n_asked, QUERY_BYTES), "query-blocks")

    def work(size: int, query: dict, shards: Iterator[dict]) -> pa.Table:
        ids, q = unpacked(size, query)
        best: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for row in shards:
            own, x = unpacked(size, row)
            # One kind of number for both: exact doubles where every product sum is below 2^53.
            kind = exact(np.stack([np.abs(a).max(axis=0, initial=0) for a in (q, x)])).dtype
            shard, asks = Shard.build(own, x.astype(kind)), q.astype(kind)
            for i, (vector, own_id) in enumerate(zip(asks, ids.tolist(), strict=True)):
                best[i] = shard.search(vector, own_id, *best[i], k)
        score, found = (np.concatenate([b[j] for b in best]) for j in (0, 1))
        asker = np.repeat(ids, [len(b[0]) for b in best])
        return pa.table({"query_id": asker, "vec_id": found, "score": score})

    found = over_grid(query_blocks, n_asked, row_blocks, n, work, FOUND)
    # Spark keeps k rows of each query before the exchange, too.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_max_score(spark, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_rows(rows, F.col("id") % EVERY == 0)


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM usable q JOIN usable r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
