"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their beginnings.  A bounded sample of the labelled rows picks
the terms that tell the labels apart and becomes the index; document frequencies of the terms
are counted over all documents.  A text's k nearest examples vote with their cosines; a class
counts as much as it has labelled rows per sampled row, and the prior of the labels has a small
vote of its own, so the score is a calibrated share.  The neighbours are kept as evidence.

Postings of a term are grouped by blocks of examples with the greatest weight of each block.
Blocks are visited by falling upper bound until none can beat the k-th best cosine, so the
nearest examples are exact (ties: the smaller id) without reading every posting.

Defined results: a null or empty text, or one without a known term, gets the prior; a text
never votes for itself (by id); labels without a document, with a null label or repeated with
different labels are not learned from; without labels of both kinds the score is the prior (0
without any); repeated rows are scored row by row; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.tables import map_column, named_again, numbered_columns, written

#: Bounds of what is learned: sampled rows of each label, and terms.
SAMPLE_PER_LABEL = 4000
TERMS = 4096
LEAST_ROWS = 5  # sampled rows that a term must occur in
LEAST_Z = 6.0  # so many standard errors between the rates
LEAST_RATIO = 4.0  # between its rates in the two labels
BEGINNINGS = (4, 5, 6)
NEIGHBOURS = 15
PRIOR_VOTE = 0.05
BLOCK = 64

_WORDS = re.compile(r"[^\W\d_]+")
_REMEMBER = 300_000

COUNTS = T.StructType(
    [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
)
SCORES = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("neighbours", T.ArrayType(T.LongType())),
        T.StructField("cosines", T.ArrayType(T.DoubleType())),
    ]
)


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def is_held_out(doc_id, folds: int = 5, fold: int = 0):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the documents that have one label, 0 or 1."""
    return (
        labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"), F.max(column).alias("other"))
        .filter("label = other")
        .select("doc_id", "label")
    )


def label_totals(clean: DataFrame) -> dict[int, int]:
    return {r.label: r.n for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}


def sample_labels(labels: DataFrame, column: str, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """Up to ``per_label`` (doc_id, label) rows of each label, least hash first, and each label's rows in all."""
    clean = clean_labels(labels, column)
    order = (F.xxhash64("doc_id", F.lit(17)), F.col("doc_id"))
    parts = [clean.filter(F.col("label") == y).orderBy(*order).limit(per_label) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), label_totals(clean)


def _term_counts(sampled: DataFrame) -> DataFrame:
    """(term, label, n): sampled rows of each label that hold the term, added up inside each batch first."""
    pair = T.StructType([T.StructField("term", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType())])
    out = T.StructType([T.StructField("found", T.ArrayType(pair))])

    def make():
        def work(rows: list[dict]) -> dict[str, list]:
            tally: Counter = Counter()
            for r in rows:
                tally.update((t, r["label"]) for t in {t for w in words_of(r["text"]) for t in terms_of(w)})
            found = [{"term": t, "label": y, "n": n} for (t, y), n in tally.items()]
            return {"found": [found, *[[]] * (len(rows) - 1)]}

        return work

    rows = sampled.select(F.struct("label", "text").alias("row"))
    return map_column(rows, "row", make, out, []).select(F.inline("found")).groupBy("term", "label").agg(
        F.sum("n").alias("n")
    )


def pick_terms(sampled: DataFrame, sizes: dict[int, int]) -> list[str]:
    """Terms whose rates in the labels differ by LEAST_RATIO and more, the most certain ones (by the z
    statistic of two shares) first; at most TERMS."""
    n = {y: float(max(sizes.get(y, 0), 1)) for y in (0, 1)}
    both = _term_counts(sampled).groupBy("term").agg(
        *[F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    )
    rate = {y: F.col(f"n{y}") / n[y] for y in (0, 1)}
    pooled = (F.col("n0") + F.col("n1")) / (n[0] + n[1])
    z = F.abs(rate[1] - rate[0]) / F.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-12)
    smooth = [(F.col(f"n{y}") + 0.5) / (n[y] + 1) for y in (0, 1)]
    ratio = F.greatest(smooth[0] / smooth[1], smooth[1] / smooth[0])
    best = (
        both.filter(ratio >= LEAST_RATIO).filter(F.col("n0") + F.col("n1") >= LEAST_ROWS)
        .withColumn("z", F.round(z, 9))
        .filter(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "term")
        .limit(TERMS)
    )
    return [r.term for r in best.collect()]


class TermCounter:
    """How often a text holds each known term; what a word stands for is remembered up to a bound."""

    def __init__(self, number: dict[str, int]):
        self.number = number
        self.of_word: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
        tally: dict[int, int] = {}
        for word in _WORDS.findall((text or "").lower()):
            found = self.of_word.get(word)
            if found is None:
                if len(self.of_word) > _REMEMBER:
                    self.of_word.clear()
                found = tuple(self.number[t] for t in terms_of(word) if t in self.number)
                self.of_word[word] = found
            for t in found:
                tally[t] = tally.get(t, 0) + 1
        terms = tuple(sorted(tally))
        return terms, tuple(tally[t] for t in terms)


def count_terms(docs: DataFrame, number, carry: Sequence[str], text: str = "text") -> DataFrame:
    """Which terms of the shared ``number`` each text holds, and how often."""

    def make():
        counter = TermCounter(number.value)

        def work(texts: list[str | None]) -> dict[str, list]:
            found = [counter(t) for t in texts]
            return {"terms": [t for t, _ in found], "counts": [n for _, n in found]}

        return work

    return map_column(docs, text, make, COUNTS, carry)


@dataclass
class BlockMaxIndex:
    """Examples by term; rows of unit length are numbered so that similar ones share a block."""

    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray  # of each term's postings
    rows: np.ndarray
    weights: np.ndarray
    block_start: np.ndarray  # of each term's blocks
    blocks: np.ndarray
    block_max: np.ndarray
    block_from: np.ndarray  # first and last posting of each (term, block)
    block_to: np.ndarray

    @classmethod
    def build(cls, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        heavy = [(int(t[np.argmax(w)]) if len(t) else n_terms) for t, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (heavy[i], ids[i]))
        term = np.concatenate([np.zeros(0, np.int64), *[vectors[i][0] for i in order]])
        weight = np.concatenate([np.zeros(0), *[vectors[i][1] for i in order]])
        row = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order]).astype(np.int64)
        by_term = np.lexsort((row, term))
        term, row, weight = term[by_term], row[by_term], weight[by_term]
        key = term * (len(order) // BLOCK + 1) + row // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return cls(
            np.array([ids[i] for i in order], np.int64),
            np.array([labels[i] for i in order], np.int64),
            np.searchsorted(term, np.arange(n_terms + 1)),
            row,
            weight,
            np.searchsorted(term[first], np.arange(n_terms + 1)),
            row[first] // BLOCK,
            np.maximum.reduceat(weight, first) if len(first) else np.zeros(0),
            first,
            np.append(first[1:], len(term)) if len(first) else first,
        )

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` nearest examples that share a term, best first."""
        n_blocks = len(self.ids) // BLOCK + 1
        bound = np.zeros(n_blocks)
        for t, w in zip(terms, weights, strict=True):
            a, b = self.block_start[t], self.block_start[t + 1]
            bound[self.blocks[a:b]] += w * self.block_max[a:b]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_row, best_cos = np.zeros(0, np.int64), np.zeros(0)
        for at, block in enumerate(order):
            if len(best_row) == k and bound[block] < best_cos[-1] - 1e-12:
                break  # no example of this or a later block reaches the k-th best
            cosine = np.zeros(BLOCK)
            for t, w in zip(terms, weights, strict=True):
                a, b = self.block_start[t], self.block_start[t + 1]
                j = a + np.searchsorted(self.blocks[a:b], block)
                if j < b and self.blocks[j] == block:
                    p = slice(self.block_from[j], self.block_to[j])
                    cosine[self.rows[p] - block * BLOCK] += w * self.weights[p]
            found = np.flatnonzero(cosine > 0)
            rows = found + block * BLOCK
            keep = rows if own is None else rows[self.ids[rows] != own]
            best_row = np.concatenate((best_row, keep))
            best_cos = np.concatenate((best_cos, cosine[keep - block * BLOCK]))
            top = np.lexsort((self.ids[best_row], -np.round(best_cos, 12)))[:k]
            best_row, best_cos = best_row[top], best_cos[top]
        return best_row, best_cos


def unit_vector(terms: Sequence[int], counts: Sequence[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.array(terms, np.int64)
    w = (1 + np.log(np.array(counts, float))) * idf[t] if len(t) else np.zeros(0)
    norm = math.sqrt(float(w @ w))
    return (t, w / norm) if norm else (t[:0], w[:0])


@dataclass
class Votes:
    index: BlockMaxIndex
    idf: np.ndarray
    rates: tuple[float, float]  # labelled rows per sampled row of labels 0 and 1
    prior: float

    def score(self, doc_id: int | None, terms: Sequence[int], counts: Sequence[int], cache: dict):
        key = (doc_id if doc_id in cache["ids"] else None, tuple(terms), tuple(counts))
        if key not in cache:
            if len(cache) > 20_000:
                ids = cache["ids"]
                cache.clear()
                cache["ids"] = ids
            t, w = unit_vector(terms, counts, self.idf)
            rows, cosines = self.index.nearest(t, w, NEIGHBOURS, doc_id)
            vote = cosines * np.array(self.rates)[self.index.labels[rows]]
            toxic = float(vote[self.index.labels[rows] == 1].sum()) + PRIOR_VOTE * self.prior
            score = toxic / (float(vote.sum()) + PRIOR_VOTE)
            cache[key] = (min(1.0, max(0.0, score)), self.index.ids[rows].tolist(), cosines.tolist())
        return cache[key]


def learn(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str) -> tuple[dict[str, int], Votes]:
    """Terms, index and vote weights; all of them are bounded by the constants above."""
    sc = docs.sparkSession.sparkContext
    sample, totals = sample_labels(labels.select("doc_id", label), label, SAMPLE_PER_LABEL)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id")  # at most two samples of ids
    sampled = written(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxic-sample")
    sizes = {r.label: r.n for r in sampled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    terms = pick_terms(sampled, sizes) if len(sizes) == 2 else []
    number = {t: i for i, t in enumerate(terms)}
    shared = sc.broadcast(number)

    held = count_terms(docs, shared, [], text)  # one pass over all documents, counts leave it
    both = held.select(F.explode(F.concat(F.array(F.lit(-1)), "terms")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    found = {r.t: r.n for r in both.collect()}  # at most TERMS + 1 rows
    idf = np.log((1 + found.get(-1, 0)) / (1 + np.array([found.get(i, 0) for i in range(len(terms))], float))) + 1

    examples = sorted(map(tuple, count_terms(sampled, shared, ["doc_id", "label"]).collect()))  # two samples
    vectors = [unit_vector(t, c, idf) for *_, t, c in examples]
    index = BlockMaxIndex.build([e[0] for e in examples], [e[1] for e in examples], vectors, len(terms))
    rates = [totals.get(y, 0) / max(sizes.get(y, 0), 1) for y in (0, 1)]
    most = max(*rates, 1e-9)
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    return number, Votes(index, idf, (rates[0] / most, rates[1] / most), prior)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    carry: Sequence[str],
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``carry`` columns of ``docs`` and score, neighbours, cosines.  ``labels`` (doc_id, label) are
    the rows to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, doc_id, text))

    def make():
        number, votes = shared.value
        counter, cache = TermCounter(number), {"ids": set(votes.index.ids.tolist())}

        def work(texts: list[str | None], ids: list[int | None]) -> dict[str, list]:
            done = [votes.score(i, *counter(t), cache) for t, i in zip(texts, ids, strict=True)]
            return {name: [d[i] for d in done] for i, name in enumerate(SCORES.names)}

        return work

    return map_column(docs, [text, doc_id], make, SCORES, carry)


def not_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with the columns of ``docs``."""
    plain, short = numbered_columns(docs)
    scored = toxicity_scores(plain, labels, plain.columns, doc_id=short["doc_id"], text=short["text"])
    return named_again(scored.filter(F.col("score") < limit), short)


def learnable(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold."""
    return labels.filter(~is_held_out(F.col("doc_id")))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), learnable(labels), ["doc_id"])
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "neighbours",
        "cosines",
    )
