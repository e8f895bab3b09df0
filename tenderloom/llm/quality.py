"""Quality by Bradley-Terry pairwise ranking.

Each text gets features of its whole content.  Preference pairs set a document labelled 1
over one labelled 0, and a linear score is learned by logistic loss on the differences of their
features, so the score ranks rather than classifies.  The threshold is a quantile of the
scores of the learned rows: the share of label 0 among all labels.  The reported score is the
logistic of the ranking score, moved so that the threshold lies at 0.7.

Every labelled row outside the held-out fold is learned from.  Their features are written once, dealt
to groups by a hash of the id, and every row of one label is paired with every row of the other in its
group (about ``ROWS_OF_RARER`` of the rarer label; where a group has one label only, with the mean of
the other).  Newton's method sums gradient and curvature over all pairs, one pass of the groups a
step; the threshold is found by counting scores in ever finer bins.  What reaches the driver are
sums, counts and at most ``EXACT_ROWS`` scores, whatever the number of rows.

Defined results: a null or empty text has the features of no words and is scored like any other; labels
without a document, null or repeated with different values are not learned from; without labels
of both kinds every score is 0.7; repeated rows are scored row by row; an empty table gives no
rows.  Other columns pass through where they are asked for and are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.tables import map_column, written
from tenderloom.llm.toxicity import clean_labels, is_held_out, label_totals

ROWS_OF_RARER = 16
PAIRS_AT_ONCE = 50_000
STEPS = 25
ENOUGH = 1e-9  # decrease of the loss that a step still promises
BINS = 1024
EXACT_ROWS = 4096
RIDGE = 1e-3
THRESHOLD = 0.7

FEATURES = (
    "log_words", "log_chars", "word_length", "upper", "digits", "punctuation", "symbols", "bars",
    "distinct_words", "distinct_pairs", "repeats", "distinct_lines", "line_length", "stops", "upper_words", "beyond_ascii",
)
FOUND = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])
SCORED = T.StructType([T.StructField("rank_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

# Byte classes of UTF-8: 1 upper, 2 lower, 3 digit, 4 usual punctuation, 5 bar or tab, 6 other mark, 7 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 6
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[[ord("|"), 9]] = 5
_TABLE = _CLASS.tobytes()


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
    kinds = np.bincount(raw, minlength=8)
    size = max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    distinct = len(set(words)) / n
    repeats = sum(map(str.__eq__, words[1:], words)) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / n
    lines = [x for x in text.split("\n") if x]
    upper_words = sum(map(str.isupper, words)) / n
    letters = max(int(kinds[1] + kinds[2] + kinds[7]), 1)
    return [
        math.log1p(len(words)),
        math.log1p(len(text)),
        min(len(text) / n, 40.0),
        kinds[1] / letters,
        kinds[3] / size,
        kinds[4] / n,
        kinds[6] / n,
        kinds[5] / n,
        distinct * math.log1p(len(words)),
        pairs,
        repeats,
        len(set(lines)) / max(len(lines), 1),
        math.log1p(len(words) / max(len(lines), 1)),
        sum(len(w) <= 3 for w in words) / n,
        upper_words,
        kinds[7] / size,
    ]


def with_features(docs: DataFrame, carry: Sequence[str], text: str = "text") -> DataFrame:
    def make():
        return lambda texts: {"features": [features(t) for t in texts]}

    return map_column(docs, text, make, FOUND, carry)


def inputs(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features with bounded bends."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate((z, np.abs(z), np.tanh(2 * z)), axis=1)


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over all pairs of inputs: their number, the logistic loss, its gradient and its curvature."""
    n, sums = len(w), np.zeros(2 + len(w) + len(w) ** 2)
    rows = max(1, PAIRS_AT_ONCE // max(len(bad), 1))
    for at in range(0, len(good), rows):
        apart = (good[at : at + rows, None, :] - bad[None, :, :]).reshape(-1, n)
        margin = apart @ w
        lost = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
        sums[0] += len(apart)
        sums[1] += np.logaddexp(0, -margin).sum()
        sums[2 : 2 + n] -= lost @ apart
        sums[2 + n :] += ((apart * (lost * (1 - lost))[:, None]).T @ apart).ravel()
    return sums


def newton(sums_at: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Weights of least mean loss; a step that makes it worse is halved."""
    w, step, best = np.zeros(n), np.zeros(n), math.inf
    for _ in range(STEPS):
        sums = sums_at(w + step)
        pairs = max(sums[0], 1.0)
        loss = sums[1] / pairs + RIDGE / 2 * float((w + step) @ (w + step))
        if loss > best:
            step = step / 2
            continue
        w, best = w + step, loss
        slope = sums[2 : 2 + n] / pairs + RIDGE * w
        step = -np.linalg.solve(sums[2 + n :].reshape(n, n) / pairs + RIDGE * np.eye(n), slope)
        if -float(slope @ step) < ENOUGH:
            break
    return w


def boundary(values: np.ndarray, masses: np.ndarray, share: float, below: float, before: float | None, after: float | None) -> float:
    """Where mass ``share`` lies below: between two rising ``values``, the first of which follows ``before`` and
    mass ``below``, and the last of which comes before ``after``."""
    up_to = below + np.cumsum(masses)
    at = min(int(np.searchsorted(up_to, share - 1e-12)), len(values) - 1)
    here = float(values[at])
    left = float(values[at - 1]) if at else before
    right = float(values[at + 1]) if at + 1 < len(values) else after
    upper = up_to[at] - share <= share - (up_to[at] - masses[at])
    beside = right if right is not None and (upper or left is None) else left
    return here if beside is None else (here + beside) / 2


class Ranking:
    """Mean and scale of the features, weights of their inputs, and the threshold."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, share_bad: float):
        """Learned from arrays of features, each row of one label paired with each of the other."""
        both = np.concatenate((good, bad))
        self.ready = len(good) > 0 and len(bad) > 0
        if not self.ready:
            return
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-9
        x_good, x_bad = (inputs(x, self.mean, self.scale) for x in (good, bad))
        self.weights = newton(lambda w: pair_sums(x_good, x_bad, w), x_good.shape[1])
        scores = np.concatenate((x_good @ self.weights, x_bad @ self.weights))
        shares = np.repeat(((1 - share_bad) / len(good), share_bad / len(bad)), (len(good), len(bad)))
        values, place = np.unique(scores, return_inverse=True)
        self.threshold = boundary(values, np.bincount(place, shares), share_bad, 0.0, None, None)

    @classmethod
    def of_rows(cls, rows: DataFrame, totals: dict[int, int]) -> Ranking:
        """Learned from all ``rows`` (doc_id, label, features), which are read several times."""
        self = cls.__new__(cls)
        names = range(len(FEATURES))
        moments = [f(F.col("features")[i]).alias(f"{k}{i}") for k, f in (("m", F.avg), ("s", F.stddev_pop)) for i in names]
        counts = [F.count_if(F.col("label") == y).alias(f"n{y}") for y in (0, 1)]
        found = rows.agg(*moments, *counts).first()
        n = (found.n0, found.n1)
        self.ready = min(n) > 0
        if not self.ready:
            return self
        self.mean = np.array([found[f"m{i}"] for i in names])
        self.scale = np.array([found[f"s{i}"] for i in names]) + 1e-9
        group = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, min(n) // ROWS_OF_RARER)))
        dealt = rows.groupBy(group.alias("group")).agg(
            *[F.collect_list(F.when(F.col("label") == y, F.col("features"))).alias(f"x{y}") for y in (0, 1)]
        )
        groups = written(dealt.select("x0", "x1"), "quality-groups")
        sums = _summed(groups, self._grouped(lambda x0, x1: np.concatenate([x.sum(0) for x in (x0, x1)])))
        means = [part / k for part, k in zip(np.split(sums, 2), n, strict=True)]

        def pairs(w: np.ndarray):
            def work(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
                x0, x1 = (x if len(x) else m[None] for x, m in zip((x0, x1), means, strict=True))
                return pair_sums(x1, x0, w)

            return self._grouped(work)

        self.weights = newton(lambda w: _summed(groups, pairs(w)), 3 * len(FEATURES))
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def make():
            ranking = shared.value
            return lambda x: {"s": ranking.rank(np.array(x, float).reshape(-1, len(FEATURES)))}

        ranked = written(
            map_column(rows, "features", make, T.StructType([T.StructField("s", T.DoubleType())]), ["label"]), "quality-ranks"
        )
        share = totals.get(0, 0) / max(sum(totals.values()), 1)
        self.threshold = _threshold(ranked, (share / n[0], (1 - share) / n[1]), share)
        return self

    def _grouped(self, work: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """A pass over groups that adds up what ``work`` returns for the inputs of each."""
        mean, scale = self.mean, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x0, x1 in zip(*(batch.column(c).to_pylist() for c in ("x0", "x1")), strict=True):
                    part = work(*(inputs(np.array(x, float).reshape(-1, len(FEATURES)), mean, scale) for x in (x0, x1)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        return run

    def rank(self, x: np.ndarray) -> np.ndarray:
        return inputs(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranking score, and its logistic with the threshold at THRESHOLD."""
        if not self.ready:
            return np.zeros(len(x)), np.full(len(x), THRESHOLD)
        s = self.rank(x)
        move = math.log(THRESHOLD / (1 - THRESHOLD)) - self.threshold
        return s, 1 / (1 + np.exp(-np.clip(s + move, -60, 60)))


def _summed(groups: DataFrame, run) -> np.ndarray:
    """The arrays of all tasks added up by place; as many rows reach the driver as the array is long."""
    sums = groups.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    found = sums.groupBy("at").agg(F.sum("x").alias("x")).collect()
    return np.array([x for _, x in sorted((r["at"], r["x"]) for r in found)])


def _threshold(ranked: DataFrame, masses: tuple[float, float], share: float) -> float:
    """:func:`boundary` of the scores ``s`` of all rows, a row of label y having ``masses[y]``."""
    counts = [F.count_if(F.col("label") == y).alias(f"n{y}") for y in (0, 1)]
    below, before, after = 0.0, None, None
    rows, (low, high, left) = ranked, ranked.agg(F.min("s"), F.max("s"), F.count("*")).first()
    while left > EXACT_ROWS and low < high:
        place = F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = rows.groupBy(place.alias("bin")).agg(F.min("s").alias("low"), F.max("s").alias("high"), *counts)
        found = sorted(bins.collect(), key=lambda r: r.bin)
        mass = np.array([r.n0 * masses[0] + r.n1 * masses[1] for r in found])
        up_to = below + np.cumsum(mass)
        at = min(int(np.searchsorted(up_to, share - 1e-12)), len(found) - 1)
        before = found[at - 1].high if at else before
        after = found[at + 1].low if at + 1 < len(found) else after
        below, low, high, left = float(up_to[at] - mass[at]), found[at].low, found[at].high, found[at].n0 + found[at].n1
        rows = ranked.filter(F.col("s").between(low, high))
    found = sorted(rows.groupBy("s").agg(*counts).collect())  # one value, or at most EXACT_ROWS
    mass = np.array([n0 * masses[0] + n1 * masses[1] for _, n0, n1 in found])
    return boundary(np.array([s for s, _, _ in found]), mass, share, below, before, after)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> Ranking:
    clean = written(clean_labels(labels.select("doc_id", label), label), "quality-labels")
    # Features are taken before the join, so that no text is moved.
    rows = with_features(docs.select("doc_id", F.col(text).alias("text")), ["doc_id"]).join(clean, "doc_id")
    return Ranking.of_rows(written(rows.select("doc_id", "label", "features"), "quality-rows"), label_totals(clean))


def quality_scores(
    docs: DataFrame, labels: DataFrame, carry: Sequence[str], label: str = "quality", text: str = "text"
) -> DataFrame:
    """``carry`` columns of ``docs`` with rank_score and score; ``labels`` are the rows to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, text))

    def make():
        ranking = shared.value

        def work(texts: list[str | None]) -> dict[str, Sequence]:
            x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            s, score = ranking.score(x)
            return {"rank_score": s, "score": score}

        return work

    return map_column(docs, text, make, SCORED, carry)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    held_out = is_held_out(F.col("doc_id"), 4, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    scored = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "rank_score",
    )
