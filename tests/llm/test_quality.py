"""Ranking of good above bad texts, and odd rows."""

import numpy as np
import pytest

from tenderloom.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    stems = ["stone", "river", "cloud", "light", "horse", "field", "paper", "glass", "train", "bread"]
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        words = [rng.choice(stems) + rng.choice(["", "s", "ly", "ing"]) for _ in range(int(rng.integers(20, 120)))]
        text = " ".join(words) + "." if good else (" ".join(w.upper() + "!!" for w in words[:9]) + " ") * 6
        rows.append((i, text, "x"))
        labels.append((i, int(good)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "stone " * 100_000, "x"), (None, rows[1][1], "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*labels, (5000, 0), (7, None), (9, 0)], "doc_id long, quality int")


def test_scores(tables):
    docs, labels = tables
    got = quality.quality_scores(docs, labels, ["doc_id", "score"]).collect()
    assert len(got) == docs.count()
    score = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    wrong = sum((score[i] >= 0.7) != (i % 4 != 0) for i in range(300))
    assert wrong <= 3
    assert score[900] == score[901] and score[None] == score[1]


def test_threshold_is_a_quantile():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, 16)), rng.normal(-1, 1, (100, 16))
    ranking = quality.Ranking(good, bad, 0.25)
    s, score = ranking.score(np.concatenate((good, bad)))
    assert abs((score < 0.7).mean() - 0.25) < 0.01
    assert ((score >= 0.7) == (s >= ranking.threshold)).all()


def test_without_labels(tables):
    docs, labels = tables
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0), ["doc_id"]).collect()} == {0.7}
    assert quality.quality_scores(docs.limit(0), labels, ["doc_id"]).count() == 0
