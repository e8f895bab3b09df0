"""Exact neighbours of the index, and scores of a small labelled table."""

import numpy as np
import pytest

from tenderloom.llm import toxicity


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    for n, n_terms in ((1, 3), (70, 8), (900, 40)):
        idf = rng.uniform(0.5, 3, n_terms)
        vectors = []
        for _ in range(n):
            t = np.sort(rng.choice(n_terms, rng.integers(0, min(6, n_terms)), replace=False))
            vectors.append(toxicity.unit_vector(t, rng.integers(1, 5, len(t)), idf))
        ids = rng.permutation(n * 3)[:n].tolist()
        index = toxicity.BlockMaxIndex.build(ids, [0] * n, vectors, n_terms)
        dense = np.zeros((n, n_terms))
        for row, (t, w) in zip(dense, vectors, strict=True):
            row[t] = w
        for _ in range(40):
            t = np.sort(rng.choice(n_terms, rng.integers(1, min(5, n_terms)), replace=False))
            q = toxicity.unit_vector(t, rng.integers(1, 5, len(t)), idf)
            own = int(rng.choice(ids))
            rows, cosines = index.nearest(*q, 7, own)
            full = np.zeros(n_terms)
            full[q[0]] = q[1]
            cos = dense @ full
            want = sorted((-round(c, 12), i) for c, i in zip(cos, ids, strict=True) if c > 0 and i != own)[:7]
            assert [(-round(c, 12), int(index.ids[r])) for r, c in zip(rows, cosines, strict=True)] == want


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    plain = [f"word{chr(97 + i)}" for i in range(20)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = rng.choice(plain, 30).tolist()
        if toxic:
            text[3:6] = [f"vile{rng.choice(['ness', 'ly', 'st'])}", "scoundrel", "rogue"]
        rows.append((i, " ".join(text), "x", i))
        labels.append((i, int(toxic)))
    labels += [(1000, 1), (1, 1), (2, None), (None, 1)]  # no document, disagreeing, null
    rows += [(2000, None, "x", 0), (2001, "", "x", 0), (2002, "You SCOUNDREL! rogue", "x", 0), (None, "scoundrel", "x", 0)]
    rows += [(2003, "wordA " * 100_000 + "scoundrel rogue vilest", "x", 0), (2004, "vilesome", "x", 0), (2002, "You SCOUNDREL! rogue", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, neighbours int")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores(tables):
    docs, labels = tables
    learned = toxicity.learnable(labels)
    got = toxicity.toxicity_scores(docs, learned, ["doc_id", "score"]).collect()
    assert len(got) == docs.count()
    score = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    assert all((score[i] >= 0.5) == (i % 5 == 0) for i in range(400))
    assert min(score[i] for i in (2002, 2003, 2004, None)) > 0.5
    assert score[2000] == score[2001] < 0.5
    for r in got:
        assert r.doc_id not in r.neighbours and len(r.neighbours) == len(r.cosines) <= toxicity.NEIGHBOURS


def test_filter_keeps_columns(tables):
    docs, labels = tables
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(400) if i % 5} <= ids and not ids & {0, 5, 10, 2002, 2003}


def test_without_labels(tables, spark):
    docs, labels = tables
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0), ["doc_id"]).collect()} == {0.0}
    one = toxicity.toxicity_scores(docs, labels.filter("toxic = 1"), ["doc_id"])
    assert {r.score for r in one.collect()} == {1.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels, ["doc_id"]).count() == 0
