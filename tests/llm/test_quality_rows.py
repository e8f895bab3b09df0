"""Quality is learned from every labelled row, and the same way as from arrays."""

import numpy as np

from tenderloom.llm import quality


def features_of(rng, n, good):
    return rng.normal(0.4 if good else -0.4, 1, (n, len(quality.FEATURES)))


def test_every_labelled_row_is_learned_from(spark):
    # The rows beyond the 4000 of each label that a sample would take decide: they are of another kind.
    n = 6000
    docs = spark.range(2 * n).selectExpr(
        "id AS doc_id",
        "CASE WHEN id % 2 = 0 THEN repeat('Stone river. ', 20 + cast(id % 7 AS int)) ELSE repeat('X!! 99 ', 20 + cast(id % 5 AS int)) END AS text",
    )
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 AS int) AS quality")
    seen = {}
    whole = quality.Ranking.of_rows

    def counted(rows, totals):
        seen["rows"], seen["totals"] = rows.count(), totals
        return whole(rows, totals)

    quality.Ranking.of_rows = counted
    try:
        ranking = quality.learn(docs, labels)
    finally:
        quality.Ranking.of_rows = whole
    assert seen == {"rows": 2 * n, "totals": {0: n, 1: n}}
    _, score = ranking.score(np.array([quality.features("Stone river. " * 22), quality.features("X!! 99 " * 22)]))
    assert score[0] >= 0.7 > score[1]


def test_groups_and_arrays_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    good, bad = features_of(rng, 90, True), features_of(rng, 30, False)
    rows = [(i, y, x.tolist()) for i, (y, x) in enumerate([(1, x) for x in good] + [(0, x) for x in bad])]
    df = spark.createDataFrame(rows, "doc_id long, label int, features array<double>")
    monkeypatch.setattr(quality, "ROWS_OF_RARER", 1000)  # one group: all pairs, as from arrays
    monkeypatch.setattr(quality, "EXACT_ROWS", 4)  # the threshold by bins
    a, b = quality.Ranking(good, bad, 0.25), quality.Ranking.of_rows(df, {0: 30, 1: 90})
    assert np.allclose(a.weights, b.weights, atol=1e-6) and abs(a.threshold - b.threshold) < 1e-6
    s, score = b.score(np.concatenate((good, bad)))
    assert abs((score < 0.7).mean() - 0.25) < 0.01
    monkeypatch.setattr(quality, "ROWS_OF_RARER", 1)  # groups without one of the labels
    c = quality.Ranking.of_rows(df, {0: 30, 1: 90})
    assert np.corrcoef(c.score(np.concatenate((good, bad)))[0], s)[0, 1] > 0.95


def test_boundary():
    values, mass = np.array([1.0, 2.0, 3.0, 4.0]), np.full(4, 0.25)
    assert quality.boundary(values, mass, 0.5, 0.0, None, None) == 2.5
    assert quality.boundary(values, mass, 0.0, 0.0, None, None) == 1.5
    assert quality.boundary(values[:1], mass[:1], 0.5, 0.0, None, None) == 1.0
    assert quality.boundary(values[:2], mass[:2], 1.0, 0.5, 0.0, 9.0) == 5.5
