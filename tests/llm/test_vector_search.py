"""Top-k search and hard negatives against all pairs, and the filters of both."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import hard_negatives, max_score, vector_grid

NAN, INF = math.nan, math.inf
SHAPE = "vec_id long, embedding array<double>, label int, score string, id int"


def floored(v):
    return [math.floor(256 * x) for x in v]


def taking_part(rows, labelled=False):
    """Distinct usable rows by id; integer vectors as lists."""
    found = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (labelled and label is None):
            continue
        w = floored(v)
        if any(abs(c) > math.isqrt((2**63 - 1) // len(w)) for c in w):
            continue
        found[i] = (w, label)
    return found


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute_top(rows, every, k):
    part = taking_part(rows)
    out = []
    for i, (v, _) in part.items():
        if i % every == 0:
            scored = sorted((-dot(v, w), j) for j, (w, _) in part.items() if j != i and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def brute_negatives(rows, every, n_pos, n_neg):
    part = taking_part(rows, labelled=True)
    out = []
    for i, (v, label) in part.items():
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for j, (w, other) in part.items() if j != i and len(w) == len(v))
        for s, j in [(s, j) for s, j, other in scored if other == label][:n_pos]:
            inside = [(t, k) for t, k, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:n_neg]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(inside, 1)]
    return sorted(out)


def odd_rows(seed=3, n=300, d=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    group = rng.integers(5, size=n)
    vectors = centres[group] + rng.normal(size=(n, d)) * 0.4
    vectors[rng.random(size=vectors.shape) < 0.2] = 0.0
    rows = [(int(3 * i), v.tolist(), int(g if rng.random() < 0.7 else rng.integers(5)), "x", 0) for i, (v, g) in enumerate(zip(vectors, group, strict=True))]
    rows += [(10_000 + i, centres[0].tolist(), 0, "x", 0) for i in range(90)]  # copies: ties by id
    rows += [(20_000, None, 1, "x", 0), (20_010, [1.0, None] + [0.0] * 5, 1, "x", 0), (20_020, [NAN] * d, 1, "x", 0)]
    rows += [(20_030, [INF] * d, 1, "x", 0), (20_040, [0.0] * d, 1, "x", 0), (20_050, [1e300] * d, 1, "x", 0)]
    rows += [(20_060, [1e6] * d, 1, "x", 0), (20_070, [-1e6] * d, 2, "x", 0), (None, centres[0].tolist(), 0, "x", 0)]
    rows += [(20_080, [1.0, 2.0], 1, "x", 0), (20_090, [1.5, 2.0], 1, "x", 0), (20_100, [1.25, 1.0], 2, "x", 0), (20_110, [], 1, "x", 0)]
    rows += [(20_120, centres[1].tolist(), None, "x", 0), (-50, centres[1].tolist(), 7, "x", 0)]
    return rows


@pytest.fixture(params=["one block", "many blocks"])
def small_blocks(request, monkeypatch):
    if request.param == "many blocks":
        monkeypatch.setattr(vector_grid, "RANGE", 3)
        for module in (max_score, hard_negatives, vector_grid):
            monkeypatch.setattr(module, "ROW_BYTES", 512)
            monkeypatch.setattr(module, "QUERY_BYTES", 256)


def test_top_rows(spark, small_blocks):
    rows = odd_rows()
    table = spark.createDataFrame([*rows, rows[0], rows[310]], SHAPE)  # repeated rows count once
    got = max_score.top_rows(vector_grid.integer_vectors(table, "vec_id", "embedding"), F.col("id") % 10 == 0, 4)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 4)


def test_mine(spark, small_blocks):
    rows = odd_rows(4)
    table = spark.createDataFrame([*rows, rows[0], rows[310]], SHAPE)
    vectors = vector_grid.integer_vectors(table, "vec_id", "embedding", F.col("label"))
    got = hard_negatives.mine(vectors, F.col("id") % 10 == 0, 3, 6)
    want = brute_negatives(rows, 10, 3, 6)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_wide_components_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 2.0**20).tolist(), i % 3, "x", 0) for i in range(60)]
    table = spark.createDataFrame(rows, SHAPE)
    got = max_score.top_rows(vector_grid.integer_vectors(table, "vec_id", "embedding"), F.col("id") % 5 == 0)
    want = brute_top(rows, 5, 5)
    assert sorted(map(tuple, got.collect())) == want and max(s for *_, s in want) > 2**54


def test_empty_tables(spark):
    none = vector_grid.integer_vectors(spark.createDataFrame([], SHAPE), "vec_id", "embedding", F.col("label"))
    assert max_score.top_rows(none, F.col("id") % 5 == 0).count() == 0
    assert hard_negatives.mine(none, F.col("id") % 5 == 0).count() == 0


def test_non_essential_terms_are_probed_only_where_competitive():
    """Sparse weights: rows on no essential list are never looked at, and the result is still exact."""
    rng = np.random.default_rng(7)
    x = np.where(rng.random((4000, 30)) < 0.1, rng.integers(1, 50, (4000, 30)), 0).astype(float)
    x[:, 0] = rng.integers(0, 400, 4000) * (rng.random(4000) < 0.01)
    shard = max_score.Shard.build(np.arange(4000), x)
    looked = []
    plain = shard.candidates
    shard.candidates = lambda q, t: looked.append(plain(q, t)) or looked[-1]
    for q in rng.integers(-3, 9, (20, 30)).astype(float):
        q[0] = 40
        best, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores = x @ q
        want = np.lexsort((np.arange(4000), -scores))[:5]
        best, ids = shard.search(q, -1, best, ids, 5)
        assert (ids == want).all() and (best == scores[want]).all()
        again, same = shard.search(q, -1, best[:0], ids[:0], 5)
        assert (same == want).all()
        # With a k-th score known, the common cheap terms are non-essential.
        best, ids = shard.search(q, -1, best, np.full(5, -2), 5)
    assert looked and max(map(len, looked)) < 4000


def test_triangle_bounds_hold_and_filter():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 20))
    x = np.floor(256 * (centres[rng.integers(6, size=2000)] + 0.05 * rng.normal(size=(2000, 20)))).astype(np.int64)
    refs = hard_negatives.references([(20, v.astype("<i2").tobytes()) for v in x[:300]])[20]
    rows = hard_negatives.Rows(np.arange(2000), x, np.zeros(2000), hard_negatives.norms_of(x), hard_negatives.angles_to(x, refs))
    scored = 0
    for i in range(0, 2000, 97):
        score = x @ x[i]
        for low, high in ((np.quantile(score, 0.99), np.inf), (0.3 * score[i], 0.5 * score[i])):
            kept = rows.overlapping(np.arange(2000), rows.angles[:, i], rows.norms[i], [(low, high)])
            assert set(np.flatnonzero((score >= low) & (score <= high))) <= set(kept.tolist())
            scored += len(kept)
    assert scored < 0.5 * 2000 * 2 * 21
