"""The traversal and the vector operator against all pairs."""

import math

import numpy as np
import pytest

from tenderloom.llm import embedding_pairs
from tenderloom.llm.cover_tree import CoverTree, links_and_roots


def least_labels(linked, ids):
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(label))], dtype=label.dtype)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("seed", range(12))
def test_traversal(seed):
    rng = np.random.default_rng(seed)
    d, n, k = int(rng.integers(2, 9)), int(rng.integers(1, 300)), int(rng.integers(1, 12))
    x = rng.normal(size=(k, d))[rng.integers(k, size=n)] + rng.normal(size=(n, d)) * rng.choice([0, 0.05, 0.3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = int(rng.integers(0, n + 1))
    a, b = CoverTree.build(x[:m]), CoverTree.build(x[m:])
    for t in (a, b):
        for c, r, i, j in zip(t.centre, t.radius, t.first, t.last, strict=True):
            assert np.linalg.norm(t.points[i:j] - t.points[c], axis=1).max() <= r + 1e-9
    wa, wb = rng.integers(1, 4, m), rng.integers(1, 4, n - m)
    linked = x @ x.T >= 0.9
    links, _ = links_and_roots(a, wa[a.order], b, wb[b.order], 0.9, False)
    want = np.concatenate(((linked[:m, m:] * wb).sum(1)[a.order], (linked[:m, m:] * wa[:, None]).sum(0)[b.order]))
    assert (links == want).all()
    inner = linked[:m, :m].copy()
    np.fill_diagonal(inner, False)
    links, root = links_and_roots(a, wa[a.order], a, wa[a.order], 0.9, True)
    assert (links == (inner * wa).sum(1)[a.order]).all()
    label = least_labels(inner, range(m))[a.order]
    assert ((root[:, None] == root[None, :]) == (label[:, None] == label[None, :])).all()


def brute(rows):
    usable = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            (a, u), (b, v) = rows[i], rows[j]
            if i != j and usable[i] and usable[j] and a is not None and b is not None and len(u) == len(v):
                p, q = np.array(u), np.array(v)
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                linked[i, j] = p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.9
    label = least_labels(linked, [-1 if i is None else i for i, _ in rows])
    return sorted(((i, int(k), None if i is None else int(c), i == (None if i is None else c)) for (i, _), k, c in zip(rows, linked.sum(1), label, strict=True)), key=str)


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_pairs, "BLOCK", block)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 6))
    rows = [(int(i), (centres[rng.integers(9)] + rng.normal(size=6) * 0.25).tolist()) for i in rng.permutation(140)]
    rows += [(200 + i, centres[0].tolist()) for i in range(40)]  # copies of one vector
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [math.nan] * 6), (305, [math.inf] * 6)]
    rows += [(306, [1.0, 2.0]), (307, [1.0, 2.01]), (None, centres[0].tolist()), (308, (centres[1] * 1e300).tolist())]
    again = [*rows, rows[0], rows[150]]  # repeated rows are one vector
    table = spark.createDataFrame([(*r, "x") for r in again], "vec_id long, embedding array<double>, kept string")
    got = sorted(map(tuple, embedding_pairs.near_vectors(table).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert embedding_pairs.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_single_precision_and_signed_zeros(spark, monkeypatch):
    monkeypatch.setattr(embedding_pairs, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(90)]
    rows += [(90, [0.0, 1.0]), (91, [1.0, None]), (91, [None, 1.0]), (92, None), (92, []), (93, [0.0, 0.0])]
    again = [*rows, (90, [-0.0, 1.0]), (93, [-0.0, 0.0]), (91, [1.0, None]), (92, None)]
    table = spark.createDataFrame(again, "vec_id long, embedding array<float>").repartition(7)
    got = sorted(map(tuple, embedding_pairs.near_vectors(table).collect()), key=str)
    assert got == brute(rows)


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(embedding_pairs, "BLOCK", 8)
    plans = []
    pairs = embedding_pairs._block_pairs

    def kept(*given):
        plans.append(pairs(*given))
        return plans[-1]

    monkeypatch.setattr(embedding_pairs, "_block_pairs", kept)
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(2).normal(size=(60, 3)).tolist())]
    embedding_pairs.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count()
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan
    left, right = zip(*[((r.left.cell, r.left.block), (r.right.cell, r.right.block)) for r in plans[0].collect()])
    assert len(set(zip(left, right))) == len(left) and all(a < b for a, b in zip(left, right))


def test_a_vector_gets_the_same_cell_in_any_batch():
    x = np.random.default_rng(6).normal(size=(500, 64)).tolist()
    pivots = {64: embedding_pairs.unit(np.array(x[:9]))}
    cells, _ = embedding_pairs._place([*x, None, [1.0]], pivots)
    assert [embedding_pairs._place([v], pivots)[0][0] for v in x] == cells[:-2].tolist()
    assert cells[-2:].tolist() == [-1, -1]
