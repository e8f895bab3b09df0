"""Near-duplicate classes against all pairs of exact similarities."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tenderloom.llm import prob_minhash as near
from tenderloom.llm.components import components
from tenderloom.llm.shingles import normal, shingle_sets


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(x, y):
    if not x or not y:
        return float(not x and not y)
    union = x.keys() | y.keys()
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in union) for d in x.keys() & y.keys())


def classes(rows):
    """Least id of each row's class, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [b if k == a else k for k in label]
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [least.get(k) for k in label]


def corpus(seed=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], text(60)
    for _ in range(60):
        base = text(rng.randint(1, 150))
        if rng.random() < 0.3:
            base += passage  # shared by many
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else ", ".join(copy))
    family = text(200)
    for _ in range(40):  # a chain of drifting copies
        family[rng.randrange(200)] = rng.choice(words)
        rows.append(" ".join(family))
    rows += ["again and again " * 30, "again and again " * 31, "x y", "X, y!", "x", "very " * 60_000]
    out = [(1000 - i, t) for i, t in enumerate(rows)]
    return [*out, (2000, None), (2001, ""), (2002, " ... "), (None, rows[0]), (None, "null id only, once")]


@pytest.mark.parametrize("block", [512, 3])
def test_classes(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus()
    again = [*rows, rows[0], rows[5]]
    docs = spark.createDataFrame([(*r, "s", i) for i, r in enumerate(again)], "doc_id long, text string, class_id string, kept int")
    got = near.near_classes(docs).collect()
    want = classes(rows)
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(
        (((i, c)) for (i, _), c in zip(rows, want, strict=True)), key=str
    )
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {i for i in ids if i is not None} == {c for c in want if c is not None}
    assert ids.count(None) == 1


def test_signature_estimates_similarity():
    texts = [normal(" ".join(f"a{i % 90}" for i in range(200))), normal(" ".join(f"a{i % 90}" for i in range(40, 330)))]
    values, counts, sizes = shingle_sets(texts)
    cut = int(sizes[0])
    exact = near.probability_jaccard(values[:cut], counts[:cut], values[cut:], counts[cut:])
    assert abs(exact - similarity(*map(lambda t: shingles(t.decode()), texts))) < 1e-9
    sig = near.signatures(values, counts, sizes, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_exact_similarity():
    rng = random.Random(1)
    for _ in range(200):
        x = Counter(rng.choices(range(12), k=rng.randint(1, 20)))
        y = Counter(rng.choices(range(6, 18), k=rng.randint(1, 20)))
        a, b = sorted(x), sorted(y)
        got = near.probability_jaccard(np.array(a), np.array([x[k] for k in a]), np.array(b), np.array([y[k] for k in b]))
        assert abs(got - similarity(x, y)) < 1e-12


def as_set(counts):
    keys = sorted(counts)
    weights = np.array([counts[k] for k in keys], "<u4")
    return np.array(keys, "<u8"), None if (weights == 1).all() else weights


def test_similar_to_many():
    rng = random.Random(2)
    sets = [Counter(range(5)), Counter(range(4)), Counter(range(10)), Counter(range(8)), Counter(), Counter([1, 1, 2, 2])]
    sets += [Counter(rng.choices(range(9), k=rng.randint(1, 12))) for _ in range(60)]
    for x in sets:
        got = near.similar_to(as_set(x), [as_set(y) for y in sets])
        # 4 of 5 and 8 of 10 common shingles are exactly the threshold, which is reached.
        assert got.tolist() == [similarity(x, y) >= 0.8 - 1e-12 for y in sets]


def test_links_within_blocks():
    """Links join what is similar across components, once, and in the first shared bucket only."""
    family = [Counter(range(k, k + 60)) for k in range(12)]  # neighbours up to six apart are similar
    other = [Counter(range(1000, 1040)), Counter(range(1000, 1039))]
    rows = []
    for i, x in enumerate(family + other):
        values, _ = as_set(x)
        signature = near.signatures(values, np.ones(len(values)), np.array([len(values)]))[0]
        component = b"aa" if i < 2 else bytes([i])
        for key in (3, 9):
            rows.append((key, 0, 0, 0, 0, bytes([i]), component, [9, 3], signature.astype("<u4").tobytes(), values.tobytes(), b""))
    names = ["key", "kind", "p", "q", "side", "node", "component", "keys", "signature", "shingles", "counts"]
    group = pd.DataFrame(rows, columns=names)
    found = near._links_within(group)
    assert len(found) == 10 + 1  # eleven components of the family and two others, joined without a loop
    sets = family + other
    assert all(similarity(sets[a[0]], sets[b[0]]) >= 0.8 for a, b in zip(found["a"], found["b"], strict=True))
    assert near._links_within(group[group["key"] == 9]).empty
    # One block against another: pairs inside a block are another task's.
    two = group[group["key"] == 3].assign(kind=1, side=[int(i >= 6) for i in range(14)])
    crossed = near._links_within(two)
    assert len(crossed) and all((a[0] < 6) != (b[0] < 6) for a, b in zip(crossed["a"], crossed["b"], strict=True))
    assert near._links_within(group[:0]).empty


def test_shingles():
    texts = ["a b c d e f", "", None, "a b c", "c d e f g A B C D E", "ö ß a b c d"]
    values, counts, sizes = shingle_sets([normal(t) for t in texts])
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    parts = np.split(values, np.cumsum(sizes)[:-1])
    for i, p in enumerate(texts):
        for j, q in enumerate(texts):
            assert len(np.intersect1d(parts[i], parts[j])) == len(shingles(p).keys() & shingles(q).keys())
    assert int(counts.sum()) == sum(sum(shingles(t).values()) for t in texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_classes(docs).count() == 0 and near.deduplicated(docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in (100, 101, 102, 200)}}


def test_exact_similarity_is_computed_where_the_bound_allows_it_only(monkeypatch):
    """Weighted sets that cannot reach the similarity cost no sum of their own; results are those of all sums."""
    rng = np.random.default_rng(3)
    exact = near.probability_jaccard
    calls = []
    monkeypatch.setattr(near, "probability_jaccard", lambda *sets: calls.append(1) or exact(*sets))
    pairs = similar = 0
    for share in (0.5, 0.97):
        for _ in range(60):
            a = np.sort(rng.choice(90, 40, replace=False)).astype("<u8")
            x = rng.integers(1, 4, len(a)).astype("<u4")
            others = []
            for _ in range(5):
                keep = rng.random(len(a)) < share
                y = x[keep] + (rng.random(int(keep.sum())) < 0.05).astype("<u4")
                others.append((np.append(a[keep], np.uint64(99)), np.append(y, np.uint32(1))))
            expected = [exact(a, x, b, y) >= near.SIMILARITY - near.ROUNDING for b, y in others]
            assert near.similar_to((a, x), others).tolist() == expected
            pairs, similar = pairs + len(others), similar + sum(expected)
    assert 0 < similar <= len(calls) < pairs * 0.6
