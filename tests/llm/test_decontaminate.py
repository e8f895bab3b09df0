"""Decontamination against a word-by-word search."""

import hashlib
import random
import re

import pytest

from tenderloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    keys = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            keys.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in keys}:
            for k in range(len(w) - n + 1):
                if (own := keys.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "short one"),
    (3, None),
    (4, "  ... "),
    (10, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (5, "été À l'école ÜBER straße naïve x y z w"),
    (2, "short one"),
]
DOCS = [
    (1, "intro; ALPHA, beta gamma-delta epsilon zeta eta theta iota kappa end"),
    (2, None),
    (3, ""),
    (4, "a short! one, and shortone and short oneself"),
    (5, "😀 before été À l'école ÜBER straße naïve x y z w after"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3),
    (None, "short one"),
    (7, "nothing here " * 50_000 + "short one"),
]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(*d, "x", i) for i, d in enumerate(DOCS)], "doc_id long, text string, n_words string, spans int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("shard", [1 << 24, 40])
def test_hits(tables, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    got = decontaminate.scan(*tables, ["doc_id", "n_words"])
    rows = sorted((tuple(r)[:6] for r in got.select(*(["doc_id"] + decontaminate.FOUND.names)).collect()), key=str)
    assert rows == sorted(brute(DOCS, ITEMS), key=str)
    for r in got.collect():
        text = next(t for d, t in DOCS if d == r.doc_id)
        assert sum(len(words(text[s.start : s.end])) for s in r.spans) == r.n_hit


def test_clean_documents_keep_their_columns(tables):
    kept = decontaminate.decontaminated(*tables)
    assert kept.columns == ["doc_id", "text", "n_words", "spans"]
    assert sorted((r.doc_id, r.n_words, r.spans) for r in kept.collect()) == [(2, "x", 1), (3, "x", 2)]


def test_random_texts(spark):
    rng = random.Random(4)
    vocabulary = ["a", "B", "c1", "é", "dd"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "."]) for _ in range(n))
    docs = [(i, make(rng.randint(0, 200))) for i in range(60)]
    items = [(i, make(rng.randint(0, 14))) for i in range(30)]
    machine = decontaminate.automaton(items)
    for (_, text), want in zip(docs, brute(docs, items), strict=True):
        marked, owners = decontaminate.scan_text(machine, text)
        assert (len(marked), int(marked.sum()), len(owners)) == want[1:4]


def test_words_with_bytes_85_and_a0():
    rng = random.Random(7)
    vocabulary = ["à", "Å", "Рим", "хор", "学校", "Dà", "a\u0085b", "c\u00a0d", "е\u0305", "b"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, make(rng.randint(1, 12))) for i in range(40)]
    items += [(100, "il va à la gare avec son ami Åke et la Рыба"), (101, "我们 学校 校长"), (102, "à")]
    docs = [(i, make(rng.randint(0, 120)) + rng.choice(items)[1]) for i in range(40)]
    docs += [(i, f"so, {t} end") for i, t in items]
    machine = decontaminate.automaton(items)
    for (_, text), want in zip(docs, brute(docs, items), strict=True):
        marked, owners = decontaminate.scan_text(machine, text)
        ids = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        assert (len(marked), int(marked.sum()), len(owners), ids) == want[1:5]
    for _, text in docs[40:]:
        assert decontaminate.scan_text(machine, text)[0].any()


def test_empty_tables(tables, spark):
    docs, items = tables
    assert decontaminate.scan(docs.limit(0), items, ["doc_id"]).count() == 0
    assert decontaminate.scan(docs, items.limit(0), ["doc_id"]).filter("contaminated").count() == 0
