"""The learned rank index, and cuts against a plain form of the rules."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import fill_in_middle as fim
from tenderloom.llm.rank_index import ERROR, RankIndex

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_form(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed", range(6))
def test_index_is_exact_and_bounded(seed):
    rng = np.random.default_rng(seed)
    texts = [np.cumsum(np.concatenate(([0], rng.choice([1, 2, 7, 3000], n, p=[0.5, 0.3, 0.19, 0.01])))) for n in rng.integers(0, 4000, 30)]
    texts += [np.zeros(1, np.int64), np.arange(50_000)]
    starts = np.cumsum([0, *map(len, texts[:-1])])
    offsets = np.concatenate(texts).astype(np.int64)
    index = RankIndex.fit(offsets, starts)
    assert (index.offset(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index.residual.astype(int)).max() <= ERROR
    assert set(starts) <= set(index.first) and len(index.first) < len(offsets) / 10
    assert (index.first[-1], index.last[-1]) == (starts[-1], len(offsets) - 1)  # an even text is one segment


ROWS = [
    (0, None), (1, ""), (2, "one"), (3, "two words"), (4, "ünï çödé – 漢字 and 🙂🙂 more"), (5, "has <P> in it"), (6, "<M>"), (7, "<S>"),
    (8, "a<<S and >P> <M  M>"), (9, "line\nbreak\r\n\ttab\x00nul\x85"), (10, " "), (None, "no id at all, three times"), (11, "a" * 70_000),
    (12, "mixed é" * 40_000), (13, "漢" * 30_000), (13, "another text of one id"), (13, "another text of one id"), (-5, "negative id here"),
]
ROWS += [(100 + i, f"text number {i} <with> 'marks' & 1,000 digits {'<P' * (i % 3)} S>") for i in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], "doc_id long, text string, form string, n int, output string")


def test_cuts(docs):
    cut = fim.fill_in_middle(docs, ["doc_id", "form", "text"])
    got = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_form(*r) for r in ROWS), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = cut.filter(~F.coalesce("text", F.lit("")).eqNullSafe(fim.restored(F.col("output"), F.col("form"))))
    assert back.count() == 0


def test_small_slices_change_nothing(docs, monkeypatch):
    want = sorted(map(tuple, fim.fill_in_middle(docs, ["doc_id"]).collect()), key=str)
    monkeypatch.setattr(fim, "slices", lambda batch, column: (batch.slice(i, 1) for i in range(batch.num_rows)))
    assert sorted(map(tuple, fim.fill_in_middle(docs, ["doc_id"]).collect()), key=str) == want


def test_other_columns_and_empty_table(docs):
    other = fim.fill_in_middle(docs.withColumnRenamed("text", "body").withColumnRenamed("doc_id", "key"), ["key"], "2", "key", "body")
    assert other.columns == ["key", *fim.CUT.names] and other.count() == len(ROWS)
    assert fim.fill_in_middle(docs.limit(0), ["doc_id"]).count() == 0
