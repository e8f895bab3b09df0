"""Base spans against the plain patterns, the field's training and decoding."""

import time
import tracemalloc
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tenderloom.llm import pii
from tenderloom.llm.crf import Crf

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d))
                or (kind == "phone" and 9 <= len(d) <= 15)
            ):
                out.append((m.start(), m.end(), kind))
    return pii.in_order(out)


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_base_spans():
    rng = random.Random(5)
    letters = [*"ab.@-+%_ 0123456789()\n😀", "1.2.3.4", "@a.b", "+12", "255.", "4111 1111 1111 1111", "000"]
    for _ in range(20_000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + " @", "1" * 300_000, "+" * 300_000, "a@" * 100_000, "1." * 100_000):
        pii.base_spans(text)


def test_training_and_examples(field):
    for text, spans in pii.read_labelled():
        assert sorted(pii.field_spans(field, [text])[0]) == sorted(spans), text
    for text, kind, part in (
        ("my number: (434) 555-2368 ok", "phone", "(434) 555-2368"),
        ("write john (at) foo.com now", "email", "john (at) foo.com"),
        ("the 4111.1111.1111.1111 card", "card", "4111.1111.1111.1111"),
    ):
        base, more = pii.find_all(field, [text])[0]
        assert [(k, text[a:b]) for a, b, k in more] == [(kind, part)] and not base


def test_spelled_out_addresses(field):
    for part in ("jane.doe(at)example(dot)org", "jane.doe [AT] example [DOT] org", "jane.doe (At) example (Dot) org"):
        for text in (part, f"write to {part} for more"):
            assert [(k, text[a:b]) for a, b, k in pii.field_spans(field, [text])[0]] == [("email", part)]
    (a, b), text = pii.windows(t := "one two jane at mail dot example dot org dot uk three")[0], t
    assert "jane at mail dot example dot org dot uk" in text[a:b]


def test_windows_decode_as_whole_texts(field, monkeypatch):
    rng = random.Random(1)
    spans = [t[a:b] for t, found in pii.read_labelled() for a, b, _ in found]
    spans += ["jane.doe(at)example(dot)org", "jane.doe [AT] example [DOT] org", "jane at example dot org", "a (at) b dot c dot org"]
    words = "the of and call card host mail, on. (a) In to: page Which – order those it's — .. DOT org é. version".split()
    texts = []
    for _ in range(400):
        parts = rng.choices(words, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 4)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(spans))
        texts.append(rng.choice((" ", "\n")).join(parts))
    got = pii.field_spans(field, texts)
    monkeypatch.setattr(pii, "windows", lambda text: [(0, len(text))] if text else [])
    want = pii.field_spans(field, texts)
    assert sum(map(len, want)) > 300
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if sorted(g) != sorted(w)] == []


def test_decode_is_the_best_path():
    rng = np.random.default_rng(1)
    crf = Crf(12, 3)
    crf.emit, crf.move = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    batch = [rng.integers(0, 12, (n, 2)) for n in (1, 4, 6, 2)]
    for x, got in zip(batch, crf.decode(batch), strict=True):
        score = crf.scores(x)
        value = lambda y: sum(score[t, k] for t, k in enumerate(y)) + sum(crf.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023,E731
        assert tuple(got) == max(itertools.product(range(3), repeat=len(x)), key=value)


def test_gradient_fits_separable_labels():
    crf = Crf(4, 2)
    crf.fit([np.array([[0], [1], [0]]), np.array([[1], [1]])], [np.array([0, 1, 0]), np.array([1, 1])], rounds=100)
    assert [list(y) for y in crf.decode([np.array([[1], [0], [1]])])] == [[1, 0, 1]]


def test_table(spark):
    rows = [(1, "mail a.b@c.de, +49 30 901820 55"), (2, None), (3, ""), (1, "mail a.b@c.de, +49 30 901820 55"), (None, "x 10.0.0.1"), (4, "z " * 100_000 + "(212) 555-0147 call")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.personal_data(docs, ["doc_id", "spans"]).collect()}
    assert got[1].spans == "email:5:13,phone:15:31" and (got[1].n_email, got[1].n_phone) == (1, 1)
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert got[None].n_ip == 1
    assert got[4].spans == "phone:200000:200014" and got[4].n_phone == 0 and got[4].n_added == 1
    assert pii.personal_data(docs.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("piece", ["7 a ", "7 - ", "1.2 . ", "at . ", "x@y.zz "])
def test_long_texts_take_time_in_proportion(piece):
    """Rows of numbers, marks and links: no work in pairs of them."""
    field = pii.train()
    seconds = []
    for n in (2_000, 16_000):
        began = time.perf_counter()
        pii.find_all(field, [piece * n])
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 20 * max(seconds[0], 0.05)


def test_one_long_window_beside_short_ones_is_not_padded():
    lengths = [5] * 300 + [9_000, 200_000, 40]
    batches = list(pii._batches(lengths))
    assert sorted(k for b in batches for k in b) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) * max(lengths[k] for k in b) <= pii.BATCH_TOKENS for b in batches)
    tracemalloc.start()
    pii.find_all(pii.train(), ["call 1 " + ". " * 60_000, *["tel 030 1234 5678"] * 255])
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_added_spans_keep_away_from_base_spans():
    rng = random.Random(5)
    for _ in range(200):
        spans = lambda n: [(a := rng.randrange(60), a + rng.randrange(1, 15), "ip") for _ in range(n)]
        base, more = sorted(spans(rng.randrange(6))), spans(6)
        assert pii.apart(more, base) == [s for s in more if not any(s[0] < b and s[1] > a for a, b, _ in base)]
