"""Mixing against a plain water-filling, and odd rows."""

import re
from collections import defaultdict

from tenderloom.llm import mixing

ROWS = [
    (1, "a b c d", "x"),
    (2, None, "x"),
    (3, "", "y"),
    (4, "one two\tthree\nfour\x0bfive", "y"),
    (5, "w " * 50_000, "hot"),
    (6, "same", "hot"),
    (6, "same", "hot"),
    (None, "no id here", "z"),
    (7, "no source at all", None),
    (8, "  non-breaking blanks are words", "Z"),
    *[(100 + i, "t " * (i % 17), f"s{i % 5}") for i in range(300)],
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 7, "keep") for r in rows], "doc_id long, text string, source string, copies int, target string")


def targets_of(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            return sizes, {s: 2 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= above


def test_targets_and_copies(spark):
    got = mixing.mix_counts(docs(spark)).collect()
    sizes, want = targets_of(ROWS)
    assert len(got) == len(ROWS)
    source = {i: s for i, _, s in ROWS}
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
    again = mixing.mix_counts(docs(spark, ROWS[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rows_are_emitted_with_their_columns(spark):
    mixed = mixing.mixed(docs(spark))
    assert mixed.columns == ["doc_id", "text", "source", "copies", "target"]
    n = {(r.doc_id, r.size): r.taken // r.size for r in mixing.mix_counts(docs(spark)).collect() if r.size and r.doc_id != 6}
    seen = defaultdict(int)
    for r in mixed.collect():
        assert r.copies == 7 and r.target == "keep"
        seen[r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))] += 1
    assert {k: v for k, v in seen.items() if k[1] and k[0] != 6} == {k: v for k, v in n.items() if v}


def test_empty_table_and_no_words(spark):
    assert mixing.mix_counts(docs(spark, [])).count() == 0
    assert mixing.mixed(docs(spark, [])).count() == 0
    got = mixing.mix_counts(docs(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2
