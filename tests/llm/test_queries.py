"""Every registered query of the subpackage on the smallest tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from compare import compare, connect
from tenderloom.llm import mixing, pii, queries
from test_decontaminate import brute as hits_of
from test_pii import plain
from test_prob_minhash import classes

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
QUERIES, STATEMENTS = queries.queries(), queries.statements()


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF_DIR}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement(spark, name):
    ok, text = compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], STATEMENTS[name])
    assert ok, text


def rows_of(spark, name, *columns):
    return sorted(map(tuple, QUERIES[name](spark, SF_DIR).select(*columns).collect()))


def test_pii(spark):
    want = []
    for i, t in table("documents", "doc_id, text"):
        base = plain(t or "")
        n = [sum(k == s[2] for s in base) for k in pii.KINDS]
        want.append((i, *n, hashlib.sha256(pii.joined(base).encode()).hexdigest()))
    assert rows_of(spark, "op3_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want)


def test_counts_and_files(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts, files, start = [], [], 0
    for i, t in sorted(table("documents", "doc_id, text")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        counts.append((i, len((t or "").encode()), len(ids), len(ids) > 2048))
        files.append((i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())))
        start += len(ids) + 1
    assert rows_of(spark, "op4_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == counts
    assert rows_of(spark, "op9_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == files


def test_vectors(spark):
    rows = table("embeddings", "vec_id, embedding")
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    got = {r[0]: r[1:] for r in rows_of(spark, "op5_cover_tree", "vec_id", "n_links", "component_id", "kept")}
    assert [got[i][0] for i, _ in rows] == (linked.sum(1) - 1).tolist()
    for k, (i, _) in enumerate(rows):
        assert len({got[rows[j][0]][1] for j in np.flatnonzero(linked[k])}) == 1
        assert got[i][2] == (got[i][1] == i)


def test_hits(spark):
    got = rows_of(spark, "op7_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(hits_of(table("documents", "doc_id, text"), table("benchmark", "item_id, text")))


def test_near_classes(spark):
    rows = table("documents", "doc_id, text")
    assert rows_of(spark, "op10_prob_minhash", "doc_id", "class_id") == sorted(zip((i for i, _ in rows), classes(rows), strict=True))


@pytest.mark.parametrize(("name", "limit", "folds", "fold"), [("op1_toxicity", 0.5, 5, 0), ("op6_quality", 0.7, 4, 2)])
def test_scores(spark, name, limit, folds, fold):
    rows = rows_of(spark, name, "doc_id", "held_out", "score", "predicted")
    assert [r[0] for r in rows] == sorted(i for (i,) in table("documents", "doc_id"))
    for i, held_out, score, predicted in rows:
        assert held_out == (zlib.crc32(str(i).encode()) % folds == fold)
        assert 0 <= score <= 1 and predicted == int(score >= limit)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="larger tables are not there")
@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.93), ("op6_quality", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    rows = QUERIES[name](spark, sf).filter("held_out").select("doc_id", "predicted").collect()
    right = [truth[r.doc_id] == r.predicted for r in rows if r.doc_id in truth]
    assert len(right) > 500 and sum(right) / len(right) >= least


def test_pipeline(spark):
    """The stages of the pipeline against plain versions, each on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(200)
    columns, kept = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "benchmark", "mixing", "token_files"]
    before = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        docs = docs.cache()
        if name == "token_files":
            break
        assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    score = {r[0]: r[1] for r in rows_of(spark, "op1_toxicity", "doc_id", "score")}
    assert sorted(kept["toxicity"]) == sorted(r for r in before if score[r[0]] < 0.5)
    least = classes(kept["toxicity"])
    assert sorted(kept["near_duplicates"]) == sorted(r for r, c in zip(kept["toxicity"], least, strict=True) if r[0] == c)
    clean = [r[0] for r in hits_of(kept["near_duplicates"], table("benchmark", "item_id, text")) if not r[-1]]
    assert sorted(r[0] for r in kept["benchmark"]) == sorted(clean)
    source = dict(table("documents", "doc_id, source"))
    rows = spark.createDataFrame([(*r, source[r[0]]) for r in kept["benchmark"]], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_counts(rows).collect() if r.size}
    assert sorted(r[0] for r in kept["mixing"]) == sorted(i for i, n in taken.items() for _ in range(n))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in sorted(kept["mixing"]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, docs.collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()), key=lambda r: r[1]) == want


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    odd = [(1, None, "en", None, None), (2, "", None, "a", 0), (None, "one two three", "en", "a", 3), (3, "word " * 200_000, "en", "b", 1), (3, "word " * 200_000, "en", "b", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for rows in (odd, []):
        docs = spark.createDataFrame([(*r, "extra") for r in rows], kinds)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()
