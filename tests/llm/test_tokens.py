"""Token counts and token files against the library itself; Simple-8b round trips."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tenderloom.llm import simple8b, token_counts, token_files
from tenderloom.llm.pieces import PieceEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (1, "The quick brown fox, it's 42!"),
    (2, None),
    (3, ""),
    (4, "the  quick\tbrown\nfox , it's 42 !"),
    (5, "The quick brown fox, it's 42!"),
    (5, "The quick brown fox, it's 42!"),
    (6, "été œuvre 中文 😀 a<|endoftext|>b <|ENDOFTEXT|>"),
    (None, "no id"),
    (7, "  The quick   brown fox, it's 42!  "),
    (8, "long " * 200_000 + "end"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, "x", i) for i, r in enumerate(ROWS)], "doc_id long, text string, n_tokens string, content int")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_library():
    letters = [*"abcXYZ ÀéßÿÖ09²½ªº\t\n\r\x0b ́œ…“😀中İıſK<|>.,!?-_", "'s", "'LL", "<|endoftext|>", "<|EndOfText|>", " "]
    rng = random.Random(7)
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(20_000)]
    small = PieceEncoder(PATH, remember=500)  # forgets often
    flat, counts = small.encode(texts[:4000]), small.count(texts[:4000])
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert list(flat[1]) == list(counts) == [len(e.ids) for e in want[:4000]]
    assert flat[0].tolist() == [i for e in want[:4000] for i in e.ids]
    assert PieceEncoder(PATH).encode(texts)[0].tolist() == [i for e in want for i in e.ids]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizer_goes_whole(name):
    path = public_tokenizers.path(name)
    texts = [t for _, t in ROWS[:-1]]
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = PieceEncoder(path).encode(texts)
    assert got[0].tolist() == [i for e in want for i in e.ids]


def test_counts(docs):
    spark = docs.sparkSession
    cache = f"{spark.conf.get('spark.checkpoint.dir')}/cache-{uuid.uuid4().hex}"
    got = token_counts.token_counts(docs, PATH, cache, normal="blanks")
    want = sorted(
        ((i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 2048) for i, t in ROWS), key=str
    )
    assert sorted(map(tuple, got.drop("content").collect()), key=str) == want
    stored = spark.read.parquet(cache)
    distinct = {" ".join((t or "").split()) for _, t in ROWS}
    assert stored.count() == len(distinct)  # one encoding per distinct normal form
    again = token_counts.token_counts(docs, PATH, cache, normal="blanks")
    assert sorted(map(tuple, again.drop("content").collect()), key=str) == want
    assert spark.read.parquet(cache).count() == len(distinct)  # nothing new to store


def test_counts_when_bits_clash(spark, monkeypatch):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    monkeypatch.setattr(token_counts, "bit_map", lambda h, bits=64: _small(h))
    monkeypatch.setattr(token_counts, "with_bit", lambda df, h, m, name: _with_small(df, h, m, name))
    cache = f"{spark.conf.get('spark.checkpoint.dir')}/cache-{uuid.uuid4().hex}"
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, cache, "blanks")
    assert got.count() == 200 and spark.read.parquet(cache).count() == 40
    assert {r.n_tokens for r in got.collect()} == {len(ids_of(f"text {i}")) for i in range(40)}


def _small(h):
    from tenderloom.llm.tables import bit_map

    return bit_map(h, 64)


def _with_small(df, h, m, name):
    from tenderloom.llm.tables import with_bit

    return with_bit(df, h, m, name, 64)


def test_counts_of_empty_table(spark):
    cache = f"{spark.conf.get('spark.checkpoint.dir')}/cache-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, PATH, cache).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    words, offsets, escapes = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, escapes).tolist() == ids
    for b in range(len(offsets)):
        block = simple8b.decode_block(words, offsets, escapes, b)
        assert block.tolist() == ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(960, np.uint64))[0]) == 8
    assert len(simple8b.encode(np.full(1000, 200, np.uint64))[0]) == 143
    assert len(simple8b.encode(np.full(400, 30_000, np.uint64))[0]) == 100


def test_files(docs):
    spark = docs.sparkSession
    path = f"{spark.conf.get('spark.checkpoint.dir')}/files-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, PATH)
    got = sorted(map(tuple, token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*ids_of(t), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_files_of_empty_table(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/files-{uuid.uuid4().hex}"
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_files.read_token_files(spark, path).count() == 0
