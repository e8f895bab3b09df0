"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window
is ten consecutive words of an item; an item of fewer words, but not none, is one window.
The automaton holds every window as a key between blanks, and each document is scanned once;
match ends are mapped back to word numbers and those to code points of the original text.

Defined results: a null or empty text has no words and is clean; repeated items share their
windows and are all reported; null item texts are ignored; an empty benchmark leaves all
documents clean; an empty table gives no rows.  Columns of the documents that have the name
of a result are replaced, all others can be carried through.

Items are broadcast in shards of at most ``SHARD_BYTES`` of text, one pass over the rows per
shard, so a benchmark of any size is matched whole with bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.tables import map_column, named_again, numbered_columns

WINDOW = 10
SHARD_BYTES = 16 << 20

# Bytes of UTF-8: digits, letters and everything beyond ASCII are word bytes.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField(
            "spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
        ),
    ]
)


def normal_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)


def automaton(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> ahocorasick.Automaton:
    """Keys are windows between blanks, one character per byte; values are (words, item ids)."""
    owners: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        words = normal_bytes(text).split()  # as bytes: str.split() takes 85 and A0 for blanks
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            key = (b" " + b" ".join(words[i : i + n]) + b" ").decode("latin-1")
            owners.setdefault(key, (n, set()))[1].add(str(item_id))
    found = ahocorasick.Automaton()
    for key, value in owners.items():
        found.add_word(key, value)
    if owners:
        found.make_automaton()
    return found


def word_spans(text: str, marked: np.ndarray) -> list[dict[str, int]]:
    """Runs of marked words as code point ranges of the original text."""
    raw = np.frombuffer(normal_bytes(text), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], raw.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    run = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    first, last = starts[run[::2]], ends[run[1::2] - 1]
    lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(lead)))  # code points before each byte
    return [{"start": int(a), "end": int(b)} for a, b in zip(points[first], points[last], strict=True)]


def scan_text(machine: ahocorasick.Automaton, text: str | None) -> tuple[np.ndarray, set[str]]:
    """Which words of the text are hit, and the items with an occurring window."""
    words = normal_bytes(text).split()
    marked, items = np.zeros(len(words), bool), set()
    if not len(machine) or not words:
        return marked, items
    line = b" " + b" ".join(words) + b" "
    ends: list[tuple[int, int]] = []
    for end, (n, owners) in machine.iter(line.decode("latin-1")):
        ends.append((end, n))
        items |= owners
    if ends:
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        at = np.array(ends)
        last = np.searchsorted(blanks, at[:, 0])  # number of words up to the match's end
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, last - at[:, 1], 1)
        np.add.at(depth, last, -1)
        marked = np.cumsum(depth[:-1]) > 0
    return marked, items


def scan(
    docs: DataFrame, benchmark: DataFrame, carry: Sequence[str], window: int = WINDOW, text: str = "text"
) -> DataFrame:
    """``carry`` columns of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated,
    item_ids and the hit code point ranges of each whole text."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    state = T.StructType([T.StructField("_words", T.BinaryType()), T.StructField("_owners", T.ArrayType(T.StringType()))])
    carry = [c for c in carry if c not in FOUND.names]

    def rows_of(shard: int) -> list[Row]:
        own = items if shards == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard)
        return [(r.item_id, r.text) for r in own.collect()]  # about SHARD_BYTES

    def finished(text: str | None, marked: np.ndarray, owners: set[str]) -> dict[str, object]:
        ids = sorted(owners)
        return {
            "n_words": len(marked),
            "n_hit": int(marked.sum()),
            "n_items": len(ids),
            "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(),
            "contaminated": bool(marked.any()),
            "item_ids": ids,
            "spans": word_spans(text, marked) if marked.any() else [],
        }

    def one_pass(known: list[tuple[object, str]], whole: bool):
        shared = spark.sparkContext.broadcast(known)

        def make():
            machine = automaton(shared.value, window)

            def work(texts: list[str | None]) -> dict[str, list]:
                found = [(t, *scan_text(machine, t)) for t in texts]
                if whole:
                    done = [finished(*x) for x in found]
                    return {k: [d[k] for d in done] for k in FOUND.names}
                return {"_words": [m.tobytes() for _, m, _ in found], "_owners": [sorted(o) for *_, o in found]}

            return work

        return make

    if shards == 1:
        return map_column(docs, text, one_pass(rows_of(0), True), FOUND, carry)
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("_text"))
    for k in range(shards):
        step = T.StructType([T.StructField(f"{f.name}{k}", f.dataType) for f in state])
        make = one_pass(rows_of(k), False)

        def renamed(make=make, k=k):
            work = make()
            return lambda texts: {f"{name}{k}": v for name, v in work(texts).items()}

        rows = map_column(rows, "_text", renamed, step, rows.columns)

    def merge():
        def work(parts: list[dict]) -> dict[str, list]:
            done = []
            for p in parts:
                marks = [np.frombuffer(m, bool) for m in p["words"]]
                done.append(finished(p["text"], np.logical_or.reduce(marks), set().union(*p["owners"])))
            return {k: [d[k] for d in done] for k in FOUND.names}

        return work

    packed = rows.withColumn(
        "_all",
        F.struct(
            F.col("_text").alias("text"),
            F.array(*[f"_words{k}" for k in range(shards)]).alias("words"),
            F.array(*[f"_owners{k}" for k in range(shards)]).alias("owners"),
        ),
    )
    return map_column(packed, "_all", merge, FOUND, carry)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, with the columns of ``docs``."""
    plain, short = numbered_columns(docs)
    found = scan(plain, benchmark, plain.columns, window, short["text"])
    return named_again(found.filter(~F.col("contaminated")), short)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
        ["doc_id"],
    )
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
