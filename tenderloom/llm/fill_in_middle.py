"""Fill-in-the-middle: texts cut at token boundaries into prefix, middle and suffix, and rearranged.

A token is a run of A-Z and a-z or any other single character.  Boundaries are found on the UTF-8
bytes of a whole batch at once, a ``RankIndex`` is fitted to all of them, and the two cuts of a
text are looked up in it.  Cuts, forms and counts depend on the seed and the document id alone,
so a lost task gives the same rows again.  ``restored`` rebuilds the text from its output in Spark
expressions.

Defined results: a null text is an empty one, and that is plain; so is a text that holds one of the
marks.  A null id is drawn like the empty string.  Prefix, middle or suffix may be empty.  Texts
are handled whole, one very long text in a batch of its own; repeated rows are treated row by row
and rows of one id alike; an empty table gives no rows.  Other columns are carried if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tenderloom.llm.rank_index import RankIndex
from tenderloom.llm.tables import slices

SEED = "1"
PLAIN_FROM, SPM_BELOW = 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

CUT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


class TextBoundaries:
    """Token boundaries of a batch: byte offsets within each text, and where each text's begin."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        lower = data | 32
        letter = (lower >= ord("a")) & (lower <= ord("z")) & (data < 128)
        inner = (data & 0xC0) == 0x80
        opens = ~inner & ~(letter & np.concatenate(([False], letter[:-1])))
        filled = starts[ends > starts]
        opens[filled] = True
        before = np.concatenate(([0], np.cumsum(opens)))
        self.n = before[ends] - before[starts]
        # Every text has the boundaries of its n tokens and its end.
        self.starts = np.cumsum(self.n + 1) - (self.n + 1)
        self.offsets = np.zeros(int((self.n + 1).sum()), np.int64)
        at = np.ones(len(self.offsets), bool)
        at[self.starts + self.n] = False
        self.offsets[at] = np.flatnonzero(opens) - np.repeat(starts, self.n)
        self.offsets[~at] = ends - starts
        self.chars = np.concatenate(([0], np.cumsum(~inner)))


def _arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def _cut(texts: pa.Array, draws: list[np.ndarray]) -> dict[str, pa.Array]:
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    buffers = raw.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    starts, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    found = TextBoundaries(data, starts, ends)
    index = RankIndex.fit(found.offsets, found.starts)
    units = np.sort(np.stack([d % (found.n + 1) for d in draws[:2]]), axis=0)
    cuts = index.offset(found.starts + units)
    chars = [found.chars[starts + c] for c in cuts]
    forms, outputs = [], []
    for text, a, b, h3, h4 in zip(raw.to_pylist(), *cuts.tolist(), draws[2].tolist(), draws[3].tolist(), strict=True):
        plain = not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
        forms.append("plain" if plain else "spm" if h4 % 100 < SPM_BELOW else "psm")
        outputs.append(text if plain else _arranged(text, forms[-1], a, b))
    plain = np.array([f == "plain" for f in forms], bool)
    return {
        "n": pa.array(found.n, pa.int64()),
        "form": pa.array(forms, pa.string()),
        "prefix_chars": pa.array(chars[0] - found.chars[starts], pa.int64(), mask=plain),
        "middle_chars": pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
        "output": pa.array(outputs, pa.binary()).cast(pa.string()),
    }


def fill_in_middle(docs: DataFrame, carry: Sequence[str], seed: str = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``carry`` columns of ``docs`` and n, form, prefix_chars, middle_chars, output; a carried column
    with the name of one of these is replaced by it."""
    carry = [c for c in dict.fromkeys(carry) if c not in CUT.names]
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring("_drawn", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    kept = [F.col(f"`{c}`") for c in carry]
    rows = docs.select(*kept, F.col(f"`{text}`").alias("_text"), drawn.alias("_drawn")).select(*kept, "_text", *parts)
    fields = [docs.schema[c] for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = _cut(part.column("_text"), [part.column(f"_h{i}").to_numpy() for i in range(4)])
                arrays = [part.column(c).cast(to_arrow_type(f.dataType)) for c, f in zip(carry, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, *found.values()], names=[*carry, *found])

    return rows.mapInArrow(run, T.StructType([*fields, *CUT.fields]))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: each mark occurs once, and no mark can form across a cut."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda x, mark: F.substring_index(x, mark, -1)
    before = lambda x, mark: F.substring_index(x, mark, 1)
    middle = after(output, m)
    psm = F.concat(before(after(output, p), s), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
cuts AS (
  SELECT doc_id, text, units, len(units) AS n,
    least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
    array_to_string(units[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
