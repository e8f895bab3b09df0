"""Integer vectors in blocks, and query blocks against row blocks.

Components x become floor(scale * x).  Rows are packed into blocks of bounded bytes by a hash of
their id, so equal vectors are spread evenly.  A cell of the grid is one block of queries with a
bounded range of row blocks; it is one group of a cogroup, whose memory is bounded whatever the
input.  A query keeps its best rows over the whole range, so a cell returns few rows per query.

Defined results: a vector that is null or holds a null or non-finite component takes no part, nor
does a row without an id or one whose inner products could leave a 64-bit integer (components
beyond sqrt(2^63 / length)).  An id counts once: of its vectors the least by bytes.  Vectors of
different lengths do not meet; empty ones meet with score 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tenderloom.llm.tables import written

SCALE = 256
#: Vector bytes of a block of rows and of a block of queries, at two bytes a component.
ROW_BYTES = 512 << 10
QUERY_BYTES = 4 << 20
#: Row blocks of one cell at most.
RANGE = 64

_LABEL = T.StructField("label", T.LongType())
VECTOR = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("v", T.BinaryType()),
        _LABEL,
    ]
)


def _integers(lists: pa.ListArray, scale: int) -> list[bytes | None]:
    """The floored components of each list as little-endian integers of two bytes, or eight where two do
    not hold them; None for a list that takes no part."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        c = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        most = np.repeat([math.isqrt((2**63 - 1) // max(int(n), 1)) for n in lengths], lengths)
        wrong, large = ~(np.abs(c) <= most), np.abs(c) > 32767
    at = np.concatenate(([0], np.cumsum(lengths)))
    n_wrong, n_large = (np.diff(np.concatenate(([0], np.cumsum(flags)))[at]) for flags in (wrong, large))
    ok = (n_wrong == 0) & pc.is_valid(lists).to_numpy(zero_copy_only=False)
    rows = zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist(), (n_large > 0).tolist(), strict=True)
    return [c[s:e].astype("<i8" if w else "<i2").tobytes() if good else None for s, e, good, w in rows]


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """Rows (id, size, v, label) that take part, written; each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            found = _integers(lists, scale)
            out = [batch.column("id"), pc.list_value_length(lists), pa.array(found, pa.binary()), batch.column("label")]
            yield pa.RecordBatch.from_arrays(out, names=VECTOR.names)

    given = rows.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
        (F.lit(None) if label is None else label).cast("long").alias("label"),
    )
    found = given.filter("id is not null and v is not null").mapInArrow(run, VECTOR).filter("v is not null")
    once = found.groupBy("id").agg(F.min(F.struct("size", "v", "label")).alias("row")).select("id", "row.*")
    return written(once, "integer-vectors")


def matrix(blobs: Sequence[bytes], size: int) -> np.ndarray:
    """Rows of ``size`` integers: two bytes each if all rows have that, else eight."""
    if not size:
        return np.zeros((len(blobs), 0), np.int16)
    rows = [np.frombuffer(b, "<i2" if len(b) == 2 * size else "<i8") for b in blobs]
    return np.stack(rows)


def exact(a: np.ndarray) -> np.ndarray:
    """As doubles where every inner product of two such rows is below 2^53, else as 64-bit integers."""
    if not a.size or float(np.abs(a).max()) ** 2 * a.shape[1] < 2**52:
        return a.astype(np.float64)
    return a.astype(np.int64)


def n_blocks(n: int, limit: int) -> Column:
    """Blocks that ``n`` rows of the column ``size`` make."""
    return F.greatest(F.lit(1), F.ceil(F.col("size") * F.lit(2.0 * n / limit))).cast("int")


def blocks(
    rows: DataFrame,
    n: int,
    limit: int,
    more: Callable[[int, pa.Table, np.ndarray], dict[str, np.ndarray]] = lambda size, table, x: {},
    extra: Sequence[str] = (),
) -> DataFrame:
    """Rows (size, block, ids, v, *extra) of packed vectors.  ``more`` gives the arrays of ``extra``
    from the vector length, the rows and their matrix."""

    def pack(table: pa.Table) -> pa.Table:
        size, block = table.column("size")[0].as_py(), table.column("block")[0].as_py()
        table = table.sort_by("id")
        x = matrix(table.column("v").to_pylist(), size)
        arrays = {"ids": table.column("id").to_numpy().astype("<i8"), "v": x} | more(size, table, x)
        row = {"size": pa.array([size], pa.int32()), "block": pa.array([block], pa.int32())}
        return pa.table(row | {k: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for k, a in arrays.items()})

    shape = "size int, block int, " + ", ".join(f"{c} binary" for c in ("ids", "v", *extra))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), n_blocks(n, limit)).cast("int"))
    return dealt.groupBy("size", "block").applyInArrow(pack, shape)


def unpacked(size: int, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a block."""
    ids = np.frombuffer(row["ids"], "<i8")
    kind = "<i2" if len(row["v"]) == 2 * size * len(ids) else "<i8"
    return ids, np.frombuffer(row["v"], kind).reshape(len(ids), size)


def over_grid(
    queries: DataFrame,
    n_queries: int,
    rows: DataFrame,
    n_rows: int,
    work: Callable[[int, dict, Iterator[dict]], pa.Table],
    out: T.StructType,
) -> DataFrame:
    """``work(size, query block, row blocks)`` for every cell of the grid of two tables of ``blocks``."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    n_q = max(1, queries.count())
    held = max(1, rows.count())
    # A few cells for each core; a cell has at most RANGE blocks whatever the input.
    step = min(RANGE, max(1, held * n_q // (6 * parallel)))
    cells = -(-held // step) * n_q

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema=empty)
        found = (right.slice(i, 1).to_pylist()[0] for i in range(right.num_rows))
        return work(key[0].as_py(), left.to_pylist()[0], found)

    empty = to_arrow_schema(out)
    last = F.floor((n_blocks(n_rows, ROW_BYTES) - 1) / step).cast("int")
    key = ["size", "q", "r"]
    left = queries.withColumnRenamed("block", "q").withColumn("r", F.explode(F.sequence(F.lit(0), last)))
    right = rows.withColumn("q", F.explode(F.sequence(F.lit(0), n_blocks(n_queries, QUERY_BYTES) - 1)))
    right = right.withColumn("r", F.floor(F.col("block") / step).cast("int"))
    n = max(1, min(cells, 10_000))
    left, right = (x.repartition(n, *key) for x in (left, right))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, out)
