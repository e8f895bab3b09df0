"""Near duplicates among embeddings: exact threshold links by dual traversal of cover trees.

Equal vectors are folded to one point with a weight.  Points go to the nearest of a few pivots
(the top of the tree, farthest first from a bounded sample), cells are cut into blocks of bounded
size, and each block becomes a cover tree.  Pairs of cells whose covering radii leave no room
for a link are pruned; the remaining pairs of blocks are traversed, one row each, so a cell of
any size is split over tasks.  A task returns link counts and one representative per connected
set, never the pairs, so a group of copies costs its size.

Vectors are shuffled and written once, in the precision they came in, when the blocks are made.
Everything else is told by ids and 128 bits of hash.  Tasks read the pairs of blocks from the
written blocks, so disk does not grow with the number of pairs.

Links are exact: cosine >= threshold in double precision.  The pruning depends on the data; where
all vectors are nearly orthogonal in many dimensions no bound can separate them and the pairs of
blocks grow with the square of the number of blocks.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links
with nothing, as does one without an id; vectors of different lengths do not link; rows equal in
id and vector are one vector; an id with several vectors has a row for each; an empty table
gives no rows.  Labels and other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.components import components
from tenderloom.llm.cover_tree import CoverTree, links_and_roots
from tenderloom.llm.tables import slices, written

COSINE = 0.9
#: Points of a block, pivots at most, and the sample that pivots are taken from.
BLOCK = 4096
PIVOTS = 64
SAMPLE = 2048

NODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType())])
PLACED = [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]
#: Steps of a component when the nearest pivot is looked for.
STEPS = 1 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that large components do not overflow."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _pivots(sample: list[list[float]], n: int) -> dict[int, np.ndarray]:
    """Farthest-first pivots for each vector length of the sample."""
    found = {}
    for size in sorted({len(v) for v in sample}):
        x = unit(np.array([v for v in sample if len(v) == size]))
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(n, len(x)):
            far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * x @ x[chosen[-1]])))
            if far.max() < 1e-9:
                break
            chosen.append(int(far.argmax()))
        found[size] = x[chosen]
    return found


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, usable, size and the hashes of all rows; rows of one id and vector agree in all."""
    single = isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType)
    e = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", e.alias("embedding"))
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (
        F.col("vec_id").isNotNull()
        & e.isNotNull()
        & ~F.coalesce(bad, F.lit(True))
        & F.coalesce(F.exists(e, lambda x: x != 0.0), F.lit(False))
    )
    # A hash passes over nulls, a text does not.
    text = F.transform(e, lambda x: x + F.lit(0.0)).cast("string")
    hashes = {
        name: F.when(F.col("usable"), F.xxhash64(*seed, "embedding")).otherwise(F.xxhash64(*seed, text))
        for name, seed in (("h", []), ("g", [F.lit(1)]))
    }
    return rows.withColumn("usable", usable).withColumns({**hashes, "size": F.coalesce(F.size(e), F.lit(-1))})


def _steps(x: np.ndarray) -> np.ndarray:
    return np.rint(x * STEPS).astype(np.int64)


def _place(vectors: list, pivots: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each vector and how far it is from the pivot.  Cells are chosen in whole numbers, so that a
    vector gets the same one whatever vectors it comes with."""
    cell, away = np.full(len(vectors), -1, np.int32), np.full(len(vectors), 2.0)
    size = np.array([-1 if v is None else len(v) for v in vectors])
    for n, p in pivots.items():
        own = np.flatnonzero(size == n)
        if len(own):
            x = unit(np.array([vectors[i] for i in own]))
            cell[own] = (_steps(x) @ _steps(p).T).argmax(axis=1)
            gap = x - p[cell[own]]
            away[own] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return cell, away


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray], carry: list[str], fold: bool = False) -> DataFrame:
    """``carry`` columns with cell and distance; with ``fold``, of the copies in a batch only the first."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    names = [*carry, *(f.name for f in PLACED)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if fold:
                keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g")])
                batch = batch.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1])))
            for part in slices(batch, "embedding"):
                place = _place(part.column("embedding").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], *map(pa.array, place)], names=names)

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in carry], *PLACED]))


def _block_row(vectors: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    vectors = vectors.drop_duplicates(["h", "g"])[["h", "g", "embedding"]]
    group = points.merge(vectors, on=["h", "g"]).sort_values(["id", "h"])
    if len(group) < len(points):
        raise ValueError("a vector is missing in its block")
    given = np.stack(group["embedding"].to_numpy())
    tree = CoverTree.build(unit(given))
    part = group.iloc[tree.order]
    arrays = {
        **{c: part[c].to_numpy("<i8") for c in ("id", "h", "weight")},
        **{c: getattr(tree, c).astype(_KINDS.get(c, "<i4")) for c in _TREE},
        "points": given[tree.order].astype("<f4" if given.dtype == np.float32 else "<f8"),
    }
    row = {c: [int(group[c].iloc[0])] for c in ("size", "cell", "block")}
    for name in _PARTS:
        row[name] = [np.ascontiguousarray(arrays[name]).tobytes()]
    return pd.DataFrame(row)


_TREE = ("order", "centre", "radius", "first", "last", "child", "children")
_PARTS = ("id", "h", "weight", "points", *_TREE)
_KINDS = {"id": "<i8", "h": "<i8", "weight": "<i8", "radius": "<f8"}


def _read_block(row: dict) -> tuple[CoverTree, dict[str, np.ndarray]]:
    x = {name: np.frombuffer(row[name], _KINDS.get(name, "<i4")) for name in _PARTS if name != "points"}
    x = {name: v.astype(np.int64) if v.dtype == np.int32 else v for name, v in x.items()}
    n = len(x["id"]) * row["size"]
    points = np.frombuffer(row["points"], "<f4" if len(row["points"]) == 4 * n else "<f8").reshape(-1, row["size"])
    return CoverTree(unit(points), *[x[c] for c in _TREE]), x


def _block_pairs(blocks: DataFrame, cells: list, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Rows (left, right) of block pairs that can hold a link.

    Each task reads two parts of the written blocks; nothing is shuffled, so a block takes no disk for its partners."""
    limit = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    partners = []
    for u in cells:
        near = []
        for v in cells:
            if u["size"] == v["size"] and u["cell"] <= v["cell"]:
                apart = 0.0
                if u["cell"] >= 0 and u["cell"] != v["cell"]:
                    p = pivots[u["size"]]
                    apart = float(np.linalg.norm(p[u["cell"]] - p[v["cell"]]))
                if apart <= u["away"] + v["away"] + limit:
                    near.append(v["cell"])
        partners.append((u["size"], u["cell"], near))
    spark = blocks.sparkSession
    # At most PIVOTS cells for each vector length, so the pairs of cells are few whatever the input.
    table = spark.createDataFrame(partners, "size int, cell int, near array<int>")
    struct = F.struct(*blocks.columns)
    left = blocks.join(F.broadcast(table), ["size", "cell"]).select("near", struct.alias("left"))
    right = blocks.select(struct.alias("right"))
    a, b = F.col("left"), F.col("right")
    once = (a["cell"] < b["cell"]) | ((a["cell"] == b["cell"]) & (a["block"] < b["block"]))
    can_link = (a["size"] == b["size"]) & F.array_contains(F.col("near"), b["cell"]) & once
    return left.hint("shuffle_replicate_nl").join(right, can_link).select("left", "right")


def _traversed(rows: DataFrame, cosine: float, same: bool) -> DataFrame:
    out = T.StructType([T.StructField("a", NODE), T.StructField("links", T.LongType()), T.StructField("b", NODE)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                a, xa = _read_block(row["left"])
                b, xb = (a, xa) if same else _read_block(row["right"])
                links, root = links_and_roots(a, xa["weight"], b, xb["weight"], cosine, same)
                ids, h = (x if same else np.concatenate((x, y)) for x, y in ((xa["id"], xb["id"]), (xa["h"], xb["h"])))
                own = np.flatnonzero(links > 0)
                for k in range(0, len(own), 10_000):
                    at = own[k : k + 10_000]
                    nodes = [
                        pa.StructArray.from_arrays([pa.array(ids[i]), pa.array(h[i])], names=["id", "h"]) for i in (at, root[at])
                    ]
                    yield pa.RecordBatch.from_arrays([nodes[0], pa.array(links[at]), nodes[1]], names=["a", "links", "b"])

    return rows.mapInArrow(run, out)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    given = _keyed(vectors)
    vector = ["h", "g", "size"]
    good = given.filter("usable")
    n = good.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    # About twice the sample, by hash: copies of a vector count once.
    every = max(1, n // (2 * SAMPLE))
    some = good.filter(F.pmod("g", F.lit(every)) == 0).groupBy(*vector).agg(F.first("embedding").alias("embedding"))
    sample = [r.embedding for r in some.orderBy("g", "h").limit(SAMPLE).select("embedding").collect()]
    pivots = _pivots(sample, min(PIVOTS, max(1, n // BLOCK)))
    row = ["vec_id", *vector, "usable"]
    places = _placed(given.withColumn("embedding", F.when(F.col("usable"), F.col("embedding"))), pivots, row)
    rows = written(places.groupBy(*row, "cell").agg(F.max("away").alias("away")), "vector-rows")
    points = written(
        rows.filter("usable")
        .groupBy(*vector, "cell")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.max("away").alias("away")),
        "vector-points",
    )
    per_cell = points.groupBy("size", "cell").agg(
        F.max("away").alias("away"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    cells = [r.asDict() for r in per_cell.collect()]  # at most PIVOTS rows for each vector length
    counts = points.sparkSession.createDataFrame(
        [(c["size"], c["cell"], c["blocks"]) for c in cells], "size int, cell int, blocks int"
    )

    def blocked(df: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("h", "g"), F.col("blocks")).cast("int")
        return df.join(F.broadcast(counts), ["size", "cell"]).withColumn("block", block).drop("blocks", "away")

    key = ["size", "cell", "block"]
    shape = "size int, cell int, block int, " + ", ".join(f"{p} binary" for p in _PARTS)
    blocks = written(
        blocked(_placed(good, pivots, [*vector, "embedding"], fold=True))
        .groupBy(*key)
        .cogroup(blocked(points).groupBy(*key))
        .applyInPandas(_block_row, shape),
        "vector-blocks",
    )
    inside = _traversed(blocks.select(F.struct(*blocks.columns).alias("left")), cosine, same=True)
    across = _traversed(_block_pairs(blocks, cells, pivots, cosine), cosine, same=False)
    found = written(inside.unionByName(across), "vector-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = components(found.select("a", "b"))

    # Copies of one vector are linked among themselves and share the links of their point.
    per_point = points.withColumn("node", F.struct("id", "h"))
    per_point = (
        per_point.join(links, "node", "left")
        .join(known, "node", "left")
        .select(
            *vector,
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce(F.col("component")["id"], F.col("node")["id"]).alias("component_id"),
        )
    )
    good = rows.filter("usable").join(per_point, vector).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
