"""Near duplicates by ProbMinHash, banding and exact verification.

A document is a set of word shingles weighted by how often they occur.  Each shingle is a
Poisson process with its weight as rate; every arrival falls on a random slot, and a slot keeps
the shingle that arrives first.  A shingle's process stops once its time is beyond the last
slot's, so the work is about one arrival per shingle and a few per slot.  Two signatures
agree in a slot with the probability Jaccard similarity

    J(x, y) = sum over d of 1 / sum over e of max(x_e / x_d, y_e / y_d),

which is the Jaccard similarity where all weights are equal.  Texts that share a band of their
signature are candidates, and J of candidates is computed exactly from the shingles.

Documents with equal words are one node from the start, and buckets with equal members are one
bucket.  In each bucket the members are verified against a leader, and the links found make
components.  Buckets that still hold several components are cut into blocks of bounded rows and
bytes; a task takes two blocks with the shingles of their members, verifies what the signatures
leave open in the first bucket that a pair shares, and joins components as it goes.  It returns
links only, at most one for each member: candidate pairs are never rows, no bucket is capped or
gathered whole, and pairs inside a component are not looked at.

Defined results: null and empty texts have no shingles and form one class of copies; a null id
takes part by its text (a class of null ids only has a null class id); rows equal in id and
text are one document, returned (and kept) once; an id with several texts is several documents;
an empty table gives no rows.  Columns beside id and text do not matter and are kept by
``deduplicated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.components import components
from tenderloom.llm.shingles import WORDS, mix, normal, shingle_sets
from tenderloom.llm.tables import bit_map, map_column, named_again, numbered_columns, with_bit, written

SIMILARITY = 0.8
#: What the sum of a similarity of weighted sets may lose to rounding.
ROUNDING = 1e-12
#: The same for the bound that spares the exact similarity.
BOUND_ROUNDING = 1e-9
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: A pair of similarity SIMILARITY agrees in fewer slots than this once in some millions (five deviations).
LEAST_AGREE = int(SLOTS * SIMILARITY - 5 * (SLOTS * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Rows and shingle bytes that small buckets share a task's group with.
GROUP, GROUP_BYTES = 4000, 16 << 20
#: Rows and shingle bytes of a block when buckets are compared across components.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Shingle bytes of a partition of blocks.
PARTITION_BYTES = 64 << 20
#: Candidates of a member that are verified before its component is looked up again.
AT_ONCE = 16

_GOLDEN = 0x9E3779B97F4A7C15

SIGNED = T.StructType(
    [
        T.StructField("node", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
    ]
)
SHINGLED = T.StructType([T.StructField("shingles", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def signatures(values: np.ndarray, weights: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` shingle numbers (32 bits) for each set; empty sets keep zeros."""
    n = len(sizes)
    first = np.full((n, slots), np.inf)
    winner = np.zeros((n, slots), np.uint32)
    flat, owner = first.reshape(-1), np.repeat(np.arange(n), sizes)
    won = winner.reshape(-1)
    time, live, arrival = np.zeros(len(values)), np.arange(len(values)), 0
    while len(live):
        arrival += 1
        draw = mix(values[live] + np.uint64(_GOLDEN * 2 * arrival % (1 << 64)))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time[live] -= np.log(uniform) / weights[live]
        slot = (mix(draw ^ np.uint64(_GOLDEN)) >> np.uint64(32)).astype(np.int64) % slots
        at = owner[live] * slots + slot
        np.minimum.at(flat, at, time[live])
        best = flat[at] == time[live]
        won[at[best]] = (values[live[best]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        last = first.max(axis=1)
        live = live[time[live] < last[owner[live]]]
    return winner


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact J of two weighted sets, given as ascending shingles and their weights."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = x.astype(float), y.astype(float)
    xs = np.concatenate((x[i], np.delete(x, i), np.zeros(len(b) - len(j))))
    ys = np.concatenate((y[j], np.zeros(len(a) - len(i)), np.delete(y, j)))
    with np.errstate(divide="ignore"):
        ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    ratio, below = ratio[order], np.concatenate(([0.0], np.cumsum(ys[order])))
    above = np.concatenate((np.cumsum(xs[order][::-1])[::-1], [0.0]))
    rho = x[i] / y[j]
    k = np.searchsorted(ratio, rho, side="left")
    return float((x[i] / (above[k] + rho * below[k])).sum())


def similar_to(one: tuple, others: list[tuple]) -> np.ndarray:
    """Which of ``others`` reach SIMILARITY to ``one``; a set is (ascending shingles, weights or None if all are 1)."""
    a, x = one
    sizes = np.array([len(b) for b, _ in others], np.int64)
    ends = np.cumsum(sizes)
    if not len(a):
        return sizes == 0
    every = np.concatenate([b for b, _ in others])
    at = np.minimum(np.searchsorted(a, every), len(a) - 1)
    hit = a[at] == every
    hits = np.concatenate(([0], np.cumsum(hit)))
    common = hits[ends] - hits[ends - sizes]
    found = common >= SIMILARITY * (len(a) + sizes - common)
    weighted = np.array([not (x is None and y is None) for _, y in others], bool)
    if not weighted.any():
        return found
    x_all = np.ones(len(a)) if x is None else x.astype(float)
    y_all = np.concatenate([np.ones(len(b)) if y is None else y.astype(float) for b, y in others])
    found[weighted] = (_most_similar(x_all, y_all, at, hit, sizes) >= SIMILARITY - BOUND_ROUNDING)[weighted]
    for k in np.flatnonzero(found & weighted).tolist():
        b, y = others[k]
        ones = [np.ones(len(v), np.uint32) if w is None else w for v, w in ((a, x), (b, y))]
        found[k] = probability_jaccard(a, ones[0], b, ones[1]) >= SIMILARITY - ROUNDING
    return found


def _most_similar(x: np.ndarray, y: np.ndarray, at: np.ndarray, hit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The most that J of one set (weights ``x``) and each of several (weights ``y`` one after the other, of
    ``sizes``) can be; a hit is an element of the several that is element ``at`` of the one.

    In J's sum of max(x_e / x_d, y_e / y_d), what is in one set alone counts in full and the common part for
    at least the greater of its two sums.  Equal where the common weights have one ratio."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    whole = np.bincount(owner, y, n)
    owner, x_d, y_d = owner[hit], x[at[hit]], y[hit]
    x_both, y_both = np.bincount(owner, x_d, n), np.bincount(owner, y_d, n)
    alone = (x.sum() - x_both)[owner] / x_d + (whole - y_both)[owner] / y_d
    return np.bincount(owner, 1 / (alone + np.maximum(x_both[owner] / x_d, y_both[owner] / y_d)), n)


def _stored_set(shingles: bytes, counts: bytes) -> tuple:
    return np.frombuffer(shingles, "<u8"), np.frombuffer(counts, "<u4") if counts else None


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, content (hash of the exact text), node (digest of its words), signature, n_shingles."""

    def make():
        def work(texts: list[str | None]) -> dict[str, list]:
            words = [normal(t) for t in texts]
            values, counts, sizes = shingle_sets(words)
            found = signatures(values, counts, sizes)
            return {
                "node": [hashlib.blake2b(w, digest_size=16).digest() for w in words],
                "signature": [s.astype("<u4").tobytes() for s in found],
                "n_shingles": sizes,
            }

        return work

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("content", F.xxhash64("text"))
    return map_column(rows, "text", make, SIGNED, ["doc_id", "content"])


def _agreement(a: str, b: str):
    @F.pandas_udf(T.IntegerType())
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        p = np.frombuffer(b"".join(x), "<u4").reshape(len(x), -1)
        q = np.frombuffer(b"".join(y), "<u4").reshape(len(y), -1)
        return pd.Series((p == q).sum(axis=1).astype("int32"))

    return count(F.col(a), F.col(b))


def _texts_of(nodes: DataFrame, firsts: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text) of distinct ``nodes``.

    Only documents that stand for one of the nodes have their texts moved; a bit map of fixed
    size leaves out the others before the shuffle and the join then is exact."""
    wanted = written(nodes.join(firsts, "node").select("node", "first.*"), "near-wanted")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    row_hash = F.xxhash64("doc_id", "content")
    bits = written(bit_map(wanted.select(row_hash.alias("h"))), "near-bits")
    likely = with_bit(rows, row_hash, bits, "likely").filter("likely").select("doc_id", "content", "text")
    w = wanted.withColumnsRenamed({"doc_id": "w_id", "content": "w_content"})
    texts = likely.join(w, F.expr("content = w_content and doc_id <=> w_id"))
    return texts.select("node", "text").dropDuplicates(["node"])


def _sets(texts: DataFrame) -> DataFrame:
    """(node, shingles, counts) of (node, text); counts are empty where each shingle occurs once."""

    def make():
        def work(found: list[str]) -> dict[str, list]:
            values, counts, sizes = shingle_sets([normal(t) for t in found])
            cut = np.cumsum(sizes)[:-1]
            return {
                "shingles": [v.astype("<u8").tobytes() for v in np.split(values, cut)],
                "counts": [c.astype("<u4").tobytes() if (c != 1).any() else b"" for c in np.split(counts, cut)],
            }

        return work

    return written(map_column(texts, "text", make, SHINGLED, ["node"]), "near-shingles")


def _verified(pairs: DataFrame, texts_of) -> DataFrame:
    """The ``pairs`` (a, b) that are similar, by the exact similarity of their shingles."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(texts_of(needed))

    @F.pandas_udf(T.BooleanType())
    def similar(a: pd.Series, x: pd.Series, b: pd.Series, y: pd.Series) -> pd.Series:
        found = [
            bool(similar_to(_stored_set(p, q), [_stored_set(r, s)])[0]) for p, q, r, s in zip(a, x, b, y, strict=True)
        ]
        return pd.Series(found, dtype="bool")

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    found = pairs.join(left, "a").join(right, "b").filter(similar("sa", "ca", "sb", "cb"))
    return written(found.select("a", "b"), "near-links")


def _leader_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each member with the leader of its bucket, the least by a hash, where the signatures agree enough."""
    least = F.min(F.struct(F.xxhash64("node"), "node"))["node"]
    leaders = members.groupBy("key").agg(least.alias("leader"))
    pairs = members.join(leaders, "key").filter("node != leader")
    pairs = pairs.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("signature").alias("s")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("signature").alias("t")), "b"
    )
    return written(both.filter(_agreement("s", "t") >= LEAST_AGREE).select("a", "b"), "near-pairs")


def _links_within(group: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join the components of a group's pairs of blocks, from its rows
    (key, kind, p, q, side, node, component, keys, signature, shingles, counts).

    A pair is looked at in the least of the buckets that both are members of."""
    group = group.sort_values(["key", "kind", "p", "q", "side"], kind="stable")
    sig = np.frombuffer(b"".join(group["signature"]), "<u4").reshape(len(group), SLOTS)
    place = group[["key", "kind", "p", "q"]].to_numpy()
    label = pd.factorize(group["component"])[0]
    node, side = group["node"].to_numpy(), group["side"].to_numpy()
    sets = [_stored_set(v, c) for v, c in zip(group["shingles"], group["counts"], strict=True)]
    earlier = [{k for k in ks if k < key} for ks, key in zip(group["keys"], group["key"], strict=True)]
    edge = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
    found = []
    for first, last in zip([0, *edge.tolist()], [*edge.tolist(), len(group)], strict=True):
        middle = first + int((side[first:last] == 0).sum())
        itself = middle == last
        for i in range(first, middle):
            j = np.arange(i + 1 if itself else middle, last)
            j = j[label[j] != label[i]]
            agree = (sig[j] == sig[i]).sum(axis=1)
            order = np.argsort(-agree, kind="stable")
            j = j[order[: int((agree >= LEAST_AGREE).sum())]]
            j = np.array([k for k in j.tolist() if earlier[i].isdisjoint(earlier[k])], np.int64)
            while len(j):
                now, j = j[:AT_ONCE], j[AT_ONCE:]
                for k in now[similar_to(sets[i], [sets[k] for k in now])].tolist():
                    if label[k] != label[i]:
                        found.append((max(node[i], node[k]), min(node[i], node[k])))
                        label[label == label[k]] = label[i]
                j = j[label[j] != label[i]]
    return pd.DataFrame(found, columns=["a", "b"])


def _cross_links(members: DataFrame, known: DataFrame, nodes: DataFrame, texts_of) -> DataFrame:
    """Links (a, b) that join the components of every bucket where members of different ones are similar.

    Members of a bucket's largest component are not compared with one another.  The others are
    compared with one another and with that component; both sides are cut into blocks, and a
    task holds two blocks at a time."""
    placed = members.join(known, "node", "left").select(
        "key", "node", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    placed = written(placed, "near-placed")
    per_bucket = (
        placed.groupBy("key", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("k"))
        .filter("k > 1")
    )
    rows = written(
        placed.join(per_bucket.select("key", "main"), "key").select(
            "key", "node", "n_shingles", "component", (F.col("component") == F.col("main")).alias("is_main")
        ),
        "near-open",
    )
    # A node has at most BANDS keys.
    keys = written(rows.groupBy("node").agg(F.collect_list("key").alias("keys")), "near-keys")
    sets = keys.join(_sets(texts_of(keys.select("node"))), "node").join(nodes.select("node", "signature"), "node")

    sides = F.when(F.col("is_main"), F.array(F.struct(F.lit(1).alias("kind"), F.lit(1).alias("side")))).otherwise(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("side")) for k, s in ((0, 0), (0, 1), (1, 0))])
    )
    rows = rows.select("key", "node", "n_shingles", "component", F.inline(sides))

    def blocks(side: int):
        mine = F.col("side") == side
        count, size = F.count(F.when(mine, 1)), F.coalesce(F.sum(F.when(mine, F.col("n_shingles") * 8)), F.lit(0))
        return F.greatest(F.ceil(count / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int").alias(f"blocks{side}")

    sizes = rows.groupBy("key", "kind").agg(blocks(0), blocks(1))
    rows = rows.join(sizes.filter("blocks0 > 0 and blocks1 > 0"), ["key", "kind"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("blocks0")).otherwise(F.col("blocks1")))
    other = F.when(F.col("side") == 0, F.col("blocks1")).otherwise(F.col("blocks0"))
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    rows = rows.withColumn("p", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).withColumn(
        "q", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    )
    # Of two equal sides one order of the blocks is enough, and a block against itself is sent once.
    rows = rows.filter("kind = 1 or p < q or (p = q and side = 0)")
    # Buckets of one block share a task's group with others, the rest have one for each pair of blocks.
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("n_shingles") * 8), F.lit(0))).first()
    small = (F.col("blocks0") == 1) & (F.col("blocks1") == 1)
    groups = max(n // GROUP, size // GROUP_BYTES) + 1
    together = F.when(small, F.pmod(F.col("key"), F.lit(groups))).otherwise(F.col("key"))
    rows = rows.withColumn("together", together).withColumn("small", small)
    for c in ("kind", "p", "q"):
        rows = rows.withColumn(f"of_{c}", F.when(F.col("small"), 0).otherwise(F.col(c)))
    columns = ["key", "kind", "p", "q", "side", "node", "component"]
    task = ["small", "together", "of_kind", "of_p", "of_q"]
    rows = rows.select(*task, *columns).join(sets, "node")
    # A fixed number of partitions: few bytes can be much work, so they are not put together by bytes.
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(least, size // PARTITION_BYTES + 1), *task)
    links = rows.groupBy(*task).applyInPandas(_links_within, "a binary, b binary")
    return written(links.distinct(), "near-cross")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, content, node, class_id (least id of the class), kept."""
    signed = written(_signed(docs, doc_id, text), "near-signed")
    firsts = written(
        signed.groupBy("node").agg(
            F.min(F.struct("doc_id", "content")).alias("first"),
            F.min("signature").alias("signature"),
            F.min("n_shingles").alias("n_shingles"),
        ),
        "near-nodes",
    )
    key = [F.xxhash64(F.lit(b), F.substring("signature", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)]
    bands = firsts.select("node", "n_shingles", F.explode(F.array(*key)).alias("key"))
    # Buckets with equal members (as many, with equal sums of two hashes) are one bucket.
    sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(20,0)")).alias(f"sum{k}") for k in (1, 2)]
    filled = bands.groupBy("key").agg(F.count("*").alias("n"), *sums).filter("n > 1")
    shared = written(filled.groupBy("n", "sum1", "sum2").agg(F.min("key").alias("key")).select("key"), "near-buckets")
    bits = written(bit_map(shared.select(F.col("key").alias("h"))), "near-bucket-bits")
    likely = with_bit(bands, F.col("key"), bits, "likely").filter("likely").select("key", "node", "n_shingles")
    members = written(likely.join(shared, "key"), "near-members")

    def texts_of(nodes: DataFrame) -> DataFrame:
        return _texts_of(nodes, firsts, docs, doc_id, text)

    links = _verified(_leader_pairs(members, firsts.select("node", "signature")), texts_of)
    known = written(components(links), "near-known")
    more = _cross_links(members, known, firsts, texts_of)
    if not more.isEmpty():
        known = components(links.unionByName(more))
    rows = signed.select("doc_id", "content", "node").distinct().join(known, "node", "left")
    rows = written(rows.withColumn("component", F.coalesce("component", "node")), "near-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "content")).alias("best")
    # Written, so that the join below is between two plain shuffles and a large class can be split.
    chosen = written(rows.groupBy("component").agg(best, F.count("*").alias("class_size")), "near-chosen")
    return rows.join(chosen, "component").select(
        "doc_id",
        F.col("best.doc_id").alias("class_id"),
        "class_size",
        F.expr("doc_id <=> best.doc_id and content = best.content").alias("kept"),
        "content",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of ``docs``: the one with the least id.

    Most rows are told apart from dropped and repeated ones by a bit map and never move; only
    rows whose bit is set are joined."""
    plain, short = numbered_columns(docs)
    i, t = short["doc_id"], short["text"]
    classes = written(near_classes(plain, i, t), "near-classes")
    content = F.xxhash64(F.coalesce(F.col(t), F.lit("")))
    row_hash = F.xxhash64(F.col(i), content)
    repeated = plain.select(row_hash.alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    gone = classes.filter("not kept").select(F.xxhash64("doc_id", "content").alias("h"))
    bits = written(bit_map(gone.unionByName(repeated)), "near-gone")
    marked = with_bit(plain, row_hash, bits, "unsure")
    sure = marked.filter("not unsure").drop("unsure")
    kept = classes.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("content").alias("k_content"))
    unsure = marked.filter("unsure").drop("unsure").withColumn("u_content", content)
    unsure = unsure.join(kept, (F.col("u_content") == F.col("k_content")) & F.col(i).eqNullSafe(F.col("k_id")))
    unsure = unsure.dropDuplicates([i, "u_content"]).select(*plain.columns)
    return named_again(sure.unionByName(unsure), short)


def op10_prob_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(docs).select("doc_id", "class_id", "class_size", "kept")
