"""Upserts into bucket folders against upserts of whole tables."""

import pytest
from pyspark.sql import functions as F

from tenderloom.operators.keyed_store import BUCKET, KeyedStore
from tenderloom.operators.tables import upsert


@pytest.fixture()
def store(spark, tmp_path):
    rows = spark.range(0, 500).select(F.when(F.col("id") > 0, F.col("id")).alias("code"), F.concat(F.lit("n"), "id").alias("name"))
    made = KeyedStore(str(tmp_path / "store"), "code", 16)
    made.create(rows)
    return made


def files(store):
    from pathlib import Path

    return {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in Path(store.path).rglob("*.parquet")}


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_only_buckets_with_a_changed_key_are_replaced(spark, store):
    old = store.read(spark).checkpoint()
    new = spark.createDataFrame([(7, "x", 1), (7, "y", 2), (9, "z", 1), (1000, "w", 1), (None, "no key", 3)], "code int, name string, at int")
    before = files(store)
    store.upsert(new, "at")
    after = files(store)
    typed = new.withColumn("code", F.col("code").cast("long"))
    # Null is not equal to null in the join of two tables, but one key of the store.
    want = upsert(old.filter("code is not null"), typed.filter("code is not null"), "code", "at")
    assert same(store.read(spark).filter("code is not null"), want)
    touched = {f"{BUCKET}={r[0]}" for r in typed.select(store.bucket()).distinct().collect()}
    assert {k for k in before if before[k] != after[k]} == touched & set(before) and len(touched) < 6
    assert all(len(v) == 1 for v in after.values())


def test_reads_are_pruned_by_bucket(spark, store):
    keys = spark.createDataFrame([(3,), (4,), (3,), (77777,)], "code int")
    assert same(store.look_up(keys).select("code", "name"), spark.createDataFrame([(3, "n3"), (4, "n4")], "code long, name string"))
    read = store.touched(keys)
    assert read.select(F.input_file_name()).distinct().count() <= 3
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert BUCKET in plan[plan.index("PartitionFilters: [") :].split("]")[0]


def test_a_null_key_is_replaced_too(spark, store):
    store.upsert(spark.createDataFrame([(None, "new")], "code long, name string"))
    assert [r.name for r in store.read(spark).filter("code is null").collect()] == ["new"]


def test_nothing_new_and_other_columns(spark, store):
    before = files(store)
    store.upsert(spark.createDataFrame([], "code long, name string"))
    assert files(store) == before
    store.upsert(spark.createDataFrame([(1, "extra")], "code long, other string"))
    assert [tuple(r) for r in store.read(spark).filter("code = 1").collect()] == [(1, None)]


def test_a_cut_off_replacement_is_finished_from_the_written_copy(spark, store, monkeypatch):
    """The merged buckets are written before the store is touched."""
    copies = []

    def fail(self, merged):
        copies.append(merged)
        raise OSError("cut off")

    before = store.read(spark).checkpoint()
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "replace", fail)
        with pytest.raises(OSError, match="cut off"):
            store.upsert(spark.createDataFrame([(5, "five")], "code long, name string"))
    assert same(store.read(spark), before)
    store.replace(copies[0])
    store.replace(copies[0])  # again, as after a second failure
    assert same(store.read(spark), upsert(before, spark.createDataFrame([(5, "five")], "code long, name string"), "code").unionByName(before.filter("code is null")).distinct())
