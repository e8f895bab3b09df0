"""Streams give what batches give, also after a replay."""

import pytest
from pyspark.sql import functions as F

from tenderloom.operators.cube import calendar_cube
from tenderloom.plans import reports as R
from tenderloom.sources import sinks
from tenderloom.streaming import incremental as Z


@pytest.fixture()
def notices_path(spark, tmp_path):
    path = str(tmp_path / "notices")
    spark.range(0, 600, 1, 6).select(
        F.col("id").cast("string").alias("article_id"),
        (F.lit(1680000000000) + F.col("id") * 3600000 * 7).alias("scrape_timestamp"),
        (F.lit(450100) + F.col("id") % 3).cast("int").alias("district_code"),
        (F.col("id") * 1.25).alias("total_amount"),
    ).write.parquet(path)
    return path


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fold_equals_batch_and_survives_a_replay(spark, notices_path, tmp_path):
    cells, log = str(tmp_path / "cells"), str(tmp_path / "log")
    stream = Z.parquet_stream(spark, notices_path, files_per_trigger=2)
    Z.fold_stream(stream, cells, log, [], R.volume_measures).awaitTermination()
    whole = calendar_cube(spark.read.parquet(notices_path), [], R.volume_measures())
    assert same(Z.cube_of_cells(spark, cells, [], R.volume_measures), whole)
    assert (tmp_path / "cells" / "batch=1").is_dir()

    uncommit(tmp_path / "log", max(int(p.name) for p in (tmp_path / "log" / "commits").iterdir() if p.name.isdigit()))
    Z.fold_stream(stream, cells, log, [], R.volume_measures).awaitTermination()
    assert same(Z.cube_of_cells(spark, cells, [], R.volume_measures), whole)

    Z.compact_cells(spark, cells, str(tmp_path / "compact"), [], R.volume_measures)
    assert same(Z.cube_of_cells(spark, str(tmp_path / "compact"), [], R.volume_measures), whole)


def uncommit(folder, batch):
    """As after a failure between writing a batch and committing it."""
    (folder / "commits" / str(batch)).unlink()
    (folder / "commits" / f".{batch}.crc").unlink(missing_ok=True)


def test_repeats_are_dropped_for_ever(spark, tmp_path):
    """Ids far behind in time and repeats in later batches; restarts and a replayed batch change nothing."""
    source, rows, log = (str(tmp_path / x) for x in ("in", "rows", "log"))
    batches = [[(1, 500), (2, 10), (2, 10)], [(3, 1), (1, 900), (None, 7)], [(2, 2000), (4, 0), (3, 1), (None, 8)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "id long, time long").coalesce(1).write.mode("append").parquet(source)
        Z.fold_unique(Z.parquet_stream(spark, source), rows, log, "id").awaitTermination()  # a new query from the checkpoint
        assert len(spark.read.parquet(rows).select("batch").distinct().collect()) == n + 1
    want = [(1, 500), (2, 10), (3, 1), (4, 0), (None, 7)]
    assert sorted(((r.id, r.time) for r in spark.read.parquet(rows).collect()), key=str) == want

    uncommit(tmp_path / "log", 2)
    Z.fold_unique(Z.parquet_stream(spark, source), rows, log, "id").awaitTermination()
    assert sorted(((r.id, r.time) for r in spark.read.parquet(rows).collect()), key=str) == want


def test_a_batch_costs_its_own_keys(spark, tmp_path):
    """After many stored keys a small batch reads its rows, changes as many keys and writes one file."""
    source, rows, log = (str(tmp_path / x) for x in ("in", "rows", "log"))
    spark.range(20_000).write.parquet(source)
    Z.fold_unique(Z.parquet_stream(spark, source), rows, log, "id").awaitTermination()
    spark.range(19_990, 20_010).coalesce(1).write.mode("append").parquet(source)
    query = Z.fold_unique(Z.parquet_stream(spark, source), rows, log, "id", files=1)
    query.awaitTermination()
    last = query.lastProgress
    state = last["stateOperators"][0]
    assert (last["numInputRows"], state["numRowsUpdated"], state["numRowsTotal"]) == (20, 10, 20_010)
    assert state["customMetrics"]["rocksdbGetCount"] <= 2 * 20  # a look-up and a change of each
    assert len(list((tmp_path / "rows" / "batch=1").glob("*.parquet"))) == 1
    assert spark.read.parquet(rows).distinct().count() == 20_010


def test_complete_mode_counts_and_latest(spark, notices_path, tmp_path):
    stream = Z.parquet_stream(spark, notices_path)
    for name, df in (("counts", Z.running_counts(stream, "district_code")), ("latest", Z.latest_seen(stream))):
        (
            df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        )
    assert {r["count"] for r in spark.table("counts").collect()} == {200}
    assert spark.table("latest").first().latest_timestamp == 1680000000000 + 599 * 3600000 * 7


def test_consoles_reject_the_other_kind(spark, notices_path, capfd):
    batch, stream = spark.read.parquet(notices_path), Z.parquet_stream(spark, notices_path)
    with pytest.raises(ValueError):
        sinks.show(stream)
    with pytest.raises(ValueError):
        sinks.show_stream(batch)
    sinks.show(batch.limit(1))
    query = sinks.show_stream(Z.running_counts(stream, "district_code"))
    query.processAllAvailable()
    query.stop()
    assert "district_code" in capfd.readouterr().out


def test_late_rows_have_a_table_and_days_close_once(spark, tmp_path):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    batches = [
        [("2024-01-10 10:00", 1), ("2024-01-01 00:00", 1), (None, 2)],  # nothing is late in the first batch
        [("2024-01-07 23:59", 1), ("2024-01-08 09:59", 1), ("2024-01-11 00:00", 2)],  # mark 01-08 10:00
        [("2024-02-01 00:00", 1), ("2024-01-08 12:00", 1), ("2024-01-09 00:00", 1)],  # mark 01-09 00:00
        [],
        [("2024-01-31 00:00", 1), ("2024-01-29 12:00", None)],  # mark 01-30 00:00
    ]
    for batch in batches:
        rows = spark.createDataFrame(batch, "at string, place int").select(F.col("at").cast("timestamp").alias("ts"), "place")
        rows.coalesce(1).write.mode("append").parquet(source)
        Z.fold_windows(Z.parquet_stream(spark, source), out, log, "ts", ["place"]).awaitTermination()

    def found():
        closed, open_, late = Z.read_windows(spark, out)
        counts = [sorted((f"{r.day:%m-%d}", r.place, r["count"]) for r in df.collect()) for df in (closed, open_)]
        return *counts, sorted((f"{r.ts:%m-%d %H}" if r.ts else "", r.place) for r in late.collect())

    first = found()
    assert first == (
        [("01-01", 1, 1), ("01-08", 1, 1), ("01-09", 1, 1), ("01-10", 1, 1), ("01-11", 2, 1)],
        [("01-31", 1, 1), ("02-01", 1, 1)],
        [("", 2), ("01-07 23", 1), ("01-08 12", 1), ("01-29 12", None)],
    )
    uncommit(tmp_path / "log", max(int(p.name) for p in (tmp_path / "log" / "commits").iterdir() if p.name.isdigit()))
    Z.fold_windows(Z.parquet_stream(spark, source), out, log, "ts", ["place"]).awaitTermination()
    assert found() == first
