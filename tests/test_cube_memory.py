"""Partitions of the roll-up by key: one task holds no more groups than a part of one set has."""

import datetime

from tenderloom.operators.cube import SCOPES, TASKS_PER_CORE, calendar_cube, count_rows
from tenderloom.session import SIZE_CONF, use_engine_settings
from tenderloom.sources import fixtures as X


def test_partitions_follow_the_sets(spark):
    rows = [(i * 86400000 * 40, str(450100 + i % 3), f"S{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "scrape_timestamp long, district_code string, supplier string")
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    for grains, scopes, sets in ((("day", "month", "quarter", "year"), SCOPES, 8), (("year",), ("province",), 1)):
        cube = calendar_cube(df, ["supplier"], [count_rows("count")], grains, scopes)
        assert cube.rdd.getNumPartitions() == least * sets
        assert cube.groupBy().sum("count").first()[0] == 60 * sets


def test_tasks_are_sized_unless_the_session_says_so(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    fresh = spark.newSession()
    use_engine_settings(fresh)
    assert fresh.conf.get(key) == SIZE_CONF[key]
    own = spark.newSession()
    own.conf.set(key, "8m")
    use_engine_settings(own)
    assert own.conf.get(key) == "8m"


def test_lots_and_notices_are_dealt_alike(spark, tmp_path):
    tables = {
        "nation": ([(0, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C", 0, "M")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(1, "S")], "s_suppkey long, s_name string"),
        "part": ([(1, "P")], "p_partkey long, p_name string"),
        "orders": (
            [(i, 1, "F", 5.0, datetime.date(1996, 1, 2), "1") for i in (1, 2, 2)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string",
        ),
        "lineitem": (
            [(k, 1, 1, n, 3.0, 7.0, 0.1, "N", "O") for k in (1, 2, 3, None) for n in (1, 2)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    lots = X.notice_lots(spark, str(tmp_path))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), X.PARTS_PER_CORE * spark.sparkContext.defaultParallelism)
    assert lots.rdd.getNumPartitions() == least
    assert sorted((r["id"], r["index"]) for r in lots.collect()) == [(1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
