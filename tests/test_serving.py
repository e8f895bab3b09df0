"""Serving queries, districts, tables, sinks and helpers."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import calendar, labels
from tenderloom.operators import frames, ranking, tables
from tenderloom.plans import districts as D
from tenderloom.plans import serving as S
from tenderloom.schemas import DISTRICT_SCHEMA, NOTICE_SCHEMA
from tenderloom.sources import kafka, notices, sinks

PLACES = [
    (450000, "省", "省", "省", -1, 1),
    (459900, "省本级", "省本级", "省", 450000, 1),
    (450100, "甲市", "甲市", "甲", 450000, 2),
    (450199, "甲市本级", "甲市本级", "甲", 450100, 2),
    (450102, "东区", "东区", "东", 450100, 3),
    (450200, "乙市", "乙市", "乙", 450000, 2),
]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, DISTRICT_SCHEMA)


@pytest.fixture(scope="module")
def volume(spark):
    rows = []
    for code, year, month, amount in [
        (450100, 2023, 1, 1.0),
        (450199, 2023, 1, 2.0),
        (450102, 2023, 3, 4.0),
        (450200, 2024, 2, 8.0),
        (459900, 2024, 2, 16.0),
        (450777, 2024, 2, 32.0),
    ]:
        rows += [(code, year, month, 0, 0, amount), (code, year, 0, 0, 0, amount)]
    return spark.createDataFrame(rows, "district_code int, year int, month int, day int, quarter int, transactions_volume double")


def ms(*day):
    return int(datetime(*day, tzinfo=timezone.utc).timestamp() * 1000)


def test_city_volumes_fold_districts_and_offices(volume, places):
    got = {(r.year, r.district_code): (r.district_name, r.volume) for r in S.city_volume_by_year(volume, places).collect()}
    assert got == {
        (2023, 450100): ("甲市", 7.0),
        (2024, 450200): ("乙市", 8.0),
        (10000, 450100): ("甲市", 7.0),
        (10000, 450200): ("乙市", 8.0),
    }
    assert {r.district_code for r in D.unknown_codes(volume, places).collect()} == {450777}


def test_child_volumes_cut_the_office_suffix(volume, places):
    got = {(r.year, r.district_name): r.volume for r in S.child_volume_by_year(volume, places, 450100).collect()}
    assert got[(2023, "甲市")] in (1.0, 2.0) and got[(10000, "东区")] == 4.0


def test_growth_is_stamped_with_its_own_month(volume, places):
    got = [(r.district_code, r.timestamp, r.value) for r in S.city_growth(volume, places).orderBy("district_code", "timestamp").collect()]
    assert got == [(450100, ms(2023, 1, 1), 3.0), (450100, ms(2023, 3, 1), 7.0), (450200, ms(2024, 2, 1), 8.0)]


def test_method_total_does_not_change_the_first_year(spark):
    rows = [(0, "公开", 2022, 0, 0, 0, 1, 1.5), (0, "公开", 2023, 0, 0, 0, 2, 2.5), (0, None, 2023, 0, 0, 0, 0, 4.0)]
    df = spark.createDataFrame(rows, "district_code int, procurement_method string, year int, month int, day int, quarter int, count long, total_amount double")
    got = {(r.year, r.name): (r["count"], r.amount) for r in S.method_by_year(df).collect()}
    assert got == {
        (2022, "公开"): (1, 1.5),
        (2023, "公开"): (2, 2.5),
        (2023, labels.OTHER_METHOD): (0, 4.0),
        (10000, "公开"): (3, 4.0),
        (10000, labels.OTHER_METHOD): (0, 4.0),
    }


@pytest.mark.parametrize(
    "period,first,last",
    [
        ({"year": 2024, "month": 2, "day": 29}, (2024, 2, 29), (2024, 3, 1)),
        ({"year": 2023, "month": 12}, (2023, 12, 1), (2024, 1, 1)),
        ({"year": 2023, "quarter": 1}, (2023, 1, 1), (2023, 4, 1)),
        ({"year": 2023, "quarter": 4}, (2023, 10, 1), (2024, 1, 1)),
        ({"year": 2023}, (2023, 1, 1), (2024, 1, 1)),
    ],
)
def test_periods_are_half_open(spark, period, first, last):
    begin, end = calendar.period_range(**period)
    row = spark.range(1).select(begin.alias("b"), end.alias("e")).first()
    assert (row.b, row.e) == (ms(*first), ms(*last))


def test_no_year_means_every_row(spark):
    rows = [(1, ms(1999, 5, 1), 1), (2, ms(2022, 1, 1), 1), (3, ms(2026, 1, 1), 2), (4, None, 1)]
    notices = spark.createDataFrame(rows, "id long, scrape_timestamp long, district_code int")
    assert S.notices_total(notices).first().total == 3
    assert S.notices_total(notices, district=1).first().total == 2
    with pytest.raises(ValueError):
        calendar.period_range(0, month=3)


def test_period_prunes_folders_of_the_stored_table(spark, tmp_path):
    path = str(tmp_path / "stored")
    days = spark.range(400).select("id", (F.lit(ms(2022, 1, 1)) + F.col("id") * 86400000).alias("scrape_timestamp"), F.lit(1).alias("district_code"))
    sinks.save_notices(days, path)
    stored = spark.read.parquet(path)
    for period, n, mark in (({"year": 2022, "month": 2}, 28, "month"), ({"year": 2022, "quarter": 2}, 91, "month"), ({"year": 2023}, 35, "year")):
        rows = S.notices_total(stored, **period)
        assert rows.first().total == n
        plan = rows._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
        assert mark in filters
    files = [f for f in (tmp_path / "stored").rglob("part-*.parquet")]
    assert len(files) == 14  # one for each month


def test_deep_pages_read_the_folders_they_lie_in(spark, tmp_path):
    path = str(tmp_path / "stored")
    # 66,000 notices over 40 months, a third of them in one; equal times within a folder and null times.
    k = F.col("id")
    rows = spark.range(66_000).select(
        F.pmod(k * 7919, F.lit(66_000)).alias("id"),
        F.when(k % 1000 != 999, F.lit(ms(2021, 3, 1)) + F.when(k % 3 == 0, k % 20).otherwise(k % 1200) * 86400000).alias("scrape_timestamp"),
        (F.lit(450100) + k % 4).cast("int").alias("district_code"),
    )
    sinks.save_notices(rows, path)
    stored = spark.read.parquet(path)
    counts = S.folder_counts(stored).checkpoint()

    def folders(df):
        files = df.select(F.input_file_name().alias("f")).distinct().collect()
        return {f.f.rsplit("/", 1)[0] for f in files}

    for page_no, size, district in ((1, 20, 0), (3000, 20, 0), (700, 50, 0), (1319, 50, 0), (3000, 50, 0), (900, 10, 450103), (2, 10, 9)):
        got = S.indexed_page(stored, counts, page_no, size, district)
        want = S.notices_page(stored, page_no, size, district)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
        assert len(folders(got)) <= 2
        if got.count():
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "month" in plan[plan.index("PartitionFilters: [") :].split("]")[0]
            last = got.orderBy(F.desc("scrape_timestamp"), F.desc("id")).first()
            after = S.indexed_page_after(stored, counts, (last.scrape_timestamp, last.id), size, district)
            if page_no < 3000:
                assert [tuple(r) for r in after.collect()] == [tuple(r) for r in S.notices_page(stored, page_no + 1, size, district).collect()]
            assert len(folders(after)) <= 2


def test_period_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "n")
    df = spark.range(100).select(F.col("id"), (F.lit(ms(2023, 1, 1)) + F.col("id") * 86400000).alias("scrape_timestamp"), F.lit(1).alias("district_code"))
    df.write.parquet(path)
    page = S.notices_page(spark.read.parquet(path), 1, 10, year=2023, month=2)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(scrape_timestamp" in plan and "TakeOrderedAndProject" in plan
    assert [r.id for r in page.collect()] == list(range(31, 41))
    assert S.notices_total(spark.read.parquet(path), year=2023, month=2).first().total == 28


def test_page_bounds():
    for no, size in ((0, 10), (3001, 10), (1, 9), (1, 51)):
        with pytest.raises(ValueError):
            ranking.check_page(no, size)


def test_tree_and_look_ups(places):
    tree = {r.code: (r.level, r.path) for r in D.district_tree(places, 450100).collect()}
    assert tree == {450100: (0, "450100"), 450199: (1, "450100/450199"), 450102: (1, "450100/450102")}
    assert D.district_tree(places, 1).count() == 0
    assert [r.code for r in D.districts_by_type(places, 2).collect()] == [450100, 450199, 450200]
    assert {r.code for r in D.cities(places).collect()} == {450000, 459900, 450100, 450200}
    with pytest.raises(ValueError):
        D.districts_by_type(places, 4)


def test_district_documents(spark):
    doc = (
        '{"code":"450000","name":"省","fullName":"省","shortName":"省","isLeaf":false,"children":['
        '{"code":"450100","name":"甲","fullName":"甲","shortName":"甲","isLeaf":false,"children":[{"code":"450199","name":"乙","isLeaf":false,'
        '"children":[{"code":"450198","name":"丙","isLeaf":true}]}]},'
        '{"code":"459900","name":"级","isLeaf":true,"children":null}]}'
    )
    docs = spark.createDataFrame([(doc,)], "doc string")
    got = {r.code: (r.parent_code, r.type) for r in D.flatten_district_json(docs).collect()}
    assert got == {450000: (-1, 1), 450100: (450000, 2), 450199: (450100, 2), 450198: (450199, 3), 459900: (450000, 1)}


def test_month_scaffold_stays_in_range(spark):
    bounds = spark.sql("select date'2023-11-15' as begin_date, date'2024-02-01' as end_date")
    rows = [(r.year, r.month, r.days, r.end_day) for r in calendar.month_scaffold(bounds).collect()]
    assert rows == [(2023, 11, 30, "2023-11-30"), (2023, 12, 31, "2023-12-31"), (2024, 1, 31, "2024-01-31"), (2024, 2, 29, "2024-02-29")]


def test_dense_ids(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id").alias("k"), (F.col("id") % 13).alias("g"))
    rows = tables.with_dense_id(df, ["g", "k"]).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1000))
    assert [(r.g, r.k) for r in rows] == sorted((k % 13, k) for k in range(1000))


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "code int, name string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "code int, name string, stamp int")
    assert {tuple(r) for r in tables.upsert(old, new, "code", "stamp").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert {tuple(r) for r in tables.changed_keys(old, new, "code").collect()} == {(2, "updated"), (3, "inserted")}
    assert [r.code for r in tables.without_keys(old, new, "code").collect()] == [1]


def test_frame_helpers(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    b = spark.createDataFrame([(1, 7)], "k int, w int")
    assert frames.replace_null(a, ["v"], 0).filter("v = 0").count() == 1
    assert frames.filter_and_count(a, F.col("v") > 1, ["k"], "n").first().n == 1
    assert frames.filter_and_count(a, None, ["k"]).count() == 2
    assert {tuple(r) for r in frames.join_frames([a, b], ["k"]).collect()} == {(1, None, 7), (2, 5, None)}
    assert frames.union_frames([a, b], allow_missing=True).columns == ["k", "v", "w"]
    assert frames.union_frames([a, b], by_name=False).count() == 3
    assert frames.union_frames([a, a], lambda d: d.filter("k = 1")).count() == 2
    assert frames.append_columns(a, {"z": F.lit(1)}).columns == ["k", "v", "z"]
    assert frames.literal_frame(spark, [{"x": 1}], "x int").first().x == 1
    for bad in (lambda: frames.join_frames([], ["k"]), lambda: frames.join_frames([a, b], [1]), lambda: frames.union_frames([])):
        with pytest.raises(ValueError):
            bad()


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    top = ranking.top_per_group(df, ["g"], [F.desc("v")], 2)
    assert top.count() == 6
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_json_values(spark):
    good = '{"title":"t","scrape_timestamp":5,"district_code":"x1","is_win_bid":true,"bid_items":[{"index":2,"amount":1.5}],"review_expert":["a"]}'
    df = spark.createDataFrame([(good.encode(),), (b'{"title":',), (b"",), (None,)], "value binary")
    row = notices.with_int_district(notices.parse_notices(df)).collect()
    assert len(row) == 1 and row[0].district_code is None and row[0].bid_items[0].amount == 1.5
    assert notices.corrupt_notices(df).count() == 2


def test_row_format_and_back(spark, tmp_path):
    df = spark.createDataFrame([(True, None, ["a"], None, None)], "is_win_bid boolean, is_termination boolean, review_expert array<string>, purchaser string, total_budget double")
    rows = notices.to_row_format(df)
    assert tuple(rows.first()) == (1, 0, '["a"]', None, None)
    path = str(tmp_path / "t")
    sinks.save_table(rows, path)
    back = sinks.read_table(spark, path).first()
    assert tuple(back) == (True, False, '["a"]', "", -1.0)
    stored = spark.createDataFrame([('[{"index":1}]', '["a"]', "[]")], "bid_items string, review_expert string, purchase_representative string")
    lists = notices.decode_json_columns(stored).first()
    assert lists.bid_items[0]["index"] == 1 and lists.review_expert == ["a"] and lists.purchase_representative == []


def test_notice_table_is_partitioned_by_month(spark, tmp_path):
    df = spark.createDataFrame([tuple(ms(2023, 5, 6) if f.name == "scrape_timestamp" else None for f in NOTICE_SCHEMA)], NOTICE_SCHEMA)
    sinks.save_notices(df, str(tmp_path / "p"))
    assert (tmp_path / "p" / "year=2023" / "month=5").is_dir()
    sinks.save_json_by_month(df, str(tmp_path / "j"))
    assert (tmp_path / "j" / "year=2023" / "month=5").is_dir()


def test_connector_options(spark):
    options = kafka.kafka_options("h:1", ["a", "b"])
    assert options["subscribe"] == "a,b" and options["failOnDataLoss"] == "false" and "endingOffsets" not in options
    jdbc = sinks.jdbc_options("jdbc:x", "t", user="u")
    assert (jdbc["truncate"], jdbc["batchsize"], jdbc["user"]) == ("true", "10000", "u")
    numbered = sinks.numbered_rows(spark.createDataFrame([("b", True), ("a", None)], "k string, f boolean"), ["k"])
    assert sorted((r.id, r.k, r.f) for r in numbered.collect()) == [(0, "a", 0), (1, "b", 1)]
    assert kafka.as_values(spark.createDataFrame([(1,)], "x int")).first().value == '{"x":1}'


def test_axis_labels(spark):
    df = spark.createDataFrame([(3, 9, 0), (3, 0, 0), (0, 0, 2), (0, 0, 0)], "month int, day int, quarter int")
    shown = [r[0] for r in df.select(labels.axis_label(F.col("month"), F.col("day"), F.col("quarter"))).collect()]
    assert shown == ["03月09日", "3月", "第2季度", None]


def test_supplier_detail_reads_the_lots_once(spark):
    cols = "supplier string, supplier_address string, catalog string, scrape_timestamp long, is_win_bid boolean, is_win boolean, amount double, is_percent boolean, total_budget double"
    rows = [
        ("S1", "A", "goods", ms(2023, 1, 1), True, True, 10.0, False, 5.0), ("S1", "B", "goods", ms(2023, 5, 1), True, True, 50.0, True, 200.0),
        ("S1", "B", None, ms(2024, 1, 1), True, False, 7.0, False, 5.0), ("S1", None, "work", None, True, True, 1.0, False, 5.0),
        ("S1", "A", "work", ms(2025, 1, 1), True, True, -1.0, False, 5.0), ("S2", "C", "work", ms(2025, 1, 1), True, True, 3.0, False, 5.0),
        ("S", "C", "work", ms(2025, 1, 1), True, True, 3.0, False, 5.0),
    ]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lots = spark.createDataFrame(rows, cols)
    counted = lots.mapInArrow(count, lots.schema)
    got = {(r.section, r.label): (r.volume, r["count"]) for r in S.supplier_detail(counted, "S1").collect()}
    assert got == {
        ("address", "A"): (None, None), ("catalog", "goods"): (None, 2), ("catalog", "work"): (None, 2), ("catalog", None): (None, 1),
        ("year", "2023"): (110.0, 2), ("year", None): (1.0, 1),
    }
    assert read.value == len(rows)
    assert {r.section for r in S.supplier_detail(lots, "S").collect()} == {"catalog", "year"}
    assert S.supplier_detail(lots, "nobody").count() == 0
