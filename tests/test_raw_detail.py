"""The page texts of the raw detail rows are put together behind the join with the notices."""

import datetime

from tenderloom.sources import announcements


def test_no_page_text_is_moved_by_the_join(spark, tmp_path):
    tables = {
        "nation": ([(0, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C", 0, "M")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": (
            [(k, c, "F", 5.0, datetime.date(1996, 1, 2), "1") for k, c in ((1, 1), (2, 1), (2, 1), (7, 1), (3, 9), (None, 1))],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    detail = announcements.raw_detail(spark, str(tmp_path))
    detail.createOrReplaceTempView("raw_detail_of_test")
    text = spark.sql("EXPLAIN EXTENDED SELECT * FROM raw_detail_of_test").first()[0]
    plan = text.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.rindex("中标结果") < plan.index("Join")
    pages = detail.filter("title = '结果公告'").collect()
    # An order without a customer is no notice; orders that come twice meet each notice of their key.
    assert sorted(r.articleId for r in pages) == ["R1", *["R2"] * 4, "R7"]
    assert {r.articleId: len(r.announcementLinkDtoList) for r in pages} == {"R1": 4, "R2": 4, "R7": 0}
    linked = announcements.linked_notices(spark, str(tmp_path)).filter("article_id = 'R1'").first().links
    assert next(r for r in pages if r.articleId == "R1").announcementLinkDtoList == linked
