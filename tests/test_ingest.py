"""The ingestion job from raw tables to notices and quarantine."""

import json
import time

from pyspark import TaskContext
from pyspark.sql import functions as F

from tenderloom.plans import ingest as I
from tenderloom.plans import lots as L
from tenderloom.schemas import FIRST_USABLE_MS, LOT_SCHEMA, NOTICE_SCHEMA, RAW_DETAIL_SCHEMA, RAW_LIST_SCHEMA

T0 = 1700000000000
DAY = 86400000


def win_page(price="报价:40(元)", second="0"):
    return (
        "<p>一、项目编号：P-1</p><p>二、项目名称：路</p><p>三、中标（成交）信息</p><p>1.中标结果：</p>"
        f"<td>1</td><td>{price}</td><td>甲公司</td><td>路1号</td>"
        f"<td>1</td><td>报价:{second}(%)</td><td>乙公司</td><td>街2号</td>"
        "<p>2.废标结果:</p><td>2</td><td>标乙</td><td>不足三家</td><td>/</td>"
        "<p>五、评审专家名单：</p><p>张一（采购人代表）、李二</p>"
        "<p>八、联系方式</p><p>1.采购人信息名称：某局地址：a</p><p>2.采购代理机构信息名称：某代理地址：b</p>"
    )


def purchase_page(first=60, second=40, total=None):
    head = f"预算总金额（元）：{total} " if total is not None else ""
    return (
        f"<p>项目编号：Q-9 项目名称：路灯 采购方式：公开 {head}采购需求：</p>"
        f"<p>标项一标项名称：标甲 数量：1 预算金额（元）：{first} 数量：</p>"
        f"<p>标项二标项名称：标乙 数量：1 预算金额（元）：{second} 数量：</p>"
    )


VOID_PAGE = "<p>一、项目编号：P-2</p><p>二、项目废标的原因</p><p>供应商不足三家</p>"
END_PAGE = "<p>一、项目编号：P-3</p><p>三、终止说明</p><p>政策变化</p>"


def listed(article, path, title="公告", district="450100"):
    return (title, T0, path, article, "作者", district, "南宁市", "货物", "公开招标", T0 - DAY)


def detail(article, content, links=None, title="结果公告", type_=3004, district=None, time=T0):
    return (article, title, "API-1", "接口名", district, type_, time, content, links)


def link(order, article, type_name, time=T0, exists=True):
    return (order, exists, time, type_name, article)


def run(spark, lists, details, **kwargs):
    raw_list = spark.createDataFrame(lists, RAW_LIST_SCHEMA)
    raw_detail = spark.createDataFrame(details, RAW_DETAIL_SCHEMA)
    done = I.ingest(raw_list, raw_detail, **kwargs)
    notices = {r.result_source_article_id: r for r in done.notices.collect()}
    errors = {r.article_id: r.message for r in done.quarantine.collect()}
    return done, notices, errors


def test_job(spark, tmp_path):
    p_links = [link(1, "p1", "采购公告", T0 - 5 * DAY), link(2, "w1", "中标结果公告", T0)]
    lists = [
        listed("w1", "中标公告"),
        listed("w1", "中标公告"),
        listed("v1", "废标公告"),
        listed("t1", "终止公告"),
        listed("u1", "更正公告"),
        listed("d1", "公开招标资格入围公告"),
        listed("s1", "成交公告"),
        listed("n1", "成交公告"),
        listed("k1", "成交公告", title="公开征集公告"),
        listed("sw", "成交公告"),
        listed("bad", "成交公告"),
        listed("nolink", "成交公告", district=None),
        listed("mm", "成交公告"),
    ]
    details = [
        detail("w1", win_page(second="20"), p_links),
        detail("p1", purchase_page(total=100), title="采购公告", type_=1),
        detail("v1", VOID_PAGE, [link(1, "p2", "采购公告"), link(2, "v1", "结果公告")]),
        detail("p2", purchase_page(), type_=1),
        detail("t1", END_PAGE, [link(1, "pold", "采购公告"), link(2, "p1", "采购公告"), link(3, "t1", "结果公告")]),
        detail("pold", purchase_page(1, 1), time=FIRST_USABLE_MS - 1),
        detail("k1", "", title="公开征集公告"),
        detail("sw", "<p>空</p>", [link(1, "sw", "结果公告"), link(2, "gone", "结果公告"), link(3, "sw2", "更正结果公告")]),
        detail("sw2", win_page()),
        detail("bad", "<p>三、中标信息</p><p>见附件</p>"),
        detail("nolink", win_page("看不懂"), district="450102"),
        detail("mm", win_page(), [link(1, "p3", "其他公告"), link(2, "mm", "结果公告")]),
        detail("p3", purchase_page().replace("标项二", "标项三") + purchase_page(), type_=1),
        detail("s1", win_page()),
    ]
    seen = spark.createDataFrame([("s1",)], "article_id string")
    done, notices, errors = run(spark, lists, details, seen=seen)

    assert done.notices.schema.fieldNames() == NOTICE_SCHEMA.fieldNames()
    won = notices["w1"]
    assert [(x["index"], x.is_win, x.name, x.budget, x.amount, x.is_percent) for x in won.bid_items] == [
        (1, True, "标甲", 60.0, 40.0, False),
        (1, True, "标甲", 60.0, 20.0, True),
        (2, False, "标乙", 40.0, -1.0, False),
    ]
    # 40 in money and 20 % of the budget of 100; the first lot's budget counts once.
    assert (won.total_budget, won.total_amount) == (100.0, 60.0)
    assert (won.purchaser, won.purchasing_agency) == ("某局", "某代理")
    assert (won.review_expert, won.purchase_representative) == (["张一", "李二"], ["张一"])
    assert (won.project_code, won.project_name) == ("Q-9", "路灯")
    assert (won.purchase_source_article_id, won.tender_duration) == ("p1", 5 * DAY)

    void = notices["v1"]
    assert [(x["index"], x.name, x.reason) for x in void.bid_items] == [(1, "标甲", "供应商不足三家"), (2, "标乙", "供应商不足三家")]
    assert (void.total_amount, void.total_budget, void.is_termination) == (0.0, 100.0, False)

    ended = notices["t1"]
    assert ended.is_termination and ended.termination_reason == "政策变化"
    # The last purchase notice is taken; the one before 2022 is never.
    assert ended.purchase_source_article_id == "p1" and len(ended.bid_items) == 2

    skipped = notices["k1"]
    assert (skipped.bid_items, skipped.total_budget, skipped.total_amount) == ([], -1.0, -1.0)

    switched = notices["sw2"]
    assert switched.result_article_id == ["sw", "gone", "sw2"] and len(switched.bid_items) == 3

    alone = notices["nolink"]
    # A price that is not understood becomes -1 in its lot and adds nothing; no budget is known.
    assert alone.bid_items[0].amount == -1.0 and alone.district_code == "450102"
    assert (alone.total_budget, alone.total_amount, alone.tender_duration) == (-1.0, 0.0, -1)
    assert alone.result_article_id == ["nolink"] and alone.result_publish_date == [T0]

    assert errors == {
        "u1": "list row: path name not known",
        "n1": "detail: no data",
        "bad": "result lots: layout not known",
        "mm": "record: number of lots differs",
    }
    assert set(notices) == {"w1", "v1", "t1", "k1", "sw2", "nolink"}
    folder = str(tmp_path / "run")
    raw_list, raw_detail = spark.createDataFrame(lists, RAW_LIST_SCHEMA), spark.createDataFrame(details, RAW_DETAIL_SCHEMA)
    counts = I.run(raw_list, raw_detail, folder, seen=seen)
    assert counts == {
        "planned": 13, "actual": 12, "remaining": 1, "dropped": 1, "sent": 10,
        "notices": 6, "quarantined": 4, "stored": 6, "error": 4, "covered": 0, "candidates": 0,
    }
    table = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert {r.article_id for r in table("seen").collect()} >= set(notices)
    assert sorted(table("notices").drop("scrape_timestamp").collect(), key=str) == sorted(done.notices.drop("scrape_timestamp").collect(), key=str)
    assert {r.status: r["count"] for r in table("statuses").groupBy("status").count().collect()} == {"stored": 6, "error": 4}


def test_counters_of_a_replayed_task_equal_a_recount(spark, tmp_path):
    def fail_once(batches):
        """The first run of a task fails after its rows have gone through."""
        yield from batches
        if TaskContext.get().attemptNumber() == 0:
            raise OSError("lost")

    paths = [*I.PATH_KINDS, "更正公告"] * 40
    rows = [(*listed(f"a{i}", p)[:3], f"a{i}", *listed("", p)[4:]) for i, p in enumerate(paths)]
    raw_list = spark.createDataFrame(rows, RAW_LIST_SCHEMA).repartition(4)
    seen = spark.createDataFrame([(f"a{i}",) for i in range(0, 320, 3)] * 2, "article_id string")
    path = str(tmp_path / "list")
    counts = I.write_fresh(raw_list.mapInArrow(fail_once, raw_list.schema), seen, path)
    kept = spark.read.parquet(path)
    kinds = {r.kind: r["count"] for r in kept.groupBy("kind").count().collect()}
    assert counts == {
        "planned": 320, "actual": kept.count(), "remaining": 320 - kept.count(), "dropped": kinds["dropped"],
        "error": kinds[None], "sent": kept.count() - kinds["dropped"] - kinds[None],
    }
    assert {r.name: r.n for r in I.run_counters(spark, counts).collect()} == counts
    none = I.write_fresh(raw_list.limit(0), None, path)
    assert set(none.values()) == {0} and I.run_counters(spark, none).count() == 3


PROJECT = [link(1, "p1", "采购公告"), link(2, "r1", "结果公告"), link(3, "r2", "结果公告")]


def stored(notices):
    return sorted((r.result_source_article_id, r.total_amount, tuple(r.result_article_id)) for r in notices.values())


def test_one_record_per_project_in_one_run_or_two(spark):
    lists = [listed("r2", "中标公告"), listed("r1", "中标公告")]
    details = [detail("p1", purchase_page(total=100), type_=1), detail("r1", win_page(), PROJECT), detail("r2", win_page(), PROJECT)]
    done, both, _ = run(spark, lists, details)
    assert len(both) == 1
    assert {(r.article_id, r.status) for r in done.statuses.collect()} == {("r1", "stored"), ("r2", "covered")}
    first, once, _ = run(spark, lists[1:], details)
    _, later, _ = run(spark, lists[:1], details, seen=I.registered_ids(first.notices))
    assert stored(once) == stored(both) and not later


def test_a_failing_announcement_covers_nothing(spark):
    project = [link(1, "p1", "采购公告"), *[link(i + 1, f"r{i}", "结果公告") for i in (1, 2, 3)]]
    unread = "<p>三、中标信息</p><p>见附件</p>"
    pages = {"r1": unread, "r2": win_page(), "r3": win_page()}
    for title in ("公告", I.CANDIDATE_TITLE):
        lists = [listed(a, "中标公告", title=title if a == "r1" else "公告") for a in pages]
        details = [detail("p1", purchase_page(total=100), type_=1)]
        details += [detail(a, page, project) for a, page in pages.items()]
        done, notices, errors = run(spark, lists, details)
        failed = "candidates" if title == I.CANDIDATE_TITLE else "error"
        assert {(r.article_id, r.status) for r in done.statuses.collect()} == {("r1", failed), ("r2", "stored"), ("r3", "covered")}
        assert set(notices) == {"r2"} and set(errors) == ({"r1"} if failed == "error" else set())
    done, notices, errors = run(spark, lists, details[:1] + [detail(a, unread, project) for a in pages])
    assert not notices and set(errors) == {"r2", "r3"}


def test_order_of_repeated_details_does_not_matter(spark):
    old, new = win_page("报价:40(元)"), win_page("报价:70(元)")
    pages = [
        detail("p1", purchase_page(total=100), type_=1),
        detail("r1", old, PROJECT[:2], time=T0 - DAY),
        detail("r1", new, PROJECT[:2], time=T0),
        detail("r1", old.replace("某局", "他局"), PROJECT[:2], time=T0),
    ]
    found = {str(stored(run(spark, [listed("r1", "中标公告")], [pages[i] for i in order])[1])) for order in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1))}
    assert len(found) == 1


def test_registered_ids_cover_every_result(spark):
    df = spark.createDataFrame([("a", ["a", "b"]), (None, None), ("c", None)], "result_source_article_id string, result_article_id array<string>")
    assert {r.article_id for r in I.registered_ids(df).collect()} == {"a", "b", "c"}


def test_link_errors(spark):
    links = [[link(1, "x", "结果公告", T0, False)], [link(1, "other", "结果公告")], [link(1, "b", "采购监督结果")]]
    from tenderloom.schemas import RAW_LINK_SCHEMA

    df = spark.createDataFrame(
        [(k, T0, x) for k, x in zip("aab", links)],
        f"article_id string, scrape_timestamp long, links array<{RAW_LINK_SCHEMA.simpleString()}>",
    )
    got = [r.link_error for r in I.resolve_links(df).collect()]
    assert got == ["links: negative duration", "links: own result notice is missing", None]


def test_lot_tables(spark):
    plan = spark.createDataFrame([(1, 1, "甲", 60.0), (1, 2, "乙", 40.0), (2, 1, "丙", 5.0)], "id int, index int, name string, budget double")
    result = spark.createDataFrame(
        [(1, 1, None, -1.0, True, 40.0, False), (1, 1, None, -1.0, True, 20.0, True), (1, 2, None, -1.0, False, -1.0, False),
         (2, 3, "x", -1.0, True, 1.0, False)],
        "id int, index int, name string, budget double, is_win boolean, amount double, is_percent boolean",
    )
    merged = L.merge_lots(plan, result)
    assert {(r.id, r["index"], r.name, r.budget) for r in merged.collect()} == {(1, 1, "甲", 60.0), (1, 2, "乙", 40.0), (2, 3, "x", -1.0)}
    assert [tuple(r) for r in L.lot_count_mismatch(plan, result).collect()] == [(2, 1, 3)]
    budget = {r.id: r.lot_budget for r in L.budget_of_lots(merged).collect()}
    assert budget == {1: 100.0, 2: -1.0}
    amounts = L.amount_of_lots(merged.withColumns({"is_win_bid": F.lit(True), "total_budget": F.lit(100.0)}))
    assert {r.id: r.lot_amount for r in amounts.collect()} == {1: 60.0, 2: 1.0}
    declared = spark.createDataFrame([(1, 100.0), (2, 5.0)], "id int, total_budget double")
    assert [r.id for r in L.budget_mismatch(declared, merged).collect()] == [2]


def test_completeness_and_retry(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {r["column"]: r.missing for r in I.completeness(df, ["a", "b", "c"]).collect()} == {"a": 0, "b": 1, "c": 2}
    errors = spark.createDataFrame([("a", True, "m"), ("a", True, "m"), ("b", None, "m"), ("c", False, "m")], "article_id string, is_win boolean, message string")
    old = spark.createDataFrame([("b", None, "m"), ("c", True, "m")], "article_id string, is_win boolean, message string")
    assert {(r.article_id, r.is_win) for r in I.retry_list(errors, old).collect()} == {("a", True), ("c", False)}


def test_quarantine_keeps_lots_as_json(spark):
    lists = [listed("mm", "成交公告")]
    details = [
        detail("mm", win_page(), [link(1, "p3", "采购公告"), link(2, "mm", "结果公告")]),
        detail("p3", purchase_page(1, 2) + purchase_page(3, 4), type_=1),
    ]
    done, notices, errors = run(spark, lists, details)
    assert errors == {"mm": "record: number of lots differs"} and not notices
    assert len(json.loads(done.quarantine.first().content)) == 3


def test_lots_are_merged_by_index(spark):
    """The first purchase lot of an index counts; gaps, repeats, nulls and no purchase lot; many lots."""
    shape = f"array<{LOT_SCHEMA.simpleString()}>"
    lot = lambda i, name, budget: (name, i, True, budget, 1.0, False, "S", None, None)
    names = [f.name for f in LOT_SCHEMA]
    assert names == ["name", "index", "is_win", "budget", "amount", "is_percent", "supplier", "supplier_address", "reason"]
    plan = [lot(3, "c", 3.0), lot(1, "a", 1.0), lot(1, "again", 9.0), lot(7, "g", 7.0), lot(None, "no index", 5.0)]
    result = [lot(1, "r1", -1.0), lot(1, "r2", -1.0), lot(2, "r3", -1.0), lot(7, "r4", -1.0), lot(None, "r5", -1.0), lot(3, "r6", -1.0)]
    rows = spark.createDataFrame([(plan, result), ([], result[:1]), (plan, [])], f"p {shape}, r {shape}")
    got = [[(x["index"], x["name"], x["budget"]) for x in r.m] for r in rows.select(I._merged(F.col("p"), F.col("r")).alias("m")).collect()]
    assert got == [
        [(1, "a", 1.0), (1, "a", 1.0), (2, "r3", -1.0), (7, "g", 7.0), (None, "r5", -1.0), (3, "c", 3.0)],
        [(1, "r1", -1.0)],
        [],
    ]
    # The same rule on tables.
    flat = lambda c: rows.limit(1).select(F.lit(1).alias("id"), F.inline(c))
    once = flat("p").filter("name not in ('again', 'no index')")
    table = L.merge_lots(once, flat("r")).select("index", "name", "budget")
    assert sorted(map(tuple, table.collect()), key=str) == sorted(got[0], key=str)

    n = 5000
    many = spark.range(1).select(
        F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda i: I._lot_struct(index=i, name=F.concat(F.lit("p"), i), budget=i)).alias("p"),
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: I._lot_struct(index=i, amount=i)).alias("r"),
    ).checkpoint()
    began = time.time()
    merged = many.select(F.inline(I._merged(F.col("p"), F.col("r")))).collect()
    assert [(x["index"], x["name"], x["budget"]) for x in merged] == [(i, f"p{i}", float(i)) for i in range(1, n + 1)]
    assert time.time() - began < 10
