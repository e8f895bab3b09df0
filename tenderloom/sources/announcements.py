"""Raw announcement tables derived from the star-schema tables.

Each text is put together from the columns of one row, in the forms announcements
take, so that what the parsers read can be checked against those columns.  Pages
are per row: nothing is collected into groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderloom.sources.fixtures import notices, table

DAY_MS = 86400000


def _t(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(number: Column, *choices: Column | str) -> Column:
    """The choice number modulo the number of choices."""
    n = len(choices)
    return F.coalesce(
        *[
            F.when(number % n == i, F.lit(c) if isinstance(c, str) else c)
            for i, c in enumerate(choices)
        ]
    )


def raw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list row per order; some path names are dropped kinds, some unknown."""
    rows = notices(spark, sf_dir)
    k = F.col("id")
    path = (
        F.when(k % 17 == 0, "更正公告")
        .when(k % 13 == 0, "公开招标资格入围公告")
        .when(F.col("is_win_bid"), _pick(k, "中标公告", "成交公告", "中标（成交）结果公告"))
        .when(F.col("is_termination"), "终止公告")
        .otherwise("废标公告")
    )
    return rows.select(
        _t("TITLE-", k).alias("title"),
        F.col("scrape_timestamp").alias("publishDate"),
        path.alias("pathName"),
        _t("R", k).alias("articleId"),
        "author",
        F.col("district_code").cast("string").alias("districtCode"),
        F.col("district_name").alias("districtName"),
        F.col("catalog").alias("gpCatalogName"),
        F.col("procurement_method").alias("procurementMethod"),
        (F.col("scrape_timestamp") - DAY_MS).alias("bidOpeningTime"),
    )


def seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids stored by earlier runs: the orders before 1997."""
    old = notices(spark, sf_dir).filter(F.year(F.timestamp_millis("scrape_timestamp")) < 1997)
    return old.select(_t("R", F.col("id")).alias("article_id"))


def _links() -> Column:
    """The links of the project of notice ``id``; every seventh has none."""
    k, ts = F.col("id"), F.col("scrape_timestamp")

    def link(order: int, exists: Column, time: Column, type_: str, prefix: str) -> Column:
        return F.struct(
            F.lit(order).alias("order"),
            exists.alias("isExist"),
            time.alias("publishDateTime"),
            F.lit(type_).alias("typeName"),
            _t(prefix, k).alias("articleId"),
        )

    yes = F.lit(True)
    links = F.array(
        link(3, yes, ts, "中标结果公告", "R"),
        link(1, k % 2 == 0, ts - 10 * DAY_MS, "采购公告", "P"),
        link(2, yes, ts - 20 * DAY_MS, "其他公告", "O"),
        link(4, k % 3 == 0, ts + 5 * DAY_MS, "采购监督结果", "S"),
    )
    return F.when(k % 7 != 0, links).otherwise(F.filter(links, lambda x: F.lit(False)))


def linked_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result notices with the links of their project."""
    rows = notices(spark, sf_dir).select("id", "scrape_timestamp")
    return rows.select(_t("R", F.col("id")).alias("article_id"), "scrape_timestamp", _links().alias("links"))


def titled_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and detail types of result notices, some to be skipped."""
    k = F.col("id")
    return notices(spark, sf_dir).select(
        "id",
        _pick(
            k, "中标结果公告", "公开征集公告", "中标候选人公示", "资格审查结果", "成交公告", "终止公告", "废标公告"
        ).alias("title"),
        F.when(k % 5 == 0, 3009)
        .when(k % 5 == 1, F.lit(None).cast("int"))
        .when(k % 5 == 2, 3004)
        .when(k % 5 == 3, 0)
        .otherwise(3015)
        .alias("announcement_type"),
    )


#: Parts per core that line items are dealt to for the text work.
TEXT_PARTS = 8


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items for the text forms, dealt anew: the costly text work must not follow the row groups.

    A row here is far smaller than the work on it, so the number of parts is set by the cores: by the
    size of the rows Spark would make few more tasks than cores, and most cores would wait for the last."""
    parts = TEXT_PARTS * spark.sparkContext.defaultParallelism
    rows = table(spark, sf_dir, "lineitem").repartition(parts, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(
        "*",
        F.round(F.col("l_discount") * 100).cast("int").alias("off"),
        F.col("l_quantity").cast("int").alias("qty"),
    )


def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, off, qty = F.col("l_extendedprice"), F.col("off"), F.col("qty")
    text = _pick(
        F.col("l_linenumber"),
        _t("报价:", price, "(元),报价大写:", price, "(元)"),
        _t(price, "(元)"),
        _t("让利系数:", off, "(%)"),
        _t("单位及数量:", qty, "(个),金额:", price, "(元)"),
        _t("甲 组:", price, "(元)，乙组:", qty, "(元)"),
        _t("折扣:", off, "(元)"),
        _t("总报价（含税，元）:", price, "(%)"),
    )
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", text.alias("amount_text"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A win page per line item: one won and one void lot, experts and contacts."""
    line, ln, part, supp = F.col, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    page = _t(
        "<html><head><style>p{margin:0}</style></head><body><!-- head --><p>一、</p><p>项目编号：CODE-",
        line("l_orderkey"),
        "</p><p>二、项目名称：NAME-",
        part,
        "</p><p>三、中标（成交）信息</p><p>1.中标结果：</p><table><tr><td>序号</td><td>中标（成交）金额(元)</td>"
        "<td>中标供应商名称</td><td>中标供应商地址</td></tr><tr><td>",
        ln,
        "</td><td>总报价:",
        line("l_extendedprice"),
        "(元)</td><td>SUP-",
        supp,
        "</td><td>ADDR&amp;<b>-",
        part % 3,
        "</b></td></tr></table><p>2.废标结果:</p><table><tr><td>序号</td><td>标项名称</td><td>废标理由</td></tr><tr><td>",
        ln + 7,
        "</td><td>LOT-",
        part,
        "</td><td>REASON-",
        line("l_linestatus"),
        "</td><td>/</td></tr></table><p>四、主要标的信息</p><p>&ldquo;</p><p>无</p><p>五、评审专家（单一来源采购人员）名单：</p><p>张",
        supp,
        "（采购人代表）、李",
        part % 5,
        "、王",
        ln,
        "</p><p>六、代理服务收费标准及金额</p><p>1.代理服务收费标准：</p><p>八、凡对本次公告内容提出询问，请按以下方式联系</p>"
        "<p>1.采购人信息</p><p>名 称：BUYER-",
        line("l_orderkey"),
        "</p><p>地址：A</p><p>联系方式：1</p><p>2.采购代理机构信息</p><p>名 称：",
        _pick(supp, "甲方代理", "乙方代理", "丙方代理"),
        "</p><p>地址：B</p></body></html>",
    )
    return _line(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.lit(True).alias("is_win_bid"), page.alias("content")
    )


def void_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that say why lots were void, in every form."""
    ln, qty, part = F.col("l_linenumber"), F.col("qty"), F.col("l_partkey")
    text = _pick(
        ln,
        _t("标项", qty, "：原因", part, "；标项", qty + 1, "：理由", part, "。"),
        _t(qty, "分标 提交文件的供应商不足", part, "家"),
        _t("A分标:原因", part, ";C分标:理由", part),
        _t("本项目1、", qty + 1, "分标供应商不足", part, "家，本项目废标"),
        _t("1分标、2分标、", qty + 2, "分标供应商不足", part, "家"),
        _t("供应商不足", part, "家，本次采购失败。"),
        _t("分标1至分标", qty, "供应商不足。"),
    )
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", "qty", "l_partkey", text.alias("reason_text"))


def termination_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln, part = F.col("l_linenumber"), F.col("l_partkey")
    lines = _pick(
        ln,
        F.array(_t("终止原因", part)),
        F.array(F.lit("其他"), _t("终止原因", part)),
        F.array(F.lit("其他"), F.lit("说明"), _t("终止原因", part)),
    )
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", lines.alias("lines"))


def expert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    lines = _pick(
        ln,
        F.array(_t("张", supp, "（第1、2分标采购人代表），李", part, "，王", ln)),
        F.array(_t("评审专家名单：张", supp, "、（采购人代表）李", part, "、王", ln, "。")),
        F.array(_t("张", supp, " "), _t("李", part)),
        F.array(F.lit("/")),
        F.array(_t("张", supp, "（组长、李", part)),
    )
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", lines.alias("lines"))


def contact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    text = _pick(
        F.col("l_linenumber"),
        _t("1.采购人信息名 称：局", part, "地 址：路1号联系方式：077 2.采购代理机构信息(如有)名 称：",
           _pick(supp, "甲方代理", "乙方代理"), "地址：路2号"),
        _t("1.招标人信息 名称：局", part, "联系人：张 2.招标代理机构：", _pick(supp, "甲方代理", "乙方代理"), "联系方式：1"),
        _t("项目联系人：张", part),
    )
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", text.alias("contact_text"))


def purchase_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase pages with one or two lots, with and without a declared budget."""
    line, price, part, qty = F.col, F.col("l_extendedprice"), F.col("l_partkey"), F.col("qty")
    head = _t("项目编号：CODE-", line("l_orderkey"), " 项目名称：NAME-", part, " 采购方式：公开招标 ")
    lot = (lambda no, name, money: _t("标项", no, "标项名称：", name, "数量：1 预算金额（元）：", money, " 数量："))
    text = _pick(
        line("l_linenumber"),
        _t(head, "预算总金额（元）：", price, " 采购需求：", lot("一", _t("甲", part), price)),
        _t(head, "预算总金额：", qty, "万元 采购需求:", lot("1", _t("甲", part), qty * 10000 - 5000),
           lot("2", _t("乙", part), "5000")),
        _t(head, "预算：见附件 采购需求：", lot("", _t("甲", part), price), lot("", _t("乙", part), qty)),
        _t(head, "预算金额（元）：", price, " 简要说明"),
        _t(head, "预算总金额（元）：", price, " 采购需求：", lot("一", _t("甲", part), qty)),
    )
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", text.alias("page_text"))


def lot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase lots: one per order and line number."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("index")).agg(
        _t("PLAN-", F.max("l_partkey")).alias("name"), F.max("l_extendedprice").alias("budget")
    )


def project_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate announcements of a project."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project"),
        F.when(F.col("l_returnflag") == "R", "purchase").otherwise("result").alias("kind"),
        F.col("l_linenumber").alias("position"),
        _t("A", F.col("l_suppkey")).alias("article_id"),
        ((F.col("l_discount") > 0.03) & (F.year("l_shipdate") >= 1996)).alias("usable"),
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse errors of earlier runs, with repeats."""
    return table(spark, sf_dir, "lineitem").select(
        _t("R", F.col("l_orderkey")).alias("article_id"),
        (F.col("l_returnflag") != "R").alias("is_win"),
        _t("ERROR-", F.col("l_linestatus")).alias("message"),
        F.year("l_shipdate").alias("year"),
    )


def notice_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices as JSON values; every 19th is cut off."""
    k = F.col("id")
    lot = F.struct(
        _t("LOT-", k).alias("name"),
        F.lit(1).alias("index"),
        F.col("is_win_bid").alias("is_win"),
        F.col("total_budget").alias("budget"),
        F.col("total_amount").alias("amount"),
        F.lit(False).alias("is_percent"),
        F.col("purchaser").alias("supplier"),
    )
    doc = F.to_json(
        F.struct(
            _t("R", k).alias("result_source_article_id"),
            "scrape_timestamp",
            F.col("district_code").cast("string").alias("district_code"),
            "is_win_bid",
            "is_termination",
            "total_amount",
            F.array(_t("R", k), _t("S", k)).alias("result_article_id"),
            F.array(lot, lot).alias("bid_items"),
        )
    )
    return notices(spark, sf_dir).select(
        F.when(k % 19 == 0, F.concat(F.substring(doc, 1, 20))).otherwise(doc).alias("value")
    )


def district_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as district documents of four generations."""
    base = F.col("s_suppkey") * 10000 + 100000000

    def node(code: Column, children: Column | None, name: str) -> Column:
        fields = [
            code.cast("string").alias("code"),
            _t(name, F.col("s_suppkey")).alias("name"),
            _t("FULL-", code).alias("fullName"),
            _t("SHORT-", code).alias("shortName"),
            F.lit(children is None).alias("isLeaf"),
        ]
        return F.struct(*fields, *([] if children is None else [children.alias("children")]))

    last = F.array(node(base + 105, None, "V"))
    # Text, because generations of different depth have different structs.
    text = F.concat(
        F.lit("["), F.to_json(node(base + 102, None, "L")), F.lit(","), F.to_json(node(base + 103, None, "M")),
        F.lit(","), F.to_json(node(base + 104, last, "T")), F.lit("]"),
    )
    own = node(base + 199, F.filter(last, lambda x: F.lit(False)), "O")

    def holding(n: Column, children: Column) -> Column:
        return F.concat(F.regexp_replace(F.to_json(n), '"isLeaf":true}$', '"isLeaf":false,"children":'), children, F.lit("}"))

    city = holding(node(base + 100, None, "C"), text)
    root = holding(node(base, None, "P"), F.concat(F.lit("["), city, F.lit(","), F.to_json(own), F.lit("]")))
    return table(spark, sf_dir, "supplier").select(root.alias("doc"))


def raw_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result and purchase pages of the orders in :func:`raw_list`, with the links of their project.

    The purchase page is dated 30 years later than the order so that it is usable.
    """
    rows = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    # Texts and links are put together after the join, so that only the columns they are made of are moved.
    placed = rows.join(notices(spark, sf_dir).select("id", "scrape_timestamp"), k == F.col("id"))
    win = _t(
        "<p>三、中标（成交）信息</p><p>1.中标结果：</p><td>1</td><td>报价:",
        price,
        "(元)</td><td>SUP-",
        F.col("o_custkey"),
        "</td><td>路</td><p>2.废标结果：</p><td>2</td><td>标乙</td><td>不足</td><p>八、联系方式</p><p>采购人：局",
        F.col("o_custkey"),
        "地址：街</p>",
    )
    content = (
        F.when((F.col("o_orderstatus") == "F") & (k % 23 == 0), "<p>三、中标信息</p><p>见附件</p>")
        .when(F.col("o_orderstatus") == "F", win)
        .when(F.col("o_orderstatus") == "O", _t("<p>二、项目废标的原因</p><p>供应商不足", k % 3, "家</p>"))
        .otherwise(_t("<p>二、终止说明</p><p>政策", k % 3, "变化</p>"))
    )
    pages = placed.select(
        _t("R", k).alias("articleId"),
        F.lit("结果公告").alias("title"),
        _t("CODE-", k).alias("projectCode"),
        _t("NAME-", k).alias("projectName"),
        F.lit("450100").alias("districtCode"),
        F.lit(3004).alias("announcementType"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("publishDate"),
        content.alias("content"),
        _links().alias("announcementLinkDtoList"),
    )
    plan = _t(
        "<p>预算总金额（元）：",
        k % 100 + 51,
        " 采购需求：</p><p>标项一标项名称：甲",
        k,
        "数量：1预算金额（元）：",
        k % 100 + 1,
        "数量：</p><p>标项二标项名称：乙",
        k,
        "数量：1预算金额（元）：50数量：</p>",
    )
    purchases = rows.select(
        _t(_pick(k, "P", "O"), k).alias("articleId"),
        F.lit("采购公告").alias("title"),
        F.lit(None).cast("string").alias("projectCode"),
        F.lit(None).cast("string").alias("projectName"),
        F.lit("450100").alias("districtCode"),
        F.lit(1).alias("announcementType"),
        (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 10958 * DAY_MS).alias("publishDate"),
        plan.alias("content"),
        F.lit(None).cast(pages.schema["announcementLinkDtoList"].dataType).alias("announcementLinkDtoList"),
    )
    return pages.unionByName(purchases)


# Projects with many result and purchase pages: the lines of an order, in every state a page can have.


def _project_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as announcements: page number ``n`` of the project, ``side``, and a number for its state."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))  # the few lines of an order
    k, n = F.col("l_orderkey"), F.col("n")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", number.alias("n")).select(
        k.alias("project"),
        "n",
        F.when(F.col("l_returnflag") == "R", "purchase").otherwise("result").alias("side"),
        (F.col("l_partkey") % 8).alias("c"),
        (F.col("l_partkey") % 1000 + 100).alias("price"),
        _t("A", k, "-", n).alias("article_id"),
    )


_SEARCH_TIME = 1700000000000


def searched_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list row of each project with a result page: its second one if there is one."""
    results = _project_lines(spark, sf_dir).filter("side = 'result'")
    numbers = F.array_sort(F.collect_list("n"))
    own = results.groupBy("project").agg(F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0))).alias("n"))
    return own.select(
        _t("PROJECT-", F.col("project")).alias("title"),
        F.lit(_SEARCH_TIME).alias("publishDate"),
        F.lit("中标公告").alias("pathName"),
        _t("A", F.col("project"), "-", F.col("n")).alias("articleId"),
        F.lit("作者").alias("author"),
        F.lit("450100").alias("districtCode"),
        F.lit("城").alias("districtName"),
        F.lit("货物").alias("gpCatalogName"),
        F.lit("公开招标").alias("procurementMethod"),
        F.lit(_SEARCH_TIME).alias("bidOpeningTime"),
    )


def searched_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of :func:`searched_list`.  Results: 0 no page, 1 wrong type, 2 no lots, 3 unknown layout,
    4 a title without lots, else a win.  Purchases: 0 no page, 1 too old, 2 unreadable, else two lots.
    Every fifth page occurs twice, with an older row that says something else."""
    lines = _project_lines(spark, sf_dir)
    c, price, bought = F.col("c"), F.col("price"), F.col("side") == "purchase"
    link = F.struct(
        F.col("n").alias("order"),
        F.lit(True).alias("isExist"),
        F.lit(_SEARCH_TIME).alias("publishDateTime"),
        F.when(bought, "采购公告").otherwise("结果公告").alias("typeName"),
        F.col("article_id").alias("articleId"),
    )
    # Over the partitions and the order that numbered the lines, so the lines are moved and sorted once.
    links = F.array_sort(F.collect_list(link).over(Window.partitionBy("project")))
    win = _t(
        "<p>三、中标（成交）信息</p><p>1.中标结果：</p><td>1</td><td>报价:", price, "(元)</td><td>SUP</td><td>路</td>"
        "<p>2.废标结果：</p><td>2</td><td>标乙</td><td>不足</td><p>八、联系方式</p><p>采购人：局地址：街</p>",
    )
    # A declared budget that is not the sum of the lots makes a purchase page unreadable.
    plan = _t(
        "<p>预算总金额（元）：", price + F.when(c == 2, 49).otherwise(50), " 采购需求：</p><p>标项一标项名称：甲数量：1预算金额（元）：", price,
        "数量：</p><p>标项二标项名称：乙数量：1预算金额（元）：50数量：</p>",
    )
    content = (
        F.when(bought, plan)
        .when(c == 2, "<p>空</p>")
        .when(c == 3, "<p>三、中标信息</p><p>见附件</p>")
        .otherwise(win)
    )
    linked = lines.filter("project IS NOT NULL").withColumn("announcementLinkDtoList", links)
    rows = linked.filter(c != 0).select(
        F.col("article_id").alias("articleId"),
        F.when(~bought & (c == 4), "公开征集公告").otherwise("公告").alias("title"),
        F.lit(None).cast("string").alias("projectCode"),
        F.lit(None).cast("string").alias("projectName"),
        F.lit("450100").alias("districtCode"),
        F.when(~bought & (c == 1), 9999).when(bought, 1).otherwise(3004).alias("announcementType"),
        F.when(bought & (c == 1), F.lit(1600000000000)).otherwise(F.lit(_SEARCH_TIME)).alias("publishDate"),
        content.alias("content"),
        "announcementLinkDtoList",
    )
    older = {"content": F.lit("<p>旧</p>"), "title": F.lit("公开征集公告"), "publishDate": F.lit(1500000000000)}
    with_older = F.when(F.pmod(F.crc32("articleId"), F.lit(5)) == 0, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False))
    )
    both = rows.withColumn("_older", F.explode(with_older))
    return both.withColumns({name: F.when(F.col("_older"), v).otherwise(F.col(name)) for name, v in older.items()}).drop("_older")
