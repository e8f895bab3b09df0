"""Text rules on lines written for the test, with the values they must give."""

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import labels, text
from tenderloom.functions.amounts import parse_amount
from tenderloom.functions.notice_text import (
    contacts,
    purchase_facts,
    review_experts,
    termination_reason,
    void_reasons,
)
from tenderloom.operators.pages import _table_rows, numbered_lots, split_sections, text_lines

AMOUNTS = {
    "报价:795000(元),报价大写:795000(元)": (795000.0, False),
    "首次报价:690000.00(元),最终评审价:680000.00(元)": (690000.0, False),
    "795000(元)": (795000.0, False),
    "12.5(%)": (12.5, True),
    "3(个)": None,
    "让利系数:1.1(%)": (98.9, True),
    "投标综合优惠率:3(%)": (97.0, True),
    "下浮系数报价:3(%)": (97.0, True),
    "利润率:2.2(%)": (45.45, True),
    "利润率:0(%)": None,
    "折扣率:90(%)": (90.0, True),
    "折扣:90(元)": None,
    "费率:7(%)": (7.0, True),
    "三家:5(元),四家:7(元)": (12.0, False),
    "数量:3(个),份额:4(个)": None,
    "数量:3(个)，金额：4(元)": (4.0, False),
    "报价:5(吨),金额:4(元)": None,
    "总价（元，含税）:650(元)": (650.0, False),
    "捌万元整(¥80000元)": (80000.0, False),
    "报价:1 000　(元)": (1000.0, False),
    "报价(元)": None,
    "报价:7(异常类型)": (7.0, False),
    "无": None,
}


def test_amounts(spark):
    df = spark.createDataFrame([(t,) for t in AMOUNTS], "t string")
    rows = df.select("t", parse_amount(F.col("t")).alias("r")).select("t", "r.*").collect()
    got = {r.t: (r.amount, r.is_percent) if r.ok else None for r in rows}
    assert got == AMOUNTS


VOID = {
    "标项1：供应商不足三家，废标；标项12：分标2数量不符合要求。": ([(1, "供应商不足三家，废标"), (12, "分标2数量不符合要求")], False),
    "01分标至递交截止，供应商不足3家，01分标采购失败": ([(1, "至递交截止，供应商不足3家，01分标采购失败")], False),
    "B分标:投标人不足": ([(2, "投标人不足")], False),
    "本项目1、2分标供应商不足三家，本项目废标": ([(1, "供应商不足三家，本项目废标"), (2, "供应商不足三家，本项目废标")], False),
    "至截止时间，1分标、5分标提交文件的供应商均不足3家": ([(1, "提交文件的供应商均不足3家"), (5, "提交文件的供应商均不足3家")], False),
    "至截止时间，01、02、03分标供应商不足": ([(1, "供应商不足"), (2, "供应商不足"), (3, "供应商不足")], False),
    # A number before the word counts before one behind it.
    "标项1:因第4分标不足": ([(4, "不足")], False),
    "因供应商不足 三家，故废标。": ([(1, "因供应商不足三家，故废标。")], True),
    "分标1至分标9供应商不足": ([(1, "分标1至分标9供应商不足")], True),
}


def test_void_reasons(spark):
    df = spark.createDataFrame([(t,) for t in VOID], "t string")
    rows = df.select("t", void_reasons(F.col("t")).alias("v")).select("t", "v.*").collect()
    assert {r.t: ([tuple(x) for x in r.lots], r.shared) for r in rows} == VOID
    assert all(r.error is None for r in rows)


def test_void_reason_of_unknown_form(spark):
    df = spark.createDataFrame([("A分标有误。各标项情况说明",)], "t string")
    assert df.select(void_reasons(F.col("t")).alias("v")).first().v.error == "void reason: form not known"


def test_long_texts_do_not_overflow_the_matcher(spark):
    body = "因故" * 20000
    df = spark.createDataFrame([("标项3：" + body + "、" + body,)], "t string")
    row = df.select(void_reasons(F.col("t")).alias("v")).first().v
    assert row.lots[0]["index"] == 3 and len(row.lots[0].reason) == 80001


EXPERTS = [
    (["张洪（第1、2分标采购人代表），方丽，何德"], ["张洪", "方丽", "何德"], ["张洪"], None),
    (["评审专家名单：周宏、（采购人代表）梁雄、郑祥。"], ["周宏", "梁雄", "郑祥"], ["梁雄"], None),
    (["李一 王二"], ["李一", "王二"], [], None),
    (["李一(组长)、王二"], ["李一", "王二"], [], None),
    (["/"], [], [], None),
    ([], [], [], None),
    (["李（组长）一、王二"], None, None, "review experts: brackets not understood"),
    (["李（组长、王二"], None, None, "review experts: brackets not understood"),
]


@pytest.mark.parametrize("lines,experts,representatives,error", EXPERTS)
def test_review_experts(spark, lines, experts, representatives, error):
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    row = df.select(review_experts(F.col("lines")).alias("e")).first().e
    assert row.error == error
    if error is None:
        assert (row.experts, row.representatives) == (experts, representatives)


def test_termination_reason(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],)], "lines array<string>")
    rows = [tuple(r.t) for r in df.select(termination_reason(F.col("lines")).alias("t")).collect()]
    assert rows[:2] == [("a", None), ("b", None)]
    assert rows[2][1].endswith("more than two lines") and rows[3][1].endswith("empty")


def test_contacts(spark):
    cases = {
        "1.采购人信息名 称：甲局地 址：一路1号联系方式：1 2.采购代理机构信息(如有)名 称：乙公司地址：二路": ("甲局", "乙公司"),
        "1.征集人：丙院 联系人：张 2.招标代理机构：丁公司2号": ("丙院", "丁公司"),
        "电话：1": (None, None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    rows = df.select("t", contacts(F.col("t")).alias("c")).select("t", "c.*").collect()
    assert {r.t: (r.purchaser, r.agency) for r in rows} == cases


def test_purchase_facts(spark):
    lots = "标项一标项名称：甲 数量：1 预算金额（元）：30 数量： 标项二标项名称：乙 预算金额（元）：12.5 数量："
    texts = [
        "项目编号：X-1 项目名称：路 采购方式：公开 预算总金额（元）：42.5 采购需求：" + lots,
        "项目编号：X-1 项目名称：路 预算总金额：1万元 采购需求：" + lots,
        "项目名称：路 采购方式：公开 采购需求:" + lots.replace("标项一", "").replace("标项二", ""),
        "项目编号：X-1 项目名称：路 预算金额：2亿元 说明",
        "预算总金额：2元 采购需求：见附件",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = [r.p for r in df.select("i", purchase_facts(F.col("t")).alias("p")).orderBy("i").collect()]
    assert [tuple(x) for x in rows[0].lots] == [(1, "甲", 30.0), (2, "乙", 12.5)]
    assert (rows[0].project_code, rows[0].project_name, rows[0].total_budget, rows[0].error) == ("X-1", "路", 42.5, None)
    # A declared budget above the lots and one below them are both errors.
    assert rows[1].error == "purchase budget: lots do not add up" and rows[1].total_budget == 10000.0
    assert [x["index"] for x in rows[2].lots] == [1, 2] and rows[2].total_budget == 42.5
    assert rows[3].without_lots and rows[3].total_budget == 2e8
    assert rows[4].without_lots and rows[4].total_budget == 2.0


def test_text_lines():
    html = (
        '<html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>'
        '<body><!-- no --><p title="a>b">one<b> two</b>&nbsp;</p>“<br/>3 < 4<!-- cut -->5&#65;</body></html>'
    )
    assert text_lines(html) == ["T & t", "p{}", 'var t="</p>";', "one", "two", "3 < 4", "5A"]
    assert text_lines("") == [] and text_lines(None) == []
    assert text_lines("<p " + "a" * 50000 + "'") == ["<p " + "a" * 50000 + "'"]


def test_sections_of_a_win_page():
    lines = ["标题", "一", "、项目编号：", "N-1", "二、", "项目名称：路", "三、中标（成交）信息", "1.中标结果：", "1"]
    lines += ["二、这不是标题", "四、主要标的信息", "x", "五、评审专家名单：", "甲、乙", "五、评审", "丙", "八、联系方式", "1.采购人"]
    found = split_sections(lines, True)
    assert found["project_code"] == ["N-1"]
    assert found["project_name"] == ["路"]
    assert found["win"] == ["1.中标结果：", "1", "二、这不是标题"]
    # A heading that does not rise belongs to the section before it.
    assert found["review"] == ["甲、乙", "五、评审", "丙"]
    assert found["contact"] == ["1.采购人"]


def test_sections_of_a_void_page():
    lines = ["一、项目编号：N-1", "二、项目", "废标的", "原因", "供应商不足", "三、其他补充事宜", "无", "四、终止说明", "政策变化"]
    found = split_sections(lines, False)
    assert found["void"] == ["供应商不足"]
    assert found["termination"] == ["政策变化"]
    assert "win" not in found


def test_numbered_lots():
    lines = ["1.中标结果：", "序号", "金额", "1", "报价:5(元)", "甲", "路", "1号", "A分标", "报价:6(元)", "乙", "街"]
    lines += ["2.废标结果:", "序号", "3", "标丙", "不足", "/", "4", "标丁", "无效"]
    lots, error = numbered_lots(lines)
    assert error is None
    assert [(x["index"], x["is_win"], x["supplier"], x["supplier_address"], x["name"], x["reason"]) for x in lots] == [
        (1, True, "甲", "路1号", None, None),
        (1, True, "乙", "街", None, None),
        (3, False, None, None, "标丙", "不足"),
        (4, False, None, None, "标丁", "无效"),
    ]


def test_other_lot_layouts():
    listed = ["1.供应商名称：甲", "2.供应商地址：路", "3.成交金额：80元", "4.工期：3天"]
    lots, error = numbered_lots(listed)
    assert error is None and (lots[0]["supplier"], lots[0]["supplier_address"]) == ("甲", "路")
    plain, error = numbered_lots(["中标结果", "1", "795000", "甲", "路"])
    assert error is None and plain[0]["price_text"] == "795000"
    assert numbered_lots(["见附件"])[1] == "result lots: layout not known"
    assert numbered_lots(["1.中标结果：", "1", "5", "甲"])[1] == "result lots: only one of the two tables"
    assert numbered_lots(["1.中标结果：", "1", "5", "2.废标结果："])[1] == "result lots: incomplete row"


def test_numerals():
    words = text.chinese_numerals()
    assert (words["零"], words["十"], words["十九"], words["二十"], words["九十九"], words["一百"]) == (0, 10, 19, 20, 99, 100)
    assert len(words) == 101


def test_small_text_functions(spark):
    df = spark.createDataFrame([("12.345元", "万元", "http://a.b/?x=1&articleId=a%2Fb%3D%3D", "a(b)c）")], "n string, u string, l string, b string")
    left, right = text.bracket_positions(F.col("b"))
    row = df.select(
        text.leading_number(F.col("n")).alias("n"),
        text.unit_factor(F.col("u")).alias("u"),
        text.article_id(F.col("l")).alias("l"),
        left.alias("left"),
        right.alias("right"),
        text.ends_with_colon(F.lit("名称： ")).alias("colon"),
        text.chinese_number(F.lit("二十一")).alias("z"),
        text.to_number(F.lit("x")).alias("bad"),
    ).first()
    assert tuple(row) == (12.345, 10000.0, "a/b==", 2, 4, True, 21, None)


def test_labels(spark):
    values = [(123456789.0,), (12345678.0,), (1234567.0,), (12345.5,), (9999.0,), (0.0,), (-1.0,), (None,)]
    df = spark.createDataFrame(values, "x double")
    shown = [r[0] for r in df.select(labels.amount_text(F.col("x"))).collect()]
    assert shown == ["1.2346亿元", "1.2346千万元", "1.2346百万元", "1.2346万元", "9999.0000元", "0", "-1", None]
    assert [r[0] for r in df.select(labels.number_or(F.col("x"))).collect()][-2:] == [labels.NO_DATA, labels.NO_DATA]
    outcome = spark.createDataFrame([(True, None), (False, True), (False, None), (None, False)], "w boolean, t boolean")
    assert [r[0] for r in outcome.select(labels.outcome_code(F.col("w"), F.col("t"))).collect()] == [1, 3, 2, 2]


def test_lot_rows_beyond_two_digits():
    """Rows 1 to 120 of a table; cells of three digits that do not go on with the numbering stay cells."""
    lines = ["序号", "价", "名", "址"]
    for n in range(1, 121):
        lines += [str(n), f"报价:{n}(元)", f"S{n}x", "500"]
    rows = _table_rows(lines)
    assert [n for n, _ in rows] == list(range(1, 121))
    assert all(cells == [f"报价:{n}(元)", f"S{n}x", "500"] for n, cells in rows)
