"""Pages read in parts: only what is asked for, whatever the markup, by tasks that follow the cores."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import pages
from tenderloom.plans import ingest
from tenderloom.sources import announcements

PAGE = (
    "<p>一、项目编号：C1</p><p>三、中标信息</p><p>1.中标结果：</p><td>1</td><td>报价:5(元)</td><td>供</td><td>路</td>"
    "<p>2.废标结果：</p><td>2</td><td>标乙</td><td>不足</td><p>五、评审专家名单：</p><p>张三、李四（采购人代表）</p>"
)


@pytest.mark.parametrize(
    "html",
    [
        "<a title='x>y' href=\"<b>\">1</a><!-- <p>2</p> -->3<!doctype x>4<script>a<b>'</script>5<STYLE>&lt;</STYLE>&lt;6",
        "1 < 2<p>3</p>",
        "<a b=\"c\" d='e'>1</a><a \"'\" '>2>3</a>",
        "<p>1</p><script",
        "<!-- 1",
        "<p><scripty>1</scripty><a<b>2</a>",
    ],
)
def test_plain_tags_are_read_as_all_markup_is(html):
    parts = pages._MARKUP.split(html)
    del parts[1::3]
    nodes = [(x if i % 2 else pages.unescape(x)).strip() for i, x in enumerate(parts) if x]
    assert pages.text_lines(html) == [x for x in nodes if x and x not in pages.NOISE]


PIECES = (
    "<p>", "</p>", "<a title=\"x>y\">", "<td class='a'>", "<b c=\"d&e\">", "<script>", "</script>", "<Style x>", "</STYLE>",
    "<strong>", "<s>", "<st>", "<scripty>", "<\u017fcript>", "<style-x>", "<!--", "-->", "<!-- x -->", "<!doctype html>", "<?x y?>",
    "<!>", "<!->", "<script", "</", "<", ">", "&lt;", "&", "\"", "'", " ", "\u3000", "\n", "a", "b>", "1", "{margin:0}", "\u201c", "\\n",
)


def test_a_batch_of_pages_is_read_as_single_pages_are():
    rng = random.Random(5)
    html = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(4000)]
    html += [None, PAGE, "<html><style>p{}</style><!-- head --><p a=\"1\">x &amp; y</p></html>"]
    assert pages._lines_of_pages(pa.array(html)) == [pages.text_lines(x) for x in html]
    simple = pa.compute.match_substring_regex(pa.array(html), pages._SIMPLE_PAGE).to_pylist()
    assert simple[-3:] == [None, True, True] and 100 < sum(map(bool, simple)) < len(html)


def test_a_batch_of_several_runs_keeps_its_order(spark):
    n = 2 * pages.PAGES_AT_ONCE + 7
    df = spark.range(n, numPartitions=1).select(
        "id", F.concat(F.lit("<p>一、项目编号：C"), F.col("id").cast("string"), F.lit("</p>")).alias("html")
    )
    read = df.select("id", pages.read_result_page(F.col("html"), F.lit(True), ["project_code"])["project_code"].alias("code"))
    assert sorted((r.id, r.code) for r in read.collect()) == [(i, [f"C{i}"]) for i in range(n)]


def test_only_asked_parts_are_read(spark):
    df = spark.createDataFrame([(PAGE, True), (None, True), (PAGE, None)], "content string, is_win_bid boolean")
    read = df.select(pages.read_result_page(F.col("content"), F.col("is_win_bid"), ["review", "lots"]).alias("s"))
    assert read.schema["s"].dataType.names == ["review", "lots"]
    first, empty, no_win = [r.s for r in read.collect()]
    assert [x.price_text for x in first.lots] == ["报价:5(元)", None] and first.review == ["张三、李四（采购人代表）"]
    assert empty.review is None and empty.lots == [] and no_win.lots == []
    with pytest.raises(ValueError):
        pages.read_result_page(F.col("content"), F.col("is_win_bid"), ["nothing"])


def test_each_fact_alone_is_the_same_as_among_all(spark):
    void = "<p>二、项目废标的原因</p><p>供应商不足3家</p><p>三、终止说明</p><p>变化</p>"
    df = spark.createDataFrame(
        [(1, PAGE, True), (2, void, False), (3, "<p>三、中标信息</p><p>见附件</p>", True), (4, None, False)],
        "k int, content string, is_win_bid boolean",
    )
    whole = {r.k: r for r in ingest.parse_result_pages(df).collect()}
    for fact in ingest.PAGE_FACTS:
        for r in ingest.parse_result_pages(df, facts=(fact,)).select("k", fact).collect():
            assert r[fact] == whole[r.k][fact], fact


def test_text_work_is_dealt_by_cores(spark, tmp_path):
    rows = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_quantity double"
    spark.createDataFrame([(i, 1, i, i, 0.1, 2.0) for i in range(100)], rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = announcements._line(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == announcements.TEXT_PARTS * spark.sparkContext.defaultParallelism
    assert lines.count() == 100
