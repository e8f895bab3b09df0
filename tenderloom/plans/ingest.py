"""From raw announcement tables to typed notices and a quarantine table.

Inputs are the list rows (one per result announcement) and the detail rows (one
per announcement page).  The job is a chain of frame functions:

list rows → classified → unseen → own detail → linked announcements → parsed
result pages → first usable result → parsed purchase pages → last usable purchase
→ one record per project.

Rows that cannot be used end in the quarantine with a message; none is dropped
silently.  The page text moves through one shuffle per side, keyed by article id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.amounts import parse_amount
from tenderloom.functions.notice_text import (
    BUDGET_TOLERANCE,
    contacts,
    purchase_facts,
    review_experts,
    termination_reason,
    void_reasons,
)
from tenderloom.functions.text import bind, contains_any
from tenderloom.operators.frames import compute_once
from tenderloom.operators.pages import html_lines, page_field_type, read_result_page
from tenderloom.operators.ranking import first_per_group
from tenderloom.operators.tables import save_counted, stored
from tenderloom.plans.page_search import kept_aside, search
from tenderloom.schemas import (
    AMOUNT_NOT_DEAL,
    BUDGET_UNASSIGNED,
    DETAIL_TYPES,
    FIRST_USABLE_MS,
    LOT_SCHEMA,
    NOTICE_SCHEMA,
)

# Path names of the list and what they mean.
PATH_KINDS = {
    "中标公告": "win",
    "中标（成交）结果公告": "win",
    "成交公告": "win",
    "终止公告": "terminated",
    "废标公告": "void",
    "邀请招标资格入围公告": "dropped",
    "公开招标资格入围公告": "dropped",
}

# Titles of result notices that carry no lots.
SKIPPED_TITLES = ("公开征集", "中标候选", "资格审查")
CANDIDATE_TITLE = "中标候选人"

# Words in the type names of linked announcements.
PURCHASE_WORD, SUPERVISION_WORD, RESULT_WORD, OTHER_WORD = "采购", "监", "结果", "其他"

_LOTS = f"array<{LOT_SCHEMA.simpleString()}>"


# --- list rows ---------------------------------------------------------------


def classify_list(raw_list: DataFrame) -> DataFrame:
    """Add ``kind``: win, void, terminated, dropped, or null for an unknown path name."""
    kinds = F.create_map(*[F.lit(x) for kv in PATH_KINDS.items() for x in kv])
    return raw_list.withColumn("kind", F.try_element_at(kinds, F.col("pathName")))


def flatten_list(raw_list: DataFrame) -> DataFrame:
    """Usable list rows under the names of the notice model."""
    kept = classify_list(raw_list).filter(F.col("kind").isin("win", "void", "terminated"))
    return kept.select(
        F.col("articleId").alias("article_id"),
        "title",
        F.col("publishDate").alias("scrape_timestamp"),
        F.col("pathName").alias("announcement_type"),
        "author",
        F.col("districtCode").alias("district_code"),
        F.col("districtName").alias("district_name"),
        F.col("gpCatalogName").alias("catalog"),
        F.col("procurementMethod").alias("procurement_method"),
        F.col("bidOpeningTime").alias("bid_opening_time"),
        (F.col("kind") == "win").alias("is_win_bid"),
        (F.col("kind") == "terminated").alias("is_termination"),
    )


def unknown_paths(raw_list: DataFrame) -> DataFrame:
    """Quarantine rows of list rows whose path name is not known."""
    return quarantine(
        classify_list(raw_list).filter(F.col("kind").isNull()),
        "list row: path name not known",
        F.col("articleId"),
        F.col("publishDate"),
        F.col("pathName"),
    )


def unseen(meta: DataFrame, seen: DataFrame | None, key: str = "article_id") -> DataFrame:
    """Rows whose id is not in the seen table."""
    return meta if seen is None else meta.join(seen.select(key), key, "left_anti")


def registered_ids(notices: DataFrame) -> DataFrame:
    """Every result id a stored notice covers: append these to the seen table."""
    own = F.array_compact(F.array("result_source_article_id"))
    linked = F.coalesce("result_article_id", F.array().cast("array<string>"))
    return notices.select(F.explode(F.array_union(linked, own)).alias("article_id")).distinct()


def latest_time(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("scrape_timestamp").alias("latest_timestamp"))


def notices_per_month(rows: DataFrame) -> DataFrame:
    month = F.date_format(F.timestamp_millis("scrape_timestamp"), "yyyy-M")
    return rows.groupBy(month.alias("month")).agg(F.count("*").alias("count"))


# --- linked announcements ----------------------------------------------------


def resolve_links(
    meta: DataFrame, links: str = "links", now_ms: Column | None = None, key: str = "article_id"
) -> DataFrame:
    """Add the result and purchase ids of a project, its duration and the own position.

    ``link_error`` is set when the links contradict the notice.
    """
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    known = F.array_sort(
        F.transform(
            F.filter(F.col(links), lambda x: x["isExist"]),
            lambda x: F.struct(
                x["order"].alias("order"),
                x["articleId"].alias("id"),
                x["publishDateTime"].alias("time"),
                x["typeName"].alias("type"),
            ),
        )
    )
    with_known = meta.withColumn("_known", known).withColumn(
        "_linked", F.coalesce(F.size(F.col(links)) > 0, F.lit(False))
    )

    def is_purchase(x: Column) -> Column:
        return x["type"].contains(PURCHASE_WORD) & ~x["type"].contains(SUPERVISION_WORD)

    k = F.col("_known")
    result = F.filter(k, lambda x: ~is_purchase(x) & x["type"].contains(RESULT_WORD))
    bought = F.filter(k, is_purchase)
    other = F.filter(
        k,
        lambda x: ~is_purchase(x) & ~x["type"].contains(RESULT_WORD) & x["type"].contains(OTHER_WORD),
    )
    picked = with_known.withColumns(
        {"_result": result, "_purchase": F.when(F.size(bought) > 0, bought).otherwise(other)}
    )

    def ids(c: str) -> Column:
        return F.transform(F.col(c), lambda x: x["id"])

    def times(c: str) -> Column:
        return F.transform(F.col(c), lambda x: x["time"])

    all_times = F.transform(F.col("_known"), lambda x: x["time"])
    duration = F.coalesce(F.array_max(all_times), F.lit(-1)) - F.least(
        now, F.coalesce(F.array_min(all_times), now)
    )
    linked = F.col("_linked")
    none_ids, none_times = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    position = F.array_position(ids("_result"), F.col(key))
    return picked.select(
        *meta.columns,
        F.when(linked, ids("_result")).otherwise(F.array(key)).alias("result_article_id"),
        F.when(linked, times("_result")).otherwise(F.array("scrape_timestamp")).alias("result_publish_date"),
        F.when(linked, ids("_purchase")).otherwise(none_ids).alias("purchase_article_id"),
        F.when(linked, times("_purchase")).otherwise(none_times).alias("purchase_publish_date"),
        F.when(linked, duration).otherwise(F.lit(-1)).cast("bigint").alias("tender_duration"),
        F.when(linked, position).otherwise(F.lit(1)).cast("int").alias("start_position"),
        F.when(linked & (duration < 0), F.lit("links: negative duration"))
        .when(linked & (position == 0), F.lit("links: own result notice is missing"))
        .alias("link_error"),
    )


def skip_reason(title: Column, detail_type: Column) -> Column:
    """``title`` for a notice kept without lots, ``type`` for one to switch away from, else null."""
    wanted = detail_type.isNull() | (detail_type == 0) | detail_type.isin(*DETAIL_TYPES.values())
    return F.when(F.coalesce(contains_any(title, SKIPPED_TITLES), F.lit(False)), F.lit("title")).when(
        ~wanted, F.lit("type")
    )


# --- result pages ------------------------------------------------------------


def _lot_struct(**values: Column) -> Column:
    defaults = {
        "name": F.lit(None),
        "index": F.lit(None),
        "is_win": F.lit(False),
        "budget": F.lit(BUDGET_UNASSIGNED),
        "amount": F.lit(AMOUNT_NOT_DEAL),
        "is_percent": F.lit(False),
        "supplier": F.lit(None),
        "supplier_address": F.lit(None),
        "reason": F.lit(None),
    }
    fields = {**defaults, **values}
    return F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in LOT_SCHEMA])


def priced_lot(raw: Column, amount: Column) -> Column:
    """Raw lot plus its read amount; an amount that is not understood becomes -1."""
    won = raw["is_win"] & amount.isNotNull()
    return _lot_struct(
        name=raw["name"],
        index=raw["index"],
        is_win=raw["is_win"],
        amount=F.when(won & amount["ok"], amount["amount"]).otherwise(F.lit(AMOUNT_NOT_DEAL)),
        is_percent=F.when(won & amount["ok"], amount["is_percent"]).otherwise(F.lit(False)),
        supplier=raw["supplier"],
        supplier_address=raw["supplier_address"],
        reason=raw["reason"],
    )


#: What of a page each fact is read from.
_PARTS_OF_ERROR = ("lots", "lots_error", "void", "termination", "review")
PAGE_FACTS = {
    "page_code": ("project_code",),
    "page_name": ("project_name",),
    "result_lots": ("lots", "void"),
    "shared_reason": ("void",),
    "page_termination": ("termination",),
    "termination_reason": ("termination",),
    "review_expert": ("review",),
    "purchase_representative": ("review",),
    "purchaser": ("contact",),
    "purchasing_agency": ("contact",),
    "page_error": _PARTS_OF_ERROR,
    "state": _PARTS_OF_ERROR,
}


def parse_result_pages(
    pages: DataFrame, content: str = "content", facts: Sequence[str] = tuple(PAGE_FACTS)
) -> DataFrame:
    """Add the typed ``facts`` of result pages (``is_win_bid`` says which form to expect).

    ``state`` is usable, switch (another announcement may have the lots) or error.  What no asked
    fact is read from is not taken from the pages.
    """
    parts = {part for f in facts for part in PAGE_FACTS[f]}
    read = pages.withColumn("_s", read_result_page(F.col(content), F.col("is_win_bid"), parts)).drop(content)
    win = F.col("is_win_bid")

    def part(name: str) -> Column:
        return F.col(f"_s.{name}") if name in parts else F.lit(None).cast(page_field_type(name))

    def text(section: str) -> Column:
        return F.array_join(part(section), "")

    understood = read.withColumns(
        {
            "_void": F.when(~win & part("void").isNotNull(), void_reasons(text("void"))),
            "_end": F.when(~win & part("termination").isNotNull(), termination_reason(part("termination"))),
            "_experts": F.when(part("review").isNotNull(), review_experts(part("review"))),
            "_contact": F.when(part("contact").isNotNull(), contacts(text("contact"))),
        }
    )
    won_lots = F.transform(
        part("lots"), lambda x: bind(F.when(x["is_win"], parse_amount(x["price_text"])), lambda a: priced_lot(x, a))
    )
    void_lots = F.transform(
        F.col("_void.lots"), lambda x: _lot_struct(index=x["index"], reason=x["reason"])
    )
    none = F.array().cast(_LOTS)
    error = F.coalesce(
        F.when(win, part("lots_error")),
        F.when(F.col("_void.error") != "void reason: no lot", F.col("_void.error")),
        F.col("_end.error"),
        F.col("_experts.error"),
    )
    no_lots = F.when(win, F.size(part("lots")) == 0).otherwise(
        F.coalesce(F.col("_void.error") == "void reason: no lot", F.lit(False))
    )
    names = F.array().cast("array<string>")
    typed = {
        "page_code": F.when(part("project_code").isNotNull(), text("project_code")),
        "page_name": F.when(part("project_name").isNotNull(), text("project_name")),
        "result_lots": F.coalesce(F.when(win, won_lots).otherwise(void_lots).cast(_LOTS), none),
        "shared_reason": F.coalesce("_void.shared", F.lit(False)),
        "page_termination": F.col("_end").isNotNull(),
        "termination_reason": F.col("_end.reason"),
        "review_expert": F.coalesce("_experts.experts", names),
        "purchase_representative": F.coalesce("_experts.representatives", names),
        "purchaser": F.col("_contact.purchaser"),
        "purchasing_agency": F.col("_contact.agency"),
        "page_error": error,
        "state": F.when(error.isNotNull(), "error").when(no_lots, "switch").otherwise("usable"),
    }
    kept = [c for c in pages.columns if c != content]
    asked = {name: value for name, value in typed.items() if name in facts}
    return compute_once(understood, asked).select(*kept, *asked)


def parse_purchase_pages(pages: DataFrame, content: str = "content") -> DataFrame:
    """Add the typed facts ``p`` of purchase pages; ``state`` is usable, or switch where they cannot be read."""
    text = F.array_join(html_lines(F.col(content)), "")
    read = pages.withColumn("_page_text", text).drop(content)
    facts = compute_once(read, {"p": purchase_facts(F.col("_page_text"))}).drop("_page_text")
    return facts.withColumn("state", F.when(F.col("p.error").isNull(), "usable").otherwise("switch"))


# --- records -----------------------------------------------------------------


def _merged(purchase_lots: Column, result_lots: Column) -> Column:
    """Result lots with name and budget of the purchase lot of the same index (the first one of several),
    as :func:`tenderloom.plans.lots.merge_lots` does for tables.

    The purchase lots are sorted by index once.  Where they are numbered 1, 2, ... a lot is found by its
    place, else in a map, so the work grows with the lots and not with their pairs.
    """

    def fill(r: Column, p: Column) -> Column:
        values = {f.name: r[f.name] for f in LOT_SCHEMA}
        values["name"] = F.when(p.isNotNull(), p["name"]).otherwise(r["name"])
        values["budget"] = F.when(p.isNotNull(), p["budget"]).otherwise(r["budget"])
        return _lot_struct(**values)

    def numbered(x: Column, i: Column) -> Column:
        return F.struct(x["index"].alias("index"), i.alias("at"), x["name"].alias("name"), x["budget"].alias("budget"))

    def firsts(lots: Column) -> Column:
        return F.filter(lots, lambda x, i: (i == 0) | (F.get(lots, i - 1)["index"] != x["index"]))

    def both(planned: Column) -> Column:
        by_index = F.map_from_entries(F.transform(planned, lambda x: F.struct(x["index"], x)))
        return F.struct(planned.alias("lots"), by_index.alias("by_index"))

    def found(p: Column, r: Column) -> Column:
        here = F.get(p["lots"], r["index"] - 1)
        return F.when(here["index"] == r["index"], here).otherwise(F.try_element_at(p["by_index"], r["index"]))

    indexed = F.filter(F.transform(purchase_lots, numbered), lambda x: x["index"].isNotNull())
    planned = bind(bind(F.array_sort(indexed), firsts), both)
    return bind(planned, lambda p: F.transform(result_lots, lambda r: bind(found(p, r), lambda x: fill(r, x))))


def _planned(purchase_lots: Column, reason: Column | None = None) -> Column:
    """Purchase lots as void lots of the record."""
    return F.transform(
        purchase_lots,
        lambda p: _lot_struct(
            name=p["name"],
            index=p["index"],
            budget=p["budget"],
            reason=F.lit(None) if reason is None else reason,
        ),
    )


def assemble(projects: DataFrame) -> DataFrame:
    """One record per project from its result facts and purchase facts (``p``, null if none).

    Adds ``record_error`` where lots or budgets do not agree.
    """
    p, lots = F.col("p"), F.col("result_lots")
    planned = F.col("p.lots")
    has_plan = p.isNotNull()
    ended = F.col("is_termination")
    special = F.coalesce(F.col("p.without_lots"), F.lit(False))
    merge = has_plan & ~ended & ~special
    shared = F.col("shared_reason")
    last = F.coalesce(F.array_max(F.transform(lots, lambda x: x["index"])), F.lit(0))
    bid_items = (
        F.when(has_plan & ended, _planned(planned))
        .when(merge & shared, _planned(planned, F.get(lots, F.lit(0))["reason"]))
        .when(merge, _merged(planned, lots))
        .otherwise(lots)
    )
    with_items = projects.withColumns(
        {
            "bid_items": F.when(F.col("without_items"), F.array().cast(_LOTS)).otherwise(bid_items.cast(_LOTS)),
            "_count_error": F.when(
                merge & ~shared & (F.size(planned) != last), F.lit("record: number of lots differs")
            ),
        }
    )
    once = F.array_distinct(
        F.transform(F.col("bid_items"), lambda x: F.struct(x["index"].alias("i"), x["budget"].alias("b")))
    )
    # A lot without a readable budget or price carries -1, which is no money; without any budget the
    # whole is unassigned.
    unknown = (F.size(once) > 0) & ~F.exists(once, lambda x: x["b"] >= 0)
    computed = F.when(unknown, F.lit(BUDGET_UNASSIGNED)).otherwise(
        F.aggregate(once, F.lit(0.0), lambda acc, x: acc + F.greatest(x["b"], F.lit(0.0)))
    )
    declared = F.nullif(F.col("p.total_budget"), F.lit(0.0))
    with_budget = with_items.withColumns(
        {
            "_computed": computed,
            "_declared": declared,
            "total_budget": F.when(F.col("without_items"), F.lit(BUDGET_UNASSIGNED))
            .when(special, F.col("p.total_budget"))
            .otherwise(computed),
        }
    )
    base = F.greatest(F.col("total_budget"), F.lit(0.0))
    amount = F.aggregate(
        F.filter(F.col("bid_items"), lambda x: x["is_win"]),
        F.lit(0.0),
        lambda acc, x: acc
        + F.greatest(F.when(x["is_percent"], base * x["amount"] * 0.01).otherwise(x["amount"]), F.lit(0.0)),
    )
    budget_error = (~special) & (F.abs(F.col("_declared") - F.col("_computed")) > BUDGET_TOLERANCE)
    no_place = F.col("district_code").isNull() | (F.col("district_code") == "")
    lines_error = F.coalesce(
        F.col("page_error"),
        F.col("_count_error"),
        F.when(no_place, F.lit("record: no district code")),
        F.when(budget_error, F.lit("record: declared budget differs from lots")),
    )
    return with_budget.withColumns(
        {
            "total_amount": F.when(F.col("without_items"), F.lit(-1.0))
            .when(F.col("is_win_bid"), amount)
            .otherwise(F.lit(0.0)),
            "record_error": F.when(~F.col("without_items"), lines_error),
            "project_code": F.coalesce("p.project_code", "project_code"),
            "project_name": F.coalesce("p.project_name", "project_name"),
        }
    )


# --- quarantine and reports --------------------------------------------------


def quarantine(
    rows: DataFrame, message: Column | str, article_id: Column, timestamp: Column, content: Column
) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(
        text.alias("message"),
        article_id.alias("article_id"),
        timestamp.cast("bigint").alias("timestamp"),
        content.cast("string").alias("content"),
    )


def error_report(errors: DataFrame) -> DataFrame:
    return errors.groupBy("message").agg(F.count("*").alias("count"))


def completeness(df: DataFrame, required: list[str]) -> DataFrame:
    """Null count per required column; a column that is not there counts as null in every row."""
    counts = [
        (F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias(c) for c in required
    ]
    one = df.agg(*counts)
    return one.unpivot([], required, "column", "missing")


def missing_fields(df: DataFrame, present: str, required: list[str]) -> DataFrame:
    """Required keys that a record's key array lacks; complete records drop out."""
    wanted = F.array(*[F.lit(c) for c in required])
    return df.withColumn("missing", F.array_sort(F.array_except(wanted, F.col(present)))).filter(
        F.size("missing") > 0
    )


COUNTERS = "name string, n long"


def run_counters(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(name, n) of the counters a run has gathered while writing; those that counted nothing drop out."""
    always = ("planned", "actual", "remaining")
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n or k in always], COUNTERS)


def write_fresh(raw_list: DataFrame, seen: DataFrame | None, path: str) -> dict[str, int]:
    """Write the listed announcements that are not seen yet, and count all of them by what becomes of them.

    "planned" are the listed rows, "actual" those not seen, "remaining" the difference; the fresh ones
    are "sent" on, "dropped" for their kind, or an "error" for an unknown one.
    """
    rows = classify_list(raw_list)
    if seen is None:
        rows = rows.withColumn("_fresh", F.lit(True))
    else:
        known = seen.select(F.col("article_id").alias("_known")).distinct()
        rows = rows.join(known, F.col("articleId") == F.col("_known"), "left")
        rows = rows.withColumn("_fresh", F.col("_known").isNull()).drop("_known")
    fresh, kind = F.col("_fresh"), F.col("kind")
    counts = save_counted(
        rows,
        path,
        {
            "planned": F.count("*"),
            "actual": F.count_if(fresh),
            "error": F.count_if(fresh & kind.isNull()),
            "dropped": F.count_if(fresh & (kind == "dropped")),
            "sent": F.count_if(fresh & kind.isNotNull() & (kind != "dropped")),
        },
        keep=fresh,
    )
    return counts | {"remaining": counts["planned"] - counts["actual"]}


def retry_list(errors: DataFrame, old: DataFrame) -> DataFrame:
    """(article_id, is_win, message) of errors that are not in the old list yet."""
    keys = ["article_id", "is_win", "message"]
    fresh = errors.select(*keys).distinct()
    same = [fresh[k].eqNullSafe(old[k]) for k in keys]
    return fresh.join(old, same[0] & same[1] & same[2], "left_anti")


# --- the job -----------------------------------------------------------------


def detail_heads(raw_detail: DataFrame) -> DataFrame:
    """The newest detail row of each article without its page; of equal times the least hash of the content.

    ``_time`` and ``_hash`` lead back to the row with the page.
    """
    small = [c for c in raw_detail.columns if c not in ("articleId", "content")]
    keyed = raw_detail.select("articleId", *small, *_row_keys(raw_detail))
    best = keyed.groupBy("articleId").agg(F.min(F.struct("_time", "_hash", *small)).alias("d"))
    return best.filter(F.col("articleId").isNotNull()).select(F.col("articleId").alias("article_id"), "d.*")


def _row_keys(raw_detail: DataFrame) -> list[Column]:
    return [(-F.coalesce("publishDate", F.lit(0))).alias("_time"), F.xxhash64(*raw_detail.columns).alias("_hash")]


def pages_of(raw_detail: DataFrame, heads: DataFrame, asked: DataFrame) -> DataFrame:
    """(article_id, form, content) of the newest pages of the asked articles; rows that are equal in all
    columns may repeat.  Where few are asked for, Spark broadcasts them and moves no page."""
    wanted = asked.join(heads.select("article_id", "_time", "_hash"), "article_id")
    rows = raw_detail.select(F.col("articleId").alias("article_id"), *_row_keys(raw_detail), "content")
    return rows.join(wanted, ["article_id", "_time", "_hash"]).select("article_id", "form", "content")


def one_per_project(linked: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` with ``_covered``: whether an earlier announcement of the project is stored in this run.

    All announcements of a project carry the same links, so the least linked id names it.  The first
    one in its project whose record has no error is stored and covers those behind it; those in front
    of it, and all of a project without a good record, keep their errors."""
    placed = linked.select(
        "article_id",
        F.coalesce(F.array_min("result_article_id"), F.col("article_id")).alias("_project"),
        F.struct("start_position", "scrape_timestamp", "article_id").alias("_place"),
    )
    tried = records.select("article_id", F.col("record_error").isNull().alias("_good"))
    rows = placed.join(tried, "article_id")
    lead = rows.filter("_good").groupBy("_project").agg(F.min("_place").alias("_lead"))
    covered = rows.join(lead, "_project").filter(F.col("_place") > F.col("_lead")).select("article_id")
    marked = records.join(covered.withColumn("_covered", F.lit(True)), "article_id", "left")
    return marked.withColumn("_covered", F.coalesce("_covered", F.lit(False)))


@dataclass(frozen=True)
class Ingested:
    """``pages``: (project, side, rank, article_id, outcome) of every candidate page of the listed projects."""

    notices: DataFrame
    quarantine: DataFrame
    statuses: DataFrame
    pages: DataFrame


def ingest(
    raw_list: DataFrame,
    raw_detail: DataFrame,
    seen: DataFrame | None = None,
    excluded: DataFrame | None = None,
    now_ms: Column | None = None,
    first_purchase_ms: int = FIRST_USABLE_MS,
    only_fresh: bool = False,
) -> Ingested:
    """Typed notices of the unseen list rows, with quarantine and per-row status.

    Statuses are "stored", "error" (in the quarantine), "covered" (another announcement of the
    project was stored in this run) and "candidates" (an error of a notice that only lists winning
    candidates).  Purchase pages published before ``first_purchase_ms`` are not read, because their
    layout differs; a project whose purchase pages are all older is stored without one.  With
    ``only_fresh`` the list holds no seen rows (``seen`` is then used for linked announcements alone).

    What is read several times is written once to the shared folder: detail heads, linked projects, the
    facts of the pages and the finished records.  Each page that is needed is parsed once.
    """
    listed = unseen(unseen(flatten_list(raw_list), None if only_fresh else seen), excluded)
    rest = [c for c in listed.columns if c != "article_id"]
    meta = first_per_group(listed, ["article_id"], [F.col(c) for c in rest], rest)
    heads = stored(detail_heads(raw_detail), "detail-heads")
    newest = heads.select(
        "article_id",
        F.col("title").alias("detail_title"),
        F.col("projectCode").alias("project_code"),
        F.col("projectName").alias("project_name"),
        F.col("districtCode").alias("detail_district"),
        F.col("announcementLinkDtoList").alias("links"),
        F.lit(True).alias("has_detail"),
    )
    own = resolve_links(meta.join(newest, "article_id", "left"), now_ms=now_ms)
    early = F.when(F.col("has_detail").isNull(), F.lit("detail: no data")).otherwise(F.col("link_error"))
    linked = stored(own.withColumn("early_error", early).drop("links", "has_detail", "link_error"), "linked")

    # Every announcement is assembled: which one stands for its project shows only when its pages are read.
    usable = linked.filter(F.col("early_error").isNull()).drop("early_error")
    projects, results = _choose_result(usable, raw_detail, heads, seen)
    projects = stored(projects, "projects")
    purchases, bought = _choose_purchase(projects, raw_detail, heads, first_purchase_ms)
    assembled = stored(assemble(projects.join(purchases, "article_id", "left")), "assembled")
    marked = one_per_project(usable, assembled)
    covered = marked.filter("_covered").select("article_id")
    records = marked.filter("NOT _covered").drop("_covered")

    # Errors of notices that only list winning candidates are not worth a second look.
    listed_candidates = F.coalesce(F.col("title").contains(CANDIDATE_TITLE), F.lit(False))

    def errors(df: DataFrame, error: str, content: Column) -> DataFrame:
        rows = df.filter(F.col(error).isNotNull() & ~listed_candidates)
        return quarantine(rows, F.col(error), F.col("article_id"), F.col("scrape_timestamp"), content)

    rejected = (
        unknown_paths(raw_list)
        .unionByName(errors(linked, "early_error", F.col("title")))
        .unionByName(errors(records, "record_error", F.to_json("bid_items")))
    )
    notices = records.filter(F.col("record_error").isNull()).select(*[_notice_column(f) for f in NOTICE_SCHEMA])

    def passed_over(df: DataFrame, error: str) -> DataFrame:
        return df.filter(F.col(error).isNotNull() & listed_candidates).select("article_id")

    statuses = records.filter(F.col("record_error").isNull()).select("article_id", F.lit("stored").alias("status"))
    for rows, status in (
        (rejected.select("article_id"), "error"),
        (covered, "covered"),
        (passed_over(linked, "early_error").unionByName(passed_over(records, "record_error")), "candidates"),
    ):
        statuses = statuses.unionByName(rows.withColumn("status", F.lit(status)))
    pages = results.withColumn("side", F.lit("result")).unionByName(bought.withColumn("side", F.lit("purchase")))
    return Ingested(notices, rejected, statuses, pages)


STATUSES = ("stored", "error", "covered", "candidates")


def run(
    raw_list: DataFrame, raw_detail: DataFrame, folder: str, seen: DataFrame | None = None, **options
) -> dict[str, int]:
    """A whole run: writes ``list``, ``notices``, ``quarantine``, ``statuses`` and ``seen`` (the ids to
    register) under ``folder`` and returns its counters, all taken while those tables are written."""
    spark = raw_list.sparkSession
    counts = write_fresh(raw_list, seen, f"{folder}/list")
    listed = spark.read.parquet(f"{folder}/list").select(raw_list.columns)
    done = ingest(listed, raw_detail, seen, only_fresh=True, **options)
    counts |= save_counted(done.notices, f"{folder}/notices", {"notices": F.count("*")})
    counts |= save_counted(done.quarantine, f"{folder}/quarantine", {"quarantined": F.count("*")})
    status = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    # The errors of all steps replace those of the list alone.
    counts |= save_counted(done.statuses, f"{folder}/statuses", status)
    registered_ids(spark.read.parquet(f"{folder}/notices")).write.mode("overwrite").parquet(f"{folder}/seen")
    return counts


def _notice_column(field) -> Column:
    return F.col(field.name).cast(field.dataType.simpleString()).alias(field.name)


def _known(skip: Column, here: Column) -> Column:
    """What a candidate's list entry tells: no page, a title that ends the search, a type to pass over."""
    return (
        F.when(~F.coalesce(here, F.lit(False)), "missing").when(skip == "title", "without_items").when(skip == "type", "type")
    )


def _choose_result(
    projects: DataFrame, raw_detail: DataFrame, heads: DataFrame, seen: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Every project with its first usable result page: the own one, then the others in order; and the
    outcome of each candidate page.

    Pages of announcements already stored are passed over.  A page that does not
    parse stops the search with an error; a skipped title stops it without lots.
    """
    ids = projects.select(
        F.col("article_id").alias("project"),
        F.col("is_win_bid").alias("form"),
        F.posexplode("result_article_id").alias("pos", "article_id"),
        (F.col("start_position") - 1).alias("_own"),
    ).withColumn("rank", F.when(F.col("pos") == F.col("_own"), -1).otherwise(F.col("pos")))
    if seen is not None:
        old = seen.select("article_id", F.lit(True).alias("_seen")).distinct()
        ids = ids.join(old, "article_id", "left")
    head = heads.select("article_id", F.col("title").alias("page_title"), "announcementType", F.lit(True).alias("_here"))
    known = _known(skip_reason(F.col("page_title"), F.col("announcementType")), F.col("_here"))
    if seen is not None:
        known = F.when(F.col("_seen"), "seen").otherwise(known)
    done = search(
        ids.join(head, "article_id", "left").withColumn("known", known),
        lambda asked: pages_of(raw_detail, heads, asked),
        lambda pages: parse_result_pages(pages.withColumn("is_win_bid", F.col("form"))).drop("is_win_bid"),
        kept_aside,
    )
    chosen = done.chosen.select(
        F.col("project"), F.col("article_id").alias("source_id"), "form", F.col("state").alias("chosen_state")
    )
    best = (
        chosen.join(done.facts.withColumnRenamed("article_id", "source_id").drop("state"), ["source_id", "form"], "left")
        .join(head.select(F.col("article_id").alias("source_id"), "page_title"), "source_id", "left")
        .drop("form")
    )
    joined = projects.join(best.withColumnRenamed("project", "article_id"), "article_id", "left")
    without = F.col("source_id").isNull() | (F.col("chosen_state") == "without_items")
    own_page = F.col("source_id") == F.col("article_id")
    none_lots, none_names = F.array().cast(_LOTS), F.array().cast("array<string>")

    def keep(name: str) -> Column:
        return F.when(~without, F.col(name)).alias(name)

    found = joined.select(
        "article_id",
        F.coalesce("source_id", "article_id").alias("result_source_article_id"),
        F.when(own_page & F.col("title").isNotNull(), F.col("title"))
        .otherwise(F.coalesce("page_title", "title"))
        .alias("title"),
        "scrape_timestamp",
        F.coalesce(F.nullif(keep("page_name"), F.lit("")), "project_name").alias("project_name"),
        F.coalesce(F.nullif(keep("page_code"), F.lit("")), "project_code").alias("project_code"),
        F.coalesce("district_code", "detail_district").alias("district_code"),
        "district_name",
        "author",
        "catalog",
        "procurement_method",
        "bid_opening_time",
        "is_win_bid",
        "result_article_id",
        "result_publish_date",
        "purchase_article_id",
        "purchase_publish_date",
        "tender_duration",
        (F.col("is_termination") | F.coalesce(keep("page_termination"), F.lit(False))).alias("is_termination"),
        keep("termination_reason"),
        F.coalesce(keep("review_expert"), none_names).alias("review_expert"),
        F.coalesce(keep("purchase_representative"), none_names).alias("purchase_representative"),
        keep("purchaser"),
        keep("purchasing_agency"),
        F.coalesce(keep("result_lots"), none_lots).alias("result_lots"),
        F.coalesce(keep("shared_reason"), F.lit(False)).alias("shared_reason"),
        F.when(~without, F.col("page_error")).alias("page_error"),
        without.alias("without_items"),
    )
    return found, done.outcomes


def _choose_purchase(
    projects: DataFrame, raw_detail: DataFrame, heads: DataFrame, first_ms: int
) -> tuple[DataFrame, DataFrame]:
    """(article_id, purchase source, title, facts ``p``) of the last usable purchase page, and the outcome
    of each candidate page.  Pages before ``first_ms`` and pages that cannot be read are passed over."""
    ids = projects.filter(~F.col("without_items")).select(
        F.col("article_id").alias("project"),
        F.lit(True).alias("form"),
        F.posexplode("purchase_article_id").alias("pos", "article_id"),
    )
    head = heads.select("article_id", F.col("title").alias("purchase_title"), "publishDate", F.lit(True).alias("_here"))
    dated = F.coalesce(F.col("publishDate") >= first_ms, F.lit(False))
    done = search(
        ids.join(head, "article_id", "left").withColumns(
            {
                "rank": -F.col("pos"),
                "known": F.when(F.col("_here").isNull(), "missing").when(~dated, "old"),
            }
        ),
        lambda asked: pages_of(raw_detail, heads, asked),
        parse_purchase_pages,
        kept_aside,
    )
    best = done.chosen.join(done.facts.select("article_id", "p"), "article_id").join(
        head.select("article_id", "purchase_title"), "article_id", "left"
    )
    found = best.select(
        F.col("project").alias("article_id"),
        F.col("article_id").alias("purchase_source_article_id"),
        "purchase_title",
        "p",
    )
    return found, done.outcomes
