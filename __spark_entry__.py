"""Registered queries: ``entry``, ``queries`` and ``oracle_sql``.

Every query reads the given tables in full.  The star-schema tables are mapped to
notices, lots and districts by ``tenderloom.sources.fixtures``.
"""

from __future__ import annotations

import os
import sys
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from tenderloom.functions import calendar, labels, notice_text, text  # noqa: E402
from tenderloom.functions.amounts import parse_amount  # noqa: E402
from tenderloom.operators import frames, pages, tables  # noqa: E402
from tenderloom.operators.keyed_store import KeyedStore  # noqa: E402
from tenderloom.plans import districts as D  # noqa: E402
from tenderloom.plans import ingest as I  # noqa: E402
from tenderloom.plans import lots as L  # noqa: E402
from tenderloom.plans import page_search  # noqa: E402
from tenderloom.plans import reports as R  # noqa: E402
from tenderloom.plans import serving as S  # noqa: E402
from tenderloom.session import checkpoint_root, use_engine_settings  # noqa: E402
from tenderloom.sources import announcements as A  # noqa: E402
from tenderloom.sources import fixtures as X  # noqa: E402
from tenderloom.sources import notices as N  # noqa: E402
from tenderloom.sources.sinks import for_each_batch, save_json_by_month, save_notices  # noqa: E402
from tenderloom.streaming import incremental as Z  # noqa: E402

# The operators for training data and their pipeline are optional; nothing else depends on them.
try:
    import corpus_pipeline
    from tenderloom.llm import queries as llm
except ImportError as missing:
    if missing.name not in ("corpus_pipeline", "tenderloom.llm"):
        warnings.warn(f"training-data queries are left out: {missing}", stacklevel=2)
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

YEAR = ("year",)
PROVINCE = ("province",)
DISTRICT = ("district",)
SUPPLIER = "Supplier#000000001"
CITY = 450100


def entry(spark: SparkSession) -> DataFrame:
    """Won volume per district and period: the flagship cube."""
    return queries()["volume_cube"](spark, "/root/testdata/sf0.001")


def run_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/runs/{uuid.uuid4().hex}"


def _on_notices(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(X.notices(spark, sf))


def _on_lots(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(X.notice_lots(spark, sf))


def _on_districts(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(X.districts(spark, sf))


def _reports() -> dict[str, Query]:
    def report_set(n: DataFrame) -> DataFrame:
        """The reports that share one pass over the notices, stacked by column name."""
        cells = tables.stored(R.joint_cells(n), "joint-cells")
        named = [df.withColumn("report", F.lit(name)) for name, df in R.joint_reports(cells).items()]
        return frames.union_frames(named, allow_missing=True)

    def count_set(n: DataFrame) -> DataFrame:
        cells = tables.stored(R.name_cells(n), "name-cells")
        named = [df.withColumn("report", F.lit(name)) for name, df in R.name_reports(cells).items()]
        return frames.union_frames(named, allow_missing=True)

    return {
        "report_set": _on_notices(report_set),
        "count_set": _on_notices(count_set),
        "outcome_counts_cube": _on_notices(R.outcome_counts),
        "win_counts_cube": _on_notices(R.win_counts),
        "lose_counts_cube": _on_notices(R.lose_counts),
        "terminate_counts_cube": _on_notices(R.terminate_counts),
        "budget_situation_cube": _on_notices(R.budget_situation),
        "district_level_row": _on_notices(R.district_levels),
        "volume_cube": _on_notices(R.volumes),
        "method_cube": _on_notices(R.method_counts),
        "catalog_counts": _on_notices(R.catalog_counts),
        "agency_counts": _on_notices(R.agency_counts),
        "agency_top_catalog": _on_notices(R.agency_top_catalog),
        "purchaser_cube": _on_notices(R.purchaser_counts),
        "purchaser_catalog": _on_notices(R.purchaser_catalogs),
        "purchaser_agency": _on_notices(R.purchaser_agencies),
        "supplier_cube": _on_lots(R.supplier_counts),
        "supplier_volume_cube": _on_lots(R.supplier_volumes),
        "supplier_catalog": _on_lots(R.supplier_catalogs),
        "supplier_address": _on_lots(R.supplier_addresses),
        "value_frequencies": _on_notices(R.value_frequencies),
        "amount_summary": _on_notices(R.amount_summary),
        "top3_catalog": _on_notices(R.top_catalogs_of_purchaser),
        "top3_agency": _on_notices(R.top_agencies_of_purchaser),
    }


def _serving() -> dict[str, Query]:
    def basic_situation(spark: SparkSession, sf: str) -> DataFrame:
        n = X.notices(spark, sf)
        return S.basic_situation(
            n,
            R.outcome_counts(n, YEAR, PROVINCE),
            R.volumes(n, YEAR, PROVINCE),
            R.supplier_addresses(X.lots(spark, sf)),
        )

    def quarter_series(spark: SparkSession, sf: str) -> DataFrame:
        n = X.notices(spark, sf)
        quarter = ("quarter",)
        return S.quarter_series(R.outcome_counts(n, quarter, PROVINCE), R.volumes(n, quarter, PROVINCE))

    def notices_page(spark: SparkSession, sf: str, **period: int) -> DataFrame:
        rows = X.notices(spark, sf).select(
            "id", "scrape_timestamp", "district_code", "catalog", "purchaser", "total_amount"
        )
        return S.notices_page(rows, page_no=2, page_size=20, **period)

    def with_places(fn: Callable[[DataFrame, DataFrame], DataFrame], grain: str) -> Query:
        return lambda spark, sf: fn(
            R.volumes(X.notices(spark, sf), (grain,), DISTRICT), X.districts(spark, sf)
        )

    def outcome_label(n: DataFrame) -> DataFrame:
        code = labels.outcome_code(F.col("is_win_bid"), F.col("is_termination"))
        return R.count_by(n.select(code.alias("code")), "code").select(
            "code", labels.outcome_name(F.col("code")).alias("name"), "count"
        )

    def no_data_label(n: DataFrame) -> DataFrame:
        shown = labels.number_or(F.col("total_budget"))
        return n.select(
            "id",
            F.when(shown == labels.NO_DATA, shown).otherwise("has").alias("budget_text"),
            labels.text_or(F.col("purchasing_agency"), labels.EMPTY).alias("agency_text"),
        )

    def axis_labels(n: DataFrame) -> DataFrame:
        label = labels.axis_label(F.col("month"), F.col("day"), F.col("quarter"))
        return R.volumes(n, scopes=PROVINCE).select("year", label.alias("label"), "transactions_volume")

    return {
        "basic_situation": basic_situation,
        "quarter_series": quarter_series,
        "scale_by_grain": _on_notices(
            lambda n: S.scale_by_grain(R.volumes(n, scopes=PROVINCE), (1996, 1997, 1998))
        ),
        "scale_by_grain_all": _on_notices(lambda n: S.scale_by_grain(R.volumes(n, scopes=PROVINCE))),
        "notices_page": lambda spark, sf: notices_page(spark, sf, year=1997, quarter=2),
        "notices_page_all": notices_page,
        "notices_total_all": _on_notices(S.notices_total),
        "notices_total": _on_notices(lambda n: S.notices_total(n, district=CITY, year=1997, month=2)),
        "level_rows": _on_notices(lambda n: S.level_rows(R.district_levels(n))),
        "outcomes_by_year": _on_notices(lambda n: S.outcomes_by_year(R.outcome_counts(n, YEAR, PROVINCE))),
        "method_by_year": _on_notices(lambda n: S.method_by_year(R.method_counts(n, YEAR, PROVINCE))),
        "city_volume_by_year": with_places(S.city_volume_by_year, "year"),
        "child_volume_by_year": with_places(lambda v, d: S.child_volume_by_year(v, d, CITY), "year"),
        "city_growth": with_places(S.city_growth, "month"),
        "city_rank": with_places(lambda v, d: S.city_rank(S.city_volume_by_year(v, d)), "year"),
        "unknown_district_codes": lambda spark, sf: D.unknown_codes(
            R.volumes(X.notices(spark, sf)), X.districts(spark, sf)
        ),
        "district_tree": _on_districts(lambda d: D.district_tree(d, 450000)),
        "districts_by_type": _on_districts(lambda d: D.districts_by_type(d, 3)),
        "districts_all": _on_districts(D.all_districts),
        "cities": _on_districts(D.cities),
        "supplier_page": lambda spark, sf: S.supplier_page(R.supplier_addresses(X.lots(spark, sf)), 2, 20),
        "supplier_catalogs_of": _on_lots(lambda x: S.supplier_catalogs_of(R.supplier_catalogs(x), SUPPLIER)),
        "supplier_detail": _on_lots(lambda x: S.supplier_detail(x, SUPPLIER)),
        "yearly_from_months": _on_notices(
            lambda n: S.yearly_from_months(R.volumes(n, ("month",), PROVINCE))
        ),
        "outcome_label": _on_notices(outcome_label),
        "amount_text": _on_notices(
            lambda n: n.select("id", labels.amount_text(F.col("total_amount")).alias("amount_text"))
        ),
        "no_data_label": _on_notices(no_data_label),
        "axis_labels": _on_notices(axis_labels),
    }


LINE = ("l_orderkey", "l_linenumber")


def _ingest() -> dict[str, Query]:
    def on(source: Callable[[SparkSession, str], DataFrame], fn: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf: fn(source(spark, sf))

    def error_report(spark: SparkSession, sf: str) -> DataFrame:
        return I.error_report(
            I.unknown_paths(A.raw_list(spark, sf)).unionByName(N.corrupt_notices(A.notice_values(spark, sf)))
        )

    def resolved(spark: SparkSession, sf: str) -> DataFrame:
        # "Now" is fixed well after the data so that the result does not depend on the day.
        return I.resolve_links(A.linked_notices(spark, sf), now_ms=F.lit(4102444800000))

    def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
        return resolved(spark, sf).select(
            "article_id",
            F.array_join("result_article_id", ",").alias("results"),
            F.array_join("purchase_article_id", ",").alias("purchases"),
            F.get("purchase_publish_date", F.lit(0)).alias("purchase_time"),
            "tender_duration",
            "start_position",
            "link_error",
        )

    def registered_ids(spark: SparkSession, sf: str) -> DataFrame:
        return I.registered_ids(
            resolved(spark, sf).select(F.col("article_id").alias("result_source_article_id"), "result_article_id")
        )

    def removed_ids(spark: SparkSession, sf: str) -> DataFrame:
        gone = I.unknown_paths(A.raw_list(spark, sf)).select("article_id")
        return tables.without_keys(A.seen_ids(spark, sf), gone, "article_id")

    def amount_of_text(df: DataFrame) -> DataFrame:
        return df.select(*LINE, parse_amount(F.col("amount_text")).alias("r")).select(*LINE, "r.*")

    def html_lines(spark: SparkSession, sf: str) -> DataFrame:
        lines = X.table(spark, sf, "pages").select("page_id", pages.html_lines(F.col("html")).alias("lines"))
        flat = lines.select("page_id", F.explode("lines").alias("line"))
        return flat.groupBy("page_id").agg(
            F.count("*").alias("lines"),
            F.sum(F.length("line")).alias("chars"),
            F.min("line").alias("first_line"),
            F.max("line").alias("last_line"),
        )

    def url_parameter(spark: SparkSession, sf: str) -> DataFrame:
        url = F.col("url")
        return X.table(spark, sf, "pages").select(
            "page_id",
            text.url_param(url, "page").alias("page"),
            text.url_param(url, "utm_source").alias("utm_source"),
        )

    def article_id_of_url(spark: SparkSession, sf: str) -> DataFrame:
        raw = F.concat(F.lit("R+/"), F.col("o_orderkey").cast("string"), F.lit("=="))
        url = F.concat(F.lit("https://notices.example.org/detail?site=1&articleId="), F.url_encode(raw))
        orders = X.table(spark, sf, "orders").select("o_orderkey", url.alias("url"))
        return orders.select("o_orderkey", text.article_id(F.col("url")).alias("article_id"))

    def page_sections(df: DataFrame) -> DataFrame:
        read = df.select(*LINE, pages.read_result_page(F.col("content"), F.col("is_win_bid"), pages.SECTIONS).alias("s"))
        rows = F.array(
            *[F.struct(F.lit(n).alias("section"), F.col(f"s.{n}").alias("content")) for n in pages.SECTIONS]
        )
        long = read.select(*LINE, F.inline(rows)).filter(F.col("content").isNotNull())
        return long.select(
            *LINE, "section", F.size("content").alias("lines"), F.array_join("content", "").alias("text")
        )

    def result_lots(df: DataFrame) -> DataFrame:
        # inline_outer: the plain form repeats the parsing in a filter on the array's size.
        lots = I.parse_result_pages(df, facts=("result_lots",)).select("l_orderkey", F.inline_outer("result_lots"))
        return lots.filter(F.col("index").isNotNull()).select(
            "l_orderkey", "index", "is_win", "name", "amount", "is_percent", "supplier", "supplier_address", "reason"
        )

    def result_facts(df: DataFrame) -> DataFrame:
        facts = ("page_code", "page_name", "review_expert", "purchase_representative", "purchaser", "purchasing_agency", "state")
        return I.parse_result_pages(df, facts=facts).select(
            *LINE,
            "page_code",
            "page_name",
            F.array_join("review_expert", "|").alias("experts"),
            F.array_join("purchase_representative", "|").alias("representatives"),
            "purchaser",
            "purchasing_agency",
            "state",
        )

    def void_reasons(df: DataFrame) -> DataFrame:
        read = df.select(*LINE, notice_text.void_reasons(F.col("reason_text")).alias("v"))
        lots = read.select(*LINE, F.inline_outer("v.lots"), F.col("v.shared").alias("shared"))
        return lots.filter(F.col("index").isNotNull())

    def termination_reason(df: DataFrame) -> DataFrame:
        return df.select(*LINE, notice_text.termination_reason(F.col("lines")).alias("t")).select(*LINE, "t.*")

    def review_experts(df: DataFrame) -> DataFrame:
        read = df.select(*LINE, notice_text.review_experts(F.col("lines")).alias("e")).select(*LINE, "e.*")
        fine = F.col("error").isNull()
        return read.select(
            *LINE,
            *[F.when(fine, F.array_join(c, "|")).alias(c) for c in ("experts", "representatives")],
            "error",
        )

    def contacts(df: DataFrame) -> DataFrame:
        return df.select(*LINE, notice_text.contacts(F.col("contact_text")).alias("c")).select(*LINE, "c.*")

    def purchase_facts(df: DataFrame) -> DataFrame:
        read = df.select("l_linenumber", notice_text.purchase_facts(F.col("page_text")).alias("p"))
        return read.select(
            "l_linenumber",
            *[F.col(f"p.{c}").alias(c) for c in ("project_code", "project_name", "total_budget", "without_lots", "error")],
            F.inline_outer("p.lots"),
        )

    def merge_lots(spark: SparkSession, sf: str) -> DataFrame:
        result = X.lots(spark, sf).withColumns(
            {"name": F.lit(None).cast("string"), "budget": F.lit(-1.0)}
        )
        merged = L.merge_lots(A.lot_plan(spark, sf), result)
        return merged.select("id", "index", "name", "budget", "amount", "supplier")

    def missing_fields(n: DataFrame) -> DataFrame:
        required = ["procurement_method", "purchaser", "purchasing_agency", "project_code"]
        values = n.select("id", F.to_json(F.struct(*required[:3])).alias("doc"))
        keyed = values.select("id", F.json_object_keys("doc").alias("present"))
        return I.missing_fields(keyed, "present", required).select("id", F.array_join("missing", ",").alias("missing"))

    def run_counters(spark: SparkSession, sf: str) -> DataFrame:
        counts = I.write_fresh(A.raw_list(spark, sf), A.seen_ids(spark, sf), f"{run_folder(spark)}/list")
        return I.run_counters(spark, counts)

    def district_documents(df: DataFrame) -> DataFrame:
        return D.flatten_district_json(df)

    def retry_list(df: DataFrame) -> DataFrame:
        return I.retry_list(df.filter("year >= 1996"), df.filter("year < 1996").drop("year").distinct())

    def job(spark: SparkSession, sf: str) -> I.Ingested:
        return I.ingest(
            A.raw_list(spark, sf), A.raw_detail(spark, sf), A.seen_ids(spark, sf), now_ms=F.lit(4102444800000)
        )

    def ingested_notices(spark: SparkSession, sf: str) -> DataFrame:
        return job(spark, sf).notices.select(
            "result_source_article_id",
            "purchase_source_article_id",
            "project_code",
            "is_win_bid",
            "is_termination",
            "total_budget",
            "total_amount",
            F.size("bid_items").alias("lots"),
            F.array_join(F.transform("bid_items", lambda x: F.coalesce(x["name"], F.lit("-"))), ",").alias("names"),
            "purchaser",
            "termination_reason",
            "tender_duration",
        )

    def ingest_errors(spark: SparkSession, sf: str) -> DataFrame:
        return I.error_report(job(spark, sf).quarantine)

    def search_job(spark: SparkSession, sf: str) -> I.Ingested:
        # Raw tables are stored ones: every round of the search reads pages from them.
        raw = tables.stored(A.searched_list(spark, sf), "raw-list"), tables.stored(A.searched_detail(spark, sf), "raw-detail")
        return I.ingest(*raw, now_ms=F.lit(4102444800000))

    def searched_notices(spark: SparkSession, sf: str) -> DataFrame:
        return search_job(spark, sf).notices.select(
            "result_source_article_id",
            "purchase_source_article_id",
            "total_budget",
            "total_amount",
            F.size("bid_items").alias("lots"),
            F.size("result_article_id").alias("results"),
        )

    def page_outcomes(spark: SparkSession, sf: str) -> DataFrame:
        return search_job(spark, sf).pages.groupBy("side", "outcome").agg(F.count("*").alias("pages"))

    return {
        "ingested_notices": ingested_notices,
        "searched_notices": searched_notices,
        "page_outcomes": page_outcomes,
        "ingest_errors": ingest_errors,
        "classify_list": on(
            A.raw_list,
            lambda df: I.flatten_list(df).select(
                "article_id", "scrape_timestamp", "announcement_type", "is_win_bid", "is_termination"
            ),
        ),
        "unknown_paths": on(A.raw_list, I.unknown_paths),
        "error_report": error_report,
        "unseen_notices": lambda spark, sf: I.unseen(
            I.flatten_list(A.raw_list(spark, sf)), A.seen_ids(spark, sf)
        ).select("article_id", "scrape_timestamp"),
        "registered_ids": registered_ids,
        "removed_ids": removed_ids,
        "latest_time": _on_notices(I.latest_time),
        "notices_per_month": _on_notices(I.notices_per_month),
        "resolve_links": resolve_links,
        "skip_rules": on(
            A.titled_details,
            lambda df: df.select("id", I.skip_reason(F.col("title"), F.col("announcement_type")).alias("skip")),
        ),
        "amount_of_text": on(A.amount_texts, amount_of_text),
        "html_lines": html_lines,
        "url_parameter": url_parameter,
        "article_id_of_url": article_id_of_url,
        "page_sections": on(A.result_pages, page_sections),
        "result_lots": on(A.result_pages, result_lots),
        "result_facts": on(A.result_pages, result_facts),
        "void_reasons": on(A.void_texts, void_reasons),
        "termination_reason": on(A.termination_lines, termination_reason),
        "review_experts": on(A.expert_lines, review_experts),
        "contacts": on(A.contact_texts, contacts),
        "purchase_facts": on(A.purchase_texts, purchase_facts),
        "merge_lots": merge_lots,
        "lot_count_mismatch": lambda spark, sf: L.lot_count_mismatch(A.lot_plan(spark, sf), X.lots(spark, sf)),
        "lot_budget": on(X.lots, L.budget_of_lots),
        "lot_amount": _on_lots(L.amount_of_lots),
        "budget_mismatch": lambda spark, sf: L.budget_mismatch(X.notices(spark, sf), X.lots(spark, sf)),
        "first_usable": on(A.project_candidates, page_search.first_usable),
        "completeness": _on_notices(
            lambda n: I.completeness(
                n, ["procurement_method", "purchaser", "purchasing_agency", "total_amount", "project_code"]
            )
        ),
        "missing_fields": _on_notices(missing_fields),
        "run_counters": run_counters,
        "district_documents": on(A.district_documents, district_documents),
        "retry_list": on(A.error_log, retry_list),
    }


def _sources_and_streams() -> dict[str, Query]:
    def notice_json(spark: SparkSession, sf: str) -> DataFrame:
        read = N.with_int_district(N.parse_notices(A.notice_values(spark, sf)))
        flat = R.lots_of(
            read.select(
                "result_source_article_id",
                "scrape_timestamp",
                "district_code",
                "is_win_bid",
                "is_termination",
                "total_amount",
                "result_article_id",
                F.transform(
                    "bid_items",
                    lambda x: F.struct(
                        x["name"].alias("lot_name"), x["index"].alias("lot_index"), x["amount"].alias("lot_amount")
                    ),
                ).alias("bid_items"),
            )
        )
        return N.to_row_format(flat)

    def row_defaults(n: DataFrame) -> DataFrame:
        stored = n.select("id", "purchasing_agency", "is_win_bid", "is_termination", "total_budget")
        return N.from_row_format(N.to_row_format(stored))

    def dense_id(n: DataFrame) -> DataFrame:
        rows = n.select(F.col("id").alias("notice"), "scrape_timestamp")
        return tables.with_dense_id(rows, ["scrape_timestamp", "notice"]).select("notice", "id")

    def old_and_new(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
        old = X.table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
        )
        new = X.table(spark, sf, "customer").select(
            (F.col("c_custkey") % 150).alias("code"),
            F.col("c_name").alias("name"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_custkey").alias("stamp"),
        )
        return old, new

    def month_scaffold(spark: SparkSession, sf: str) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        bounds = X.table(spark, sf, "orders").agg(F.min(day).alias("begin_date"), F.max(day).alias("end_date"))
        return calendar.month_scaffold(bounds)

    def calendar_columns(n: DataFrame) -> DataFrame:
        ms = F.col("scrape_timestamp")
        day = F.timestamp_millis(ms).cast("date")
        rows = n.select(
            "id",
            "scrape_timestamp",
            calendar.days_in_month(day).alias("days"),
            calendar.format_ms(ms).alias("day_text"),
            calendar.format_ms(ms, with_time=True).alias("minute_text"),
        )
        return calendar.with_calendar(rows)

    def order_stream(spark: SparkSession, sf: str) -> DataFrame:
        return X.notices(spark, sf, Z.parquet_stream(spark, f"{sf}/[o]rders.parquet"))

    def streamed_volume_cube(spark: SparkSession, sf: str) -> DataFrame:
        root = run_folder(spark)
        won = order_stream(spark, sf).filter("is_win_bid")
        Z.fold_stream(won, f"{root}/cells", f"{root}/log", [], R.volume_measures).awaitTermination()
        return Z.cube_of_cells(spark, f"{root}/cells", [], R.volume_measures)

    def streamed_unique_events(spark: SparkSession, sf: str) -> DataFrame:
        # Every event comes twice, in four files without any order of time, one file to a micro-batch.
        root = run_folder(spark)
        events = X.table(spark, sf, "events").select("event_id", "event_type")
        copies = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
        dealt = copies.repartition(4, F.xxhash64("copy", "event_id")).drop("copy")
        dealt.write.parquet(f"{root}/twice")
        stream = Z.parquet_stream(spark, f"{root}/twice", files_per_trigger=1)
        Z.fold_unique(stream, f"{root}/rows", f"{root}/log", "event_id").awaitTermination()
        return spark.read.parquet(f"{root}/rows").drop("batch")

    def stored_notices_page(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{run_folder(spark)}/notices"
        save_notices(X.notices(spark, sf), path)
        rows = spark.read.parquet(path)
        return S.notices_page(rows, page_no=1, page_size=20, year=1997, month=2).select(
            "id", "scrape_timestamp", "district_code", "purchaser"
        )

    def deep_page(spark: SparkSession, sf: str) -> DataFrame:
        rows, counts = stored_with_counts(spark, sf)
        return S.indexed_page(rows, counts, page_no=40, page_size=20).select("id", "scrape_timestamp", "purchaser")

    def deep_city_page(spark: SparkSession, sf: str) -> DataFrame:
        rows, counts = stored_with_counts(spark, sf)
        return S.indexed_page(rows, counts, 6, 10, district=CITY).select("id", "scrape_timestamp", "purchaser")

    def next_page(spark: SparkSession, sf: str) -> DataFrame:
        rows, counts = stored_with_counts(spark, sf)
        last = S.indexed_page(rows, counts, page_no=40, page_size=20).agg(F.max(F.struct(*S.TIME_ORDER)).alias("x"))
        after = last.select("x.*").first()
        return S.indexed_page_after(rows, counts, after, page_size=20).select("id", "scrape_timestamp", "purchaser")

    def stored_with_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
        folder = run_folder(spark)
        save_notices(X.notices(spark, sf), f"{folder}/notices")
        rows = spark.read.parquet(f"{folder}/notices")
        S.folder_counts(rows).write.parquet(f"{folder}/counts")
        return rows, spark.read.parquet(f"{folder}/counts")

    def stored_upsert(spark: SparkSession, sf: str) -> DataFrame:
        old, new = old_and_new(spark, sf)
        store = KeyedStore(f"{run_folder(spark)}/store", "code", 32)
        store.create(old)
        store.upsert(new, "stamp")
        return store.read(spark)

    def json_by_month(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{run_folder(spark)}/json"
        save_json_by_month(X.notices(spark, sf).select("id", "scrape_timestamp", "purchaser"), path)
        rows = spark.read.schema("id long, scrape_timestamp long, purchaser string, year int, month int").json(path)
        return rows.groupBy("year", "month").agg(F.count("*").alias("notices"), F.max("purchaser").alias("last_purchaser"))

    def closed_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
        # Two years to a file, one file to a micro-batch; every tenth order comes a file later.
        root = run_folder(spark)
        timed = X.notices(spark, sf).select("id", "district_code", F.timestamp_millis("scrape_timestamp").alias("ts"))
        delay = F.when(F.col("id") % 10 == 0, 1).otherwise(0)
        dealt = timed.withColumn("file", F.least(F.floor((F.year("ts") - 1992) / 2) + delay, F.lit(3)))
        dealt = tables.stored(dealt, "dealt")
        for k in range(4):
            dealt.filter(F.col("file") == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = Z.parquet_stream(spark, f"{root}/in", files_per_trigger=1)
        Z.fold_windows(stream, f"{root}/out", f"{root}/log", "ts", ["district_code"]).awaitTermination()
        closed, open_, late = Z.read_windows(spark, f"{root}/out")
        late = Z.window_counts(late, "ts", ["district_code"])
        parts = [df.withColumn("part", F.lit(p)) for p, df in (("closed", closed), ("open", open_), ("late", late))]
        return frames.union_frames(parts).withColumn("day", F.date_format("day", "yyyy-MM-dd"))

    def latest_of_stream(spark: SparkSession, sf: str) -> DataFrame:
        root = run_folder(spark)

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/latest")

        latest = Z.latest_seen(order_stream(spark, sf))
        for_each_batch(latest, write, f"{root}/log", mode="complete").awaitTermination()
        return spark.read.parquet(f"{root}/latest")

    def streamed_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
        root = run_folder(spark)
        timed = order_stream(spark, sf).withColumn("ts", F.timestamp_millis("scrape_timestamp"))

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/latest")

        for_each_batch(Z.daily_counts(timed), write, f"{root}/log", mode="complete").awaitTermination()
        latest = spark.read.parquet(f"{root}/latest")
        return latest.withColumn("day", F.date_format("day", "yyyy-MM-dd"))

    def text_helpers(spark: SparkSession, sf: str) -> DataFrame:
        t = F.col("text")
        return X.table(spark, sf, "documents").select(
            "doc_id",
            F.length(t).alias("chars"),
            F.length(text.strip_blanks(t)).alias("solid_chars"),
            text.index_of(t, F.lit(" ")).alias("first_blank"),
            text.leading_number(t).alias("leading_number"),
            text.first_symbol(t, ("。", ";")).isNotNull().alias("has_mark"),
        )

    return {
        "notice_json": notice_json,
        "corrupt_notices": lambda spark, sf: I.error_report(N.corrupt_notices(A.notice_values(spark, sf))),
        "row_defaults": _on_notices(row_defaults),
        "dense_id": _on_notices(dense_id),
        "upsert": lambda spark, sf: tables.upsert(*old_and_new(spark, sf), "code", "stamp"),
        "stored_upsert": stored_upsert,
        "deep_page": deep_page,
        "deep_city_page": deep_city_page,
        "next_page": next_page,
        "changed_keys": lambda spark, sf: tables.changed_keys(*old_and_new(spark, sf), "code"),
        "month_scaffold": month_scaffold,
        "calendar_columns": _on_notices(calendar_columns),
        "streamed_volume_cube": streamed_volume_cube,
        "streamed_unique_events": streamed_unique_events,
        "streamed_daily_counts": streamed_daily_counts,
        "closed_daily_counts": closed_daily_counts,
        "stored_notices_page": stored_notices_page,
        "json_by_month": json_by_month,
        "latest_of_stream": latest_of_stream,
        "text_helpers": text_helpers,
    }


def _with_settings(query: Query) -> Query:
    return lambda spark, sf: query(use_engine_settings(spark), sf)


def queries() -> dict[str, Query]:
    """One entry per operator; each callable takes (spark, sf_dir)."""
    registered = {**_reports(), **_serving(), **_ingest(), **_sources_and_streams()}
    if llm:
        registered |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return {name: _with_settings(q) for name, q in registered.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB statements with the expected result of each query."""
    statements = oracle_queries.all_statements()
    if llm:
        statements |= llm.statements()
        if corpus_pipeline.ORACLE_SQL:
            statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements
