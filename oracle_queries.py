"""DuckDB statements with the expected results of the registered queries.

They read the plain test tables and share nothing with the Spark code.
"""

from __future__ import annotations

DISTRICT = """
district AS (
  SELECT n_nationkey,
         CASE WHEN n_nationkey = 24 THEN 459900
              ELSE 450000 + (n_regionkey + 1) * 100
                 + CASE WHEN n_nationkey < 5 THEN 0 WHEN n_nationkey < 10 THEN 99
                        WHEN n_nationkey < 15 THEN 2 WHEN n_nationkey < 20 THEN 3 ELSE 4 END
         END AS code, n_name AS name
  FROM nation),
dim AS (
  SELECT code, CASE WHEN code % 100 = 99 THEN concat(name, '本级') ELSE name END AS name,
         concat('FULL-', name) AS full_name, name AS short_name,
         CASE WHEN code = 450000 THEN -1 WHEN code % 100 = 0 OR code = 459900 THEN 450000
              ELSE code - code % 100 END AS parent_code,
         CASE WHEN code IN (450000, 459900) THEN 1 WHEN code % 100 IN (0, 99) THEN 2 ELSE 3 END AS type
  FROM (SELECT code, name FROM district UNION ALL SELECT 450000, 'ROOT'))"""

NOTICE = DISTRICT + """,
notice AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS ts, d.code AS district_code, d.name AS district_name,
         concat('AUTHOR-', CAST(o_custkey % 7 AS VARCHAR)) AS author, c_mktsegment AS catalog,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS procurement_method,
         c_name AS purchaser,
         CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN '/'
              ELSE concat('AGENCY-', CAST(o_custkey % 10 AS VARCHAR)) END AS purchasing_agency,
         o_orderstatus = 'F' AS is_win_bid, o_orderstatus = 'P' AS is_termination,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderkey % 5 = 0 THEN -1 ELSE 0 END AS total_amount,
         CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_totalprice * 1.1::DOUBLE END AS total_budget
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN district d ON c_nationkey = d.n_nationkey)"""

LOT = NOTICE + """,
item AS (
  SELECT l_orderkey AS id, l_linenumber AS idx, p_name AS name,
         l_returnflag <> 'R' AS is_win, l_extendedprice AS budget,
         CASE WHEN l_linenumber = 7 THEN 100 * (1 - l_discount)
              ELSE l_extendedprice * (1 - l_discount) END AS amount,
         l_linenumber = 7 AS is_percent,
         CASE WHEN l_quantity = 50 THEN NULL ELSE s_name END AS supplier,
         concat('ADDR-', CAST(l_partkey % 3 AS VARCHAR)) AS supplier_address,
         CASE WHEN l_returnflag = 'R' THEN concat('REASON-', l_linestatus) END AS reason
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
lot AS (
  SELECT item.*, n.ts, n.district_code, n.catalog, n.is_win_bid, n.total_budget
  FROM item JOIN notice n ON item.id = n.id)"""

# Value of a won lot; a percentage is taken of the notice's budget.
LOT_VALUE = """CASE WHEN is_percent
  THEN CAST(CAST(CAST(amount AS DECIMAL(16,4)) * 0.01 AS DECIMAL(18,6))
       * CAST(CASE WHEN total_budget < 0 THEN 0 ELSE total_budget END AS DECIMAL(18,4)) AS DECIMAL(36,10))
  ELSE CAST(CAST(amount AS DECIMAL(20,4)) AS DECIMAL(36,10)) END"""

GRAIN_COLS = {"day": "y,m,dd", "month": "y,m", "quarter": "y,q", "year": "y"}


def money(expr: str) -> str:
    return f"CAST(round(sum(CAST({expr} AS DECIMAL(20,4))), 2) AS DOUBLE)"


def cube(source: str, keys: str, measures: str, where: str = "true", grains=("day", "month", "quarter", "year"),
         scopes=("district", "province")) -> str:
    """Cube body; ``keys`` are the extra key columns, comma separated."""
    sets = []
    for scope in scopes:
        for grain in grains:
            cols = [c for c in (keys, "d" if scope == "district" else "", GRAIN_COLS[grain]) if c]
            sets.append("(" + ",".join(cols) + ")")
    key_out = f"{keys}, " if keys else ""
    return f"""
SELECT CASE WHEN grouping(d) = 1 THEN 0 ELSE d END AS district_code, {key_out}y AS year,
       CASE WHEN grouping(m) = 1 THEN 0 ELSE m END AS month, CASE WHEN grouping(dd) = 1 THEN 0 ELSE dd END AS day,
       CASE WHEN grouping(q) = 1 THEN 0 ELSE q END AS quarter, {measures}
FROM (SELECT *, district_code AS d, year(ts) AS y, month(ts) AS m, day(ts) AS dd, quarter(ts) AS q
      FROM {source} WHERE {where}) base
GROUP BY GROUPING SETS ({",".join(sets)}, {"(d,m,dd,q,y" + ("," + keys if keys else "") + ")"})
HAVING NOT (grouping(d) = 0 AND grouping(m) = 0 AND grouping(dd) = 0 AND grouping(q) = 0)"""


def with_(prelude: str, body: str) -> str:
    return f"WITH {prelude.strip()} {body}"


VOLUME = cube("notice", "", f"{money('total_amount')} AS transactions_volume", "is_win_bid")
OUTCOME = cube(
    "notice",
    "",
    "count(*) FILTER (WHERE is_win_bid) AS win_count,"
    " count(*) FILTER (WHERE NOT is_win_bid AND NOT is_termination) AS lose_count,"
    " count(*) FILTER (WHERE is_termination) AS terminate_count",
)
METHOD_AMOUNT = "CASE WHEN total_amount < 0 THEN 0 ELSE total_amount END"
METHOD = cube("notice", "procurement_method", f"count(procurement_method) AS count, {money(METHOD_AMOUNT)} AS total_amount")
SUPPLIER_VOLUME = cube(
    "lot",
    "supplier",
    f"CAST(round(sum({LOT_VALUE}), 2) AS DOUBLE) AS transactions_volume, count(*) AS bidding_count",
    "is_win_bid AND is_win AND amount >= 0",
)
AMOUNT_0 = "greatest(coalesce(total_amount, 0), 0)"
BUDGET_0 = "greatest(coalesce(total_budget, 0), 0)"


def _avg(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(20,4))) AS DOUBLE) / count({expr})"


CITY_FOLD = """
folded AS (
  SELECT v.*, CASE WHEN p % 100 = 99 THEN p - 99 ELSE p END AS city
  FROM (SELECT volume.*, CASE WHEN type = 3 THEN parent_code ELSE code END AS p
        FROM volume JOIN dim ON district_code = code WHERE district_code NOT IN (0, 459900)) v)"""

CITY_YEARS = f"""
city_years AS (
  SELECT s.year, s.city AS district_code,
         CASE WHEN s.year = 10000 THEN regexp_replace(dim.name, '本级$', '') ELSE dim.name END AS district_name, s.volume
  FROM (SELECT CASE WHEN grouping(year) = 1 THEN 10000 ELSE year END AS year, city, {money('transactions_volume')} AS volume
        FROM folded WHERE month = 0 AND quarter = 0 GROUP BY GROUPING SETS ((year, city), (city))) s
  JOIN dim ON dim.code = s.city)"""

FREQUENT = " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM notice"
    for c in ("author", "catalog", "procurement_method", "is_win_bid", "purchaser", "purchasing_agency", "is_termination")
)


def _summary_rows() -> str:
    metrics = {
        "count": "n",
        "mean": "round(CAST({c}_s AS DOUBLE) / n, 2)",
        "stddev": "round(sqrt((CAST({c}_q AS DOUBLE) - CAST({c}_s AS DOUBLE) * CAST({c}_s AS DOUBLE) / n) / (n - 1)), 2)",
        "min": "{c}_min",
        "25%": "{c}_25",
        "50%": "{c}_50",
        "75%": "{c}_75",
        "max": "{c}_max",
    }
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({e.format(c='b')} AS DOUBLE) AS total_budget,"
        f" CAST({e.format(c='a')} AS DOUBLE) AS total_amount FROM one"
        for m, e in metrics.items()
    )


def _pick(c: str, alias: str, p: str) -> str:
    return f"max({c}) FILTER (WHERE r{alias} = ceil({p} * n)) AS {alias}_{p[2:].ljust(2, '0')}"


SUMMARY = f""",
both_set AS (SELECT total_budget AS b, total_amount AS a FROM notice WHERE total_budget > 0 AND total_amount > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY b) AS rb, row_number() OVER (ORDER BY a) AS ra, count(*) OVER () AS n FROM both_set),
one AS (SELECT CAST(max(n) AS DOUBLE) AS n,
  sum(CAST(b AS DECIMAL(18,4))) AS b_s, sum(CAST(b AS DECIMAL(19,4)) * CAST(b AS DECIMAL(19,4))) AS b_q, min(b) AS b_min, max(b) AS b_max,
  {_pick('b', 'b', '0.25')}, {_pick('b', 'b', '0.5')}, {_pick('b', 'b', '0.75')},
  sum(CAST(a AS DECIMAL(18,4))) AS a_s, sum(CAST(a AS DECIMAL(19,4)) * CAST(a AS DECIMAL(19,4))) AS a_q, min(a) AS a_min, max(a) AS a_max,
  {_pick('a', 'a', '0.25')}, {_pick('a', 'a', '0.5')}, {_pick('a', 'a', '0.75')} FROM ranked)
"""


def _top(prelude: str, keys: str, value: str, limit: str, cond: str = "true") -> str:
    return with_(
        prelude,
        f"""SELECT * FROM (
  SELECT {keys}, {value}, count, row_number() OVER (PARTITION BY {keys} ORDER BY count DESC, {value} NULLS LAST) AS rank
  FROM (SELECT {keys}, {value}, count(*) AS count FROM notice WHERE {cond} GROUP BY {keys}, {value}) c) r WHERE rank <= {limit}""",
    )


REPORTS = {
    "outcome_counts_cube": with_(NOTICE, OUTCOME),
    "win_counts_cube": with_(NOTICE, cube("notice", "", "count(*) AS win_count", "is_win_bid")),
    "lose_counts_cube": with_(
        NOTICE, cube("notice", "", "count(*) AS lose_count", "NOT is_win_bid AND NOT is_termination")
    ),
    "terminate_counts_cube": with_(NOTICE, cube("notice", "", "count(*) AS terminate_count", "is_termination")),
    "budget_situation_cube": with_(
        NOTICE,
        cube(
            "notice",
            "",
            ", ".join(
                f"{money(e)} AS {n}_sum, CAST(max(CAST({e} AS DECIMAL(20,4))) AS DOUBLE) AS {n}_max, {_avg(e)} AS {n}_avg"
                for n, e in (("amount", AMOUNT_0), ("budget", BUDGET_0))
            ),
            "total_amount >= 0 OR total_budget >= 0",
        ),
    ),
    "district_level_row": with_(
        NOTICE,
        "SELECT "
        + ", ".join(
            f"count(*) FILTER (WHERE l = {l}) AS {p}_count,"
            f" coalesce(CAST(round(sum(CAST({AMOUNT_0} AS DECIMAL(20,4))) FILTER (WHERE l = {l}), 2) AS DOUBLE), 0) AS {p}_amount"
            for l, p in ((1, "provincial"), (2, "municipal"), (3, "district"))
        )
        + f", {money(AMOUNT_0)} AS total_amount, count(*) AS total_count"
        " FROM (SELECT *, CASE WHEN district_code IN (450000, 459900) THEN 1 WHEN district_code % 100 IN (0, 99) THEN 2 ELSE 3 END AS l FROM notice) x",
    ),
    "volume_cube": with_(NOTICE, VOLUME),
    "method_cube": with_(NOTICE, METHOD),
    "catalog_counts": with_(NOTICE, "SELECT catalog, count(*) AS count FROM notice GROUP BY catalog"),
    "agency_counts": with_(
        NOTICE,
        "SELECT purchasing_agency, count(*) AS count FROM notice WHERE length(purchasing_agency) > 1 GROUP BY purchasing_agency",
    ),
    "agency_top_catalog": with_(
        NOTICE,
        """SELECT purchasing_agency, catalog, count FROM (
  SELECT *, row_number() OVER (PARTITION BY purchasing_agency ORDER BY count DESC, catalog NULLS LAST) AS r
  FROM (SELECT purchasing_agency, catalog, count(*) AS count FROM notice WHERE length(purchasing_agency) > 1
        GROUP BY purchasing_agency, catalog) c) t WHERE r = 1""",
    ),
    "purchaser_cube": with_(NOTICE, cube("notice", "purchaser", "count(*) AS count")),
    "purchaser_catalog": with_(
        NOTICE, "SELECT purchaser, catalog, count(*) AS count FROM notice GROUP BY purchaser, catalog"
    ),
    "purchaser_agency": with_(
        NOTICE, "SELECT purchaser, purchasing_agency, count(*) AS count FROM notice GROUP BY purchaser, purchasing_agency"
    ),
    "supplier_cube": with_(LOT, cube("lot", "supplier", "count(*) AS count", "supplier IS NOT NULL")),
    "supplier_volume_cube": with_(LOT, SUPPLIER_VOLUME),
    "supplier_catalog": with_(
        LOT, "SELECT supplier, catalog, count(*) AS count FROM lot WHERE supplier IS NOT NULL GROUP BY supplier, catalog"
    ),
    "supplier_address": with_(
        LOT,
        """SELECT supplier, address FROM (
  SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY n DESC, address NULLS LAST) AS r
  FROM (SELECT supplier, supplier_address AS address, count(*) AS n FROM lot WHERE length(supplier) >= 2
        GROUP BY supplier, supplier_address) c) t WHERE r = 1""",
    ),
    "value_frequencies": with_(
        NOTICE, f"SELECT attribute, value, count(*) AS count FROM ({FREQUENT}) f GROUP BY attribute, value"
    ),
    "amount_summary": with_(NOTICE + SUMMARY, _summary_rows()),
    "top3_catalog": _top(NOTICE, "purchaser", "catalog", "3"),
    "top3_agency": _top(NOTICE, "purchaser", "purchasing_agency", "3"),
}



def _stacked(**reports: str) -> str:
    return " UNION ALL BY NAME ".join(f"SELECT '{name}' AS report, * FROM ({REPORTS[query]})" for name, query in reports.items())


REPORTS["report_set"] = _stacked(
    outcomes="outcome_counts_cube",
    win_count="win_counts_cube",
    lose_count="lose_counts_cube",
    terminate_count="terminate_counts_cube",
    volumes="volume_cube",
    budgets="budget_situation_cube",
    methods="method_cube",
    levels="district_level_row",
)
REPORTS["count_set"] = _stacked(
    purchaser_catalogs="purchaser_catalog",
    purchaser_agencies="purchaser_agency",
    catalogs="catalog_counts",
    agencies="agency_counts",
    agency_catalogs="agency_top_catalog",
)

YEAR_ROW = "month = 0 AND quarter = 0"
TABLES = f"""{LOT},
volume AS ({VOLUME}),
outcome AS ({OUTCOME}),
method AS ({METHOD}),
supplier_volume AS ({SUPPLIER_VOLUME})"""
ADDRESS = REPORTS["supplier_address"].split("WITH ", 1)[1][len(LOT.strip()):]

UNITS = (("1e8", "0.00000001", "亿"), ("1e7", "0.0000001", "千万"), ("1e6", "0.000001", "百万"), ("1e4", "0.0001", "万"), ("1", "1", ""))
AMOUNT_TEXT = (
    "CASE "
    + " ".join(
        f"WHEN total_amount >= {t} THEN concat(CAST(CAST(round(CAST(total_amount AS DECIMAL(24,4)) * CAST({f} AS DECIMAL(9,8)), 4)"
        f" AS DECIMAL(30,4)) AS VARCHAR), '{u}元')"
        for t, f, u in UNITS
    )
    + " ELSE regexp_replace(CAST(total_amount AS VARCHAR), '\\.0$', '') END"
)

SERVING = {
    "basic_situation": with_(
        TABLES,
        f"""SELECT (SELECT count(*) FROM notice) AS announcement_count,
  (SELECT CAST(sum(win_count) AS BIGINT) FROM outcome WHERE district_code = 0 AND {YEAR_ROW}) AS transactions_count,
  (SELECT epoch_ms(max(ts)) FROM notice) AS latest_timestamp,
  (SELECT {money('transactions_volume')} FROM volume WHERE district_code = 0 AND {YEAR_ROW}) AS transactions_volume,
  (SELECT count(DISTINCT supplier) FROM lot WHERE length(supplier) >= 2) AS supplier_count""",
    ),
    "quarter_series": with_(
        TABLES,
        """SELECT o.year, o.quarter, win_count + lose_count + terminate_count AS announcement_count, win_count AS transactions_count,
  transactions_volume FROM outcome o LEFT JOIN (SELECT * FROM volume WHERE district_code = 0 AND quarter <> 0) v
  ON o.year = v.year AND o.quarter = v.quarter WHERE o.district_code = 0 AND o.quarter <> 0""",
    ),
    "scale_by_grain": with_(
        TABLES,
        """SELECT year, CASE WHEN day <> 0 THEN 'day' WHEN month <> 0 THEN 'month' ELSE 'quarter' END AS grain,
  CASE WHEN day <> 0 THEN month ELSE 0 END AS month, CASE WHEN day <> 0 THEN day WHEN month <> 0 THEN month ELSE quarter END AS idx,
  transactions_volume AS value
  FROM volume WHERE district_code = 0 AND year IN (1996, 1997, 1998) AND NOT (month = 0 AND quarter = 0)""",
    ),
    "scale_by_grain_all": with_(
        TABLES,
        """SELECT year, CASE WHEN day <> 0 THEN 'day' WHEN month <> 0 THEN 'month' ELSE 'quarter' END AS grain,
  CASE WHEN day <> 0 THEN month ELSE 0 END AS month, CASE WHEN day <> 0 THEN day WHEN month <> 0 THEN month ELSE quarter END AS idx,
  transactions_volume AS value
  FROM volume WHERE district_code = 0 AND year <> 10000 AND NOT (month = 0 AND quarter = 0)""",
    ),
    "notices_page_all": with_(
        NOTICE,
        """SELECT id, epoch_ms(ts) AS scrape_timestamp, district_code, catalog, purchaser, total_amount FROM notice
  ORDER BY ts, id LIMIT 20 OFFSET 20""",
    ),
    "notices_total_all": with_(NOTICE, "SELECT count(*) AS total FROM notice"),
    "notices_page": with_(
        NOTICE,
        """SELECT id, epoch_ms(ts) AS scrape_timestamp, district_code, catalog, purchaser, total_amount FROM notice
  WHERE ts >= TIMESTAMP '1997-04-01' AND ts < TIMESTAMP '1997-07-01' ORDER BY ts, id LIMIT 20 OFFSET 20""",
    ),
    "notices_total": with_(
        NOTICE,
        "SELECT count(*) AS total FROM notice WHERE ts >= TIMESTAMP '1997-02-01' AND ts < TIMESTAMP '1997-03-01' AND district_code = 450100",
    ),
    "level_rows": with_(
        NOTICE,
        f"""SELECT name, coalesce(value, 0) AS value, count FROM (
  SELECT l, CASE l WHEN 1 THEN '省级' WHEN 2 THEN '市级' ELSE '区级' END AS name, {money(AMOUNT_0)} AS value, count(*) AS count
  FROM (SELECT *, CASE WHEN district_code IN (450000, 459900) THEN 1 WHEN district_code % 100 IN (0, 99) THEN 2 ELSE 3 END AS l FROM notice) x
  GROUP BY l) y""",
    ),
    "outcomes_by_year": with_(
        NOTICE,
        """SELECT year(ts) AS year, count(*) FILTER (WHERE is_win_bid) AS win_count,
  count(*) FILTER (WHERE NOT is_win_bid AND NOT is_termination) AS lose_count,
  count(*) FILTER (WHERE is_termination) AS terminate_count FROM notice GROUP BY year(ts)""",
    ),
    "method_by_year": with_(
        TABLES,
        f"""SELECT CASE WHEN grouping(year) = 1 THEN 10000 ELSE year END AS year, name, CAST(sum(count) AS BIGINT) AS count,
  {money('total_amount')} AS amount
  FROM (SELECT year, coalesce(procurement_method, '其他-未知') AS name, count, total_amount FROM method WHERE district_code = 0 AND {YEAR_ROW}) m
  GROUP BY GROUPING SETS ((year, name), (name))""",
    ),
    "city_volume_by_year": with_(TABLES + "," + CITY_FOLD + "," + CITY_YEARS, "SELECT * FROM city_years"),
    "child_volume_by_year": with_(
        TABLES,
        f"""SELECT CASE WHEN grouping(year) = 1 THEN 10000 ELSE year END AS year, district_code, district_name, {money('transactions_volume')} AS volume
  FROM (SELECT v.year, v.district_code, regexp_replace(dim.name, '本级$', '') AS district_name, v.transactions_volume
        FROM volume v JOIN dim ON dim.code = v.district_code
        WHERE v.district_code <> 0 AND {YEAR_ROW} AND (dim.code = 450100 OR dim.parent_code = 450100)) c
  GROUP BY GROUPING SETS ((year, district_code, district_name), (district_code, district_name))""",
    ),
    "city_growth": with_(
        TABLES + "," + CITY_FOLD,
        """SELECT g.city AS district_code, dim.name AS district_name, epoch_ms(make_timestamp(g.year, g.month, 1, 0, 0, 0)) AS timestamp,
  CAST(round(sum(v) OVER (PARTITION BY g.city ORDER BY g.year, g.month), 2) AS DOUBLE) AS value
  FROM (SELECT city, year, month, sum(CAST(transactions_volume AS DECIMAL(20,4))) AS v FROM folded WHERE month <> 0 AND day = 0
        GROUP BY city, year, month) g JOIN dim ON dim.code = g.city""",
    ),
    "city_rank": with_(
        TABLES + "," + CITY_FOLD + "," + CITY_YEARS,
        """SELECT *, rank() OVER (PARTITION BY year ORDER BY volume DESC) AS rank, min(volume) OVER (PARTITION BY year) AS min_value,
  max(volume) OVER (PARTITION BY year) AS max_value FROM city_years""",
    ),
    "unknown_district_codes": with_(
        TABLES,
        "SELECT district_code, count(*) AS rows FROM volume WHERE district_code NOT IN (SELECT code FROM dim) GROUP BY district_code",
    ),
    "district_tree": f"""WITH RECURSIVE {DISTRICT.strip()},
tree AS (SELECT code, name, parent_code, 0 AS level, CAST(code AS VARCHAR) AS path FROM dim WHERE code = 450000
  UNION ALL SELECT d.code, d.name, d.parent_code, t.level + 1, concat(t.path, '/', CAST(d.code AS VARCHAR))
  FROM dim d JOIN tree t ON d.parent_code = t.code)
SELECT code, name, parent_code, level, path FROM tree""",
    "districts_by_type": with_(DISTRICT, "SELECT code, name, full_name, short_name, parent_code, type FROM dim WHERE type = 3"),
    "districts_all": with_(DISTRICT, "SELECT code, name, full_name, short_name, parent_code, type FROM dim"),
    "cities": with_(DISTRICT, "SELECT code, name, full_name, short_name, parent_code, type FROM dim WHERE code % 100 = 0"),
    "supplier_page": with_(
        LOT, "SELECT DISTINCT supplier FROM lot WHERE length(supplier) >= 2 ORDER BY supplier LIMIT 20 OFFSET 20"
    ),
    "supplier_catalogs_of": with_(
        LOT,
        "SELECT catalog AS name, count(*) AS value FROM lot WHERE supplier = 'Supplier#000000001' GROUP BY catalog",
    ),
    "supplier_detail": with_(
        TABLES,
        f"""SELECT supplier, 'address' AS section, address AS label, CAST(NULL AS DOUBLE) AS volume, CAST(NULL AS BIGINT) AS count
  FROM (SELECT supplier, supplier_address AS address, row_number() OVER (ORDER BY count(*) DESC, supplier_address NULLS LAST) AS r
        FROM lot WHERE supplier = 'Supplier#000000001' GROUP BY supplier, supplier_address) a WHERE r = 1
  UNION ALL SELECT supplier, 'catalog', catalog, NULL, count(*) FROM lot WHERE supplier = 'Supplier#000000001' GROUP BY supplier, catalog
  UNION ALL SELECT supplier, 'year', CAST(year AS VARCHAR), transactions_volume, bidding_count FROM supplier_volume
  WHERE supplier = 'Supplier#000000001' AND district_code = 0 AND {YEAR_ROW}""",
    ),
    "yearly_from_months": with_(
        TABLES,
        f"SELECT year, {money('transactions_volume')} AS value FROM volume WHERE district_code = 0 AND month <> 0 AND day = 0 GROUP BY year",
    ),
    "outcome_label": with_(
        NOTICE,
        """SELECT code, name, count(*) AS count FROM (
  SELECT CASE WHEN is_win_bid THEN 1 WHEN is_termination THEN 3 ELSE 2 END AS code,
         CASE WHEN is_win_bid THEN '成交' WHEN is_termination THEN '终止' ELSE '废标' END AS name FROM notice) x GROUP BY code, name""",
    ),
    "amount_text": with_(NOTICE, f"SELECT id, {AMOUNT_TEXT} AS amount_text FROM notice"),
    "no_data_label": with_(
        NOTICE,
        """SELECT id, CASE WHEN total_budget IS NULL OR total_budget < 0 THEN '暂无数据' ELSE 'has' END AS budget_text,
  coalesce(purchasing_agency, '/') AS agency_text FROM notice""",
    ),
    "axis_labels": with_(
        TABLES,
        """SELECT year, CASE WHEN day <> 0 THEN concat(lpad(CAST(month AS VARCHAR), 2, '0'), '月', lpad(CAST(day AS VARCHAR), 2, '0'), '日')
  WHEN month <> 0 THEN concat(CAST(month AS VARCHAR), '月') WHEN quarter <> 0 THEN concat('第', CAST(quarter AS VARCHAR), '季度') END AS label,
  transactions_volume FROM volume WHERE district_code = 0""",
    ),
}


# --- ingestion ---------------------------------------------------------------

RAW_LIST = NOTICE + """,
raw_list AS (
  SELECT concat('R', CAST(id AS VARCHAR)) AS article_id, epoch_ms(ts) AS time, author, catalog, is_win_bid, is_termination, id, ts,
    CASE WHEN id % 17 = 0 THEN '更正公告' WHEN id % 13 = 0 THEN '公开招标资格入围公告'
         WHEN is_win_bid THEN CASE id % 3 WHEN 0 THEN '中标公告' WHEN 1 THEN '成交公告' ELSE '中标（成交）结果公告' END
         WHEN is_termination THEN '终止公告' ELSE '废标公告' END AS path
  FROM notice),
meta AS (SELECT article_id, time AS scrape_timestamp, path AS announcement_type, is_win_bid, is_termination, ts
  FROM raw_list WHERE id % 17 <> 0 AND id % 13 <> 0)"""

LINE = "(SELECT *, CAST(round(l_discount * 100) AS INT) AS off, CAST(l_quantity AS INT) AS qty FROM lineitem)"

LINKS = NOTICE + """,
linked AS (SELECT *, id % 7 <> 0 AS has_links FROM notice)"""

WIN_PAGE_SECTIONS = {
    "project_code": ("1", "concat('CODE-', CAST(l_orderkey AS VARCHAR))"),
    "project_name": ("1", "concat('NAME-', CAST(l_partkey AS VARCHAR))"),
    "win": (
        "18",
        "concat('1.中标结果：序号中标（成交）金额(元)中标供应商名称中标供应商地址', CAST(l_linenumber AS VARCHAR), '总报价:',"
        " CAST(l_extendedprice AS VARCHAR), '(元)SUP-', CAST(l_suppkey AS VARCHAR), 'ADDR&-', CAST(l_partkey % 3 AS VARCHAR),"
        " '2.废标结果:序号标项名称废标理由', CAST(l_linenumber + 7 AS VARCHAR), 'LOT-', CAST(l_partkey AS VARCHAR), 'REASON-', l_linestatus, '/')",
    ),
    "review": (
        "1",
        "concat('张', CAST(l_suppkey AS VARCHAR), '（采购人代表）、李', CAST(l_partkey % 5 AS VARCHAR), '、王', CAST(l_linenumber AS VARCHAR))",
    ),
    "contact": (
        "7",
        "concat('1.采购人信息名 称：BUYER-', CAST(l_orderkey AS VARCHAR), '地址：A联系方式：12.采购代理机构信息名 称：',"
        " CASE l_suppkey % 3 WHEN 0 THEN '甲方代理' WHEN 1 THEN '乙方代理' ELSE '丙方代理' END, '地址：B')",
    ),
}

HTML = r"""
cut AS (SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS code, html FROM pages),
safe AS (SELECT page_id, code, replace(regexp_replace(html, '<!--.*?-->', '<c>', 'gs'),
    concat('<script>', code, '</script>'), concat('<s>', replace(code, '<', chr(1)), '</s>')) AS html FROM cut),
nodes AS (SELECT page_id, unnest(regexp_split_to_array(html, '<[^>]*>')) AS raw FROM safe),
lines AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), chr(1), '<'),
    '^\s+|\s+$', '', 'g') AS line FROM nodes)"""

JOB = RAW_LIST + """,
project AS (
  SELECT r.*, o_custkey, o_totalprice, o_orderstatus AS st, r.id % 7 <> 0 AS planned, CAST(r.id AS VARCHAR) AS k
  FROM raw_list r JOIN orders ON r.id = o_orderkey WHERE r.id % 17 <> 0 AND r.id % 13 <> 0 AND year(r.ts) >= 1997)"""

INGEST = {
    "ingested_notices": with_(
        JOB,
        """SELECT concat('R', k) AS result_source_article_id,
  CASE WHEN planned THEN concat(CASE WHEN id % 2 = 0 THEN 'P' ELSE 'O' END, k) END AS purchase_source_article_id,
  concat('CODE-', k) AS project_code, is_win_bid, is_termination,
  CAST(CASE WHEN planned THEN id % 100 + 51 WHEN st IN ('F', 'O') THEN -1 ELSE 0 END AS DOUBLE) AS total_budget,
  CASE WHEN st = 'F' THEN o_totalprice ELSE 0 END AS total_amount,
  CASE WHEN planned OR st = 'F' THEN 2 WHEN st = 'O' THEN 1 ELSE 0 END AS lots,
  CASE WHEN planned THEN concat('甲', k, ',乙', k) WHEN st = 'F' THEN '-,标乙' WHEN st = 'O' THEN '-' ELSE '' END AS names,
  CASE WHEN st = 'F' THEN concat('局', CAST(o_custkey AS VARCHAR)) END AS purchaser,
  CASE WHEN st = 'P' THEN concat('政策', CAST(id % 3 AS VARCHAR), '变化') END AS termination_reason,
  CASE WHEN NOT planned THEN -1 WHEN id % 3 = 0 THEN 25 * 86400000::BIGINT ELSE 20 * 86400000::BIGINT END AS tender_duration
  FROM project WHERE NOT (st = 'F' AND id % 23 = 0)""",
    ),
    "ingest_errors": with_(
        JOB,
        """SELECT 'list row: path name not known' AS message, count(*) AS count FROM raw_list WHERE id % 17 = 0
  UNION ALL SELECT 'result lots: layout not known', count(*) FROM project WHERE st = 'F' AND id % 23 = 0""",
    ),
    "classify_list": with_(
        RAW_LIST, "SELECT article_id, scrape_timestamp, announcement_type, is_win_bid, is_termination FROM meta"
    ),
    "unknown_paths": with_(
        RAW_LIST,
        "SELECT 'list row: path name not known' AS message, article_id, time AS timestamp, path AS content FROM raw_list WHERE id % 17 = 0",
    ),
    "error_report": with_(
        RAW_LIST,
        """SELECT message, count(*) AS count FROM (SELECT 'list row: path name not known' AS message FROM raw_list WHERE id % 17 = 0
  UNION ALL SELECT 'notice: json not understood' FROM notice WHERE id % 19 = 0) e GROUP BY message""",
    ),
    "unseen_notices": with_(
        RAW_LIST, "SELECT article_id, scrape_timestamp FROM meta WHERE year(ts) >= 1997"
    ),
    "registered_ids": with_(
        LINKS,
        """SELECT DISTINCT article_id FROM (SELECT concat('R', CAST(id AS VARCHAR)) AS article_id FROM linked
  UNION ALL SELECT concat('S', CAST(id AS VARCHAR)) FROM linked WHERE has_links AND id % 3 = 0) x""",
    ),
    "removed_ids": with_(
        RAW_LIST,
        "SELECT article_id FROM raw_list WHERE year(ts) < 1997 AND id % 17 <> 0",
    ),
    "latest_time": with_(NOTICE, "SELECT epoch_ms(max(ts)) AS latest_timestamp FROM notice"),
    "notices_per_month": with_(
        NOTICE,
        "SELECT concat(CAST(year(ts) AS VARCHAR), '-', CAST(month(ts) AS VARCHAR)) AS month, count(*) AS count FROM notice GROUP BY 1",
    ),
    "resolve_links": with_(
        LINKS,
        """SELECT concat('R', CAST(id AS VARCHAR)) AS article_id,
  CASE WHEN has_links AND id % 3 = 0 THEN concat('R', CAST(id AS VARCHAR), ',S', CAST(id AS VARCHAR)) ELSE concat('R', CAST(id AS VARCHAR)) END AS results,
  CASE WHEN NOT has_links THEN '' WHEN id % 2 = 0 THEN concat('P', CAST(id AS VARCHAR)) ELSE concat('O', CAST(id AS VARCHAR)) END AS purchases,
  CASE WHEN NOT has_links THEN NULL WHEN id % 2 = 0 THEN epoch_ms(ts) - 864000000 ELSE epoch_ms(ts) - 1728000000 END AS purchase_time,
  CASE WHEN NOT has_links THEN -1 WHEN id % 3 = 0 THEN 25 * 86400000::BIGINT ELSE 20 * 86400000::BIGINT END AS tender_duration,
  1 AS start_position, CAST(NULL AS VARCHAR) AS link_error FROM linked""",
    ),
    "skip_rules": with_(
        NOTICE,
        """SELECT id, CASE WHEN id % 7 IN (1, 2, 3) THEN 'title' WHEN id % 5 = 0 THEN 'type' END AS skip FROM notice""",
    ),
    "amount_of_text": f"""SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 7 WHEN 2 THEN CAST(100 - off AS DOUBLE) WHEN 4 THEN l_extendedprice + qty WHEN 5 THEN NULL ELSE l_extendedprice END AS amount,
  l_linenumber % 7 IN (2, 6) AS is_percent, l_linenumber % 7 <> 5 AS ok FROM {LINE} x""",
    "html_lines": with_(
        HTML,
        """SELECT page_id, count(*) AS lines, sum(length(line)) AS chars, min(line) AS first_line, max(line) AS last_line
  FROM lines WHERE line <> '' AND line NOT IN ('"', '“', '”') GROUP BY page_id""",
    ),
    "url_parameter": """SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages""",
    "article_id_of_url": "SELECT o_orderkey, concat('R+/', CAST(o_orderkey AS VARCHAR), '==') AS article_id FROM orders",
    "page_sections": " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{name}' AS section, {n} AS lines, {text} AS text FROM lineitem"
        for name, (n, text) in WIN_PAGE_SECTIONS.items()
    ),
    "result_lots": """SELECT l_orderkey, l_linenumber AS index, true AS is_win, CAST(NULL AS VARCHAR) AS name, l_extendedprice AS amount, false AS is_percent,
  concat('SUP-', CAST(l_suppkey AS VARCHAR)) AS supplier, concat('ADDR&-', CAST(l_partkey % 3 AS VARCHAR)) AS supplier_address,
  CAST(NULL AS VARCHAR) AS reason FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber + 7, false, concat('LOT-', CAST(l_partkey AS VARCHAR)), -1, false, NULL, NULL,
  concat('REASON-', l_linestatus) FROM lineitem""",
    "result_facts": """SELECT l_orderkey, l_linenumber, concat('CODE-', CAST(l_orderkey AS VARCHAR)) AS page_code,
  concat('NAME-', CAST(l_partkey AS VARCHAR)) AS page_name,
  concat('张', CAST(l_suppkey AS VARCHAR), '|李', CAST(l_partkey % 5 AS VARCHAR), '|王', CAST(l_linenumber AS VARCHAR)) AS experts,
  concat('张', CAST(l_suppkey AS VARCHAR)) AS representatives, concat('BUYER-', CAST(l_orderkey AS VARCHAR)) AS purchaser,
  CASE l_suppkey % 3 WHEN 0 THEN '甲方代理' WHEN 1 THEN '乙方代理' ELSE '丙方代理' END AS purchasing_agency,
  'usable' AS state FROM lineitem""",
    "void_reasons": f"""WITH line AS (SELECT *, CAST(l_partkey AS VARCHAR) AS p, l_linenumber % 7 AS f FROM {LINE} x)
  SELECT l_orderkey, l_linenumber, qty AS index, concat('原因', p) AS reason, false AS shared FROM line WHERE f = 0
  UNION ALL SELECT l_orderkey, l_linenumber, qty + 1, concat('理由', p), false FROM line WHERE f = 0
  UNION ALL SELECT l_orderkey, l_linenumber, qty, concat('提交文件的供应商不足', p, '家'), false FROM line WHERE f = 1
  UNION ALL SELECT l_orderkey, l_linenumber, 1, concat('原因', p), false FROM line WHERE f = 2
  UNION ALL SELECT l_orderkey, l_linenumber, 3, concat('理由', p), false FROM line WHERE f = 2
  UNION ALL SELECT l_orderkey, l_linenumber, 1, concat('供应商不足', p, '家，本项目废标'), false FROM line WHERE f = 3
  UNION ALL SELECT l_orderkey, l_linenumber, qty + 1, concat('供应商不足', p, '家，本项目废标'), false FROM line WHERE f = 3
  UNION ALL SELECT l_orderkey, l_linenumber, unnest([1, 2, qty + 2]), concat('供应商不足', p, '家'), false FROM line WHERE f = 4
  UNION ALL SELECT l_orderkey, l_linenumber, 1, concat('供应商不足', p, '家，本次采购失败。'), true FROM line WHERE f = 5
  UNION ALL SELECT l_orderkey, l_linenumber, 1, concat('分标1至分标', CAST(qty AS VARCHAR), '供应商不足。'), true FROM line WHERE f = 6""",
    "termination_reason": """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber % 3 <> 2 THEN concat('终止原因', CAST(l_partkey AS VARCHAR)) END AS reason,
  CASE WHEN l_linenumber % 3 = 2 THEN 'termination reason: more than two lines' END AS error FROM lineitem""",
    "review_experts": """WITH line AS (SELECT *, CAST(l_partkey AS VARCHAR) AS p, CAST(l_suppkey AS VARCHAR) AS s, l_linenumber % 5 AS f FROM lineitem)
  SELECT l_orderkey, l_linenumber,
  CASE f WHEN 0 THEN concat('张', s, '|李', p, '|王', CAST(l_linenumber AS VARCHAR)) WHEN 1 THEN concat('张', s, '|李', p, '|王', CAST(l_linenumber AS VARCHAR))
         WHEN 2 THEN concat('张', s, '|李', p) WHEN 3 THEN '' END AS experts,
  CASE f WHEN 0 THEN concat('张', s) WHEN 1 THEN concat('李', p) WHEN 2 THEN '' WHEN 3 THEN '' END AS representatives,
  CASE WHEN f = 4 THEN 'review experts: brackets not understood' END AS error FROM line""",
    "contacts": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 < 2 THEN concat('局', CAST(l_partkey AS VARCHAR)) END AS purchaser,
  CASE WHEN l_linenumber % 3 < 2 THEN CASE l_suppkey % 2 WHEN 0 THEN '甲方代理' ELSE '乙方代理' END END AS agency FROM lineitem""",
    "purchase_facts": f"""WITH line AS (SELECT *, CAST(l_partkey AS VARCHAR) AS p, l_linenumber % 5 AS f FROM {LINE} x),
  lots AS (
    SELECT l_orderkey, l_linenumber, l_partkey, 1 AS index, concat('甲', p) AS name,
      CASE f WHEN 1 THEN CAST(qty * 10000 - 5000 AS DOUBLE) WHEN 4 THEN qty ELSE l_extendedprice END AS budget, f, qty, l_extendedprice FROM line WHERE f <> 3
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 2, concat('乙', p), CASE f WHEN 1 THEN 5000 ELSE qty END, f, qty, l_extendedprice FROM line WHERE f IN (1, 2)
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL, NULL, NULL, f, qty, l_extendedprice FROM line WHERE f = 3)
  SELECT concat('CODE-', CAST(l_orderkey AS VARCHAR)) AS project_code, concat('NAME-', CAST(l_partkey AS VARCHAR)) AS project_name, l_linenumber,
    CASE f WHEN 1 THEN CAST(qty * 10000 AS DOUBLE) WHEN 2 THEN l_extendedprice + qty ELSE l_extendedprice END AS total_budget,
    f = 3 AS without_lots, CASE WHEN f = 4 AND l_extendedprice <> qty THEN 'purchase budget: lots do not add up' END AS error, index, name, budget FROM lots""",
    "merge_lots": with_(
        LOT
        + """,
plan AS (SELECT l_orderkey AS id, l_linenumber AS idx, concat('PLAN-', CAST(max(l_partkey) AS VARCHAR)) AS name, max(l_extendedprice) AS budget
  FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
        "SELECT item.id, item.idx AS index, plan.name, plan.budget, item.amount, item.supplier FROM item JOIN plan ON item.id = plan.id AND item.idx = plan.idx",
    ),
    "lot_count_mismatch": """SELECT id, purchase_count, result_max FROM (
  SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS purchase_count, CAST(max(l_linenumber) AS BIGINT) AS result_max FROM lineitem GROUP BY l_orderkey) x
  WHERE purchase_count <> result_max""",
    "lot_budget": with_(
        LOT,
        """SELECT id, CAST(round(sum(b), 2) AS DOUBLE) AS lot_budget
  FROM (SELECT id, idx, max(CAST(budget AS DECIMAL(20,4))) AS b FROM item GROUP BY id, idx) x GROUP BY id""",
    ),
    "lot_amount": with_(
        LOT,
        f"SELECT id, coalesce(CAST(round(sum(CASE WHEN is_win_bid AND is_win THEN {LOT_VALUE} END), 2) AS DOUBLE), 0) AS lot_amount FROM lot GROUP BY id",
    ),
    "budget_mismatch": with_(
        LOT,
        """SELECT n.id, n.total_budget, b.lot_budget FROM notice n JOIN (
  SELECT id, CAST(round(sum(b), 2) AS DOUBLE) AS lot_budget
  FROM (SELECT id, idx, max(CAST(budget AS DECIMAL(20,4))) AS b FROM item GROUP BY id, idx) x GROUP BY id) b ON n.id = b.id
  WHERE n.total_budget <> 0 AND abs(n.total_budget - b.lot_budget) > 1e-5""",
    ),
    "first_usable": """WITH c AS (SELECT l_orderkey AS project, l_returnflag = 'R' AS bought, l_linenumber AS pos, concat('A', CAST(l_suppkey AS VARCHAR)) AS id,
    l_discount > 0.03 AND year(l_shipdate) >= 1996 AS usable FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY project, bought ORDER BY pos, id) AS up, row_number() OVER (PARTITION BY project, bought ORDER BY pos DESC, id DESC) AS down
    FROM c WHERE usable)
  SELECT p.project, max(r.id) FILTER (WHERE NOT bought AND up = 1) AS result_id, max(r.id) FILTER (WHERE bought AND down = 1) AS purchase_id
  FROM (SELECT DISTINCT project FROM c) p LEFT JOIN r ON p.project = r.project GROUP BY p.project""",
    "completeness": with_(
        NOTICE,
        " UNION ALL ".join(
            f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM notice"
            for c in ("procurement_method", "purchaser", "purchasing_agency", "total_amount")
        )
        + " UNION ALL SELECT 'project_code', count(*) FROM notice",
    ),
    "missing_fields": with_(
        NOTICE,
        """SELECT id, concat(CASE WHEN procurement_method IS NULL THEN 'procurement_method,' ELSE '' END, 'project_code',
  CASE WHEN purchasing_agency IS NULL THEN ',purchasing_agency' ELSE '' END) AS missing FROM notice""",
    ),
    "run_counters": with_(
        RAW_LIST,
        """SELECT status AS name, count(*) AS n FROM (SELECT CASE WHEN id % 17 = 0 THEN 'error' WHEN id % 13 = 0 THEN 'dropped' ELSE 'sent' END AS status
    FROM raw_list WHERE year(ts) >= 1997) s GROUP BY status
  UNION ALL SELECT 'planned', count(*) FROM raw_list UNION ALL SELECT 'actual', count(*) FROM raw_list WHERE year(ts) >= 1997
  UNION ALL SELECT 'remaining', count(*) FROM raw_list WHERE year(ts) < 1997""",
    ),
    "district_documents": """WITH s AS (SELECT s_suppkey AS k, s_suppkey * 10000 + 100000000 AS b FROM supplier),
  r AS (SELECT b AS code, concat('P', CAST(k AS VARCHAR)) AS name, -1 AS parent_code FROM s
    UNION ALL SELECT b + 100, concat('C', CAST(k AS VARCHAR)), b FROM s UNION ALL SELECT b + 199, concat('O', CAST(k AS VARCHAR)), b FROM s
    UNION ALL SELECT b + 102, concat('L', CAST(k AS VARCHAR)), b + 100 FROM s UNION ALL SELECT b + 103, concat('M', CAST(k AS VARCHAR)), b + 100 FROM s
    UNION ALL SELECT b + 104, concat('T', CAST(k AS VARCHAR)), b + 100 FROM s UNION ALL SELECT b + 105, concat('V', CAST(k AS VARCHAR)), b + 104 FROM s)
  SELECT code, name, concat('FULL-', CAST(code AS VARCHAR)) AS full_name, concat('SHORT-', CAST(code AS VARCHAR)) AS short_name, parent_code,
    CASE WHEN code % 100 IN (0, 99) THEN 2 ELSE 3 END AS type FROM r""",
    "retry_list": """WITH e AS (SELECT DISTINCT concat('R', CAST(l_orderkey AS VARCHAR)) AS article_id, l_returnflag <> 'R' AS is_win,
    concat('ERROR-', l_linestatus) AS message, year(l_shipdate) < 1996 AS old FROM lineitem)
  SELECT article_id, is_win, message FROM e WHERE NOT old EXCEPT SELECT article_id, is_win, message FROM e WHERE old""",
}

# Each line of an order is an announcement of a project; see the fixture for what its state c means.
SEARCH = """
line AS (SELECT l_orderkey AS project, l_partkey % 8 AS c, l_partkey % 1000 + 100 AS price, l_returnflag = 'R' AS bought,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem),
res AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n) AS i, count(*) OVER (PARTITION BY project) AS results FROM line WHERE NOT bought),
cand AS (SELECT *, CASE WHEN i = least(2, results) THEN 0 ELSE i END AS rank FROM res),
own AS (SELECT project, n AS own_n, results FROM cand WHERE rank = 0 AND c <> 0),
ending AS (SELECT project, min(rank) AS last FROM cand WHERE c > 2 GROUP BY project),
chosen AS (SELECT o.project, own_n, o.results, x.n, x.c, x.price, e.last FROM own o LEFT JOIN ending e ON o.project = e.project
  LEFT JOIN cand x ON x.project = e.project AND x.rank = e.last),
plan AS (SELECT l.project, l.n, l.c, l.price FROM line l JOIN chosen h ON l.project = h.project WHERE bought AND h.c > 2 AND h.c <> 4),
used AS (SELECT project, max(n) AS n FROM plan WHERE c > 2 GROUP BY project)"""

INGEST["searched_notices"] = with_(
    SEARCH,
    """SELECT concat('A', CAST(h.project AS VARCHAR), '-', CAST(coalesce(h.n, own_n) AS VARCHAR)) AS result_source_article_id,
  CASE WHEN u.n IS NOT NULL THEN concat('A', CAST(h.project AS VARCHAR), '-', CAST(u.n AS VARCHAR)) END AS purchase_source_article_id,
  CAST(CASE WHEN u.n IS NULL THEN -1 ELSE p.price + 50 END AS DOUBLE) AS total_budget,
  CAST(CASE WHEN h.c > 4 THEN h.price ELSE -1 END AS DOUBLE) AS total_amount,
  CASE WHEN h.c > 4 THEN 2 ELSE 0 END AS lots, CAST(results AS INTEGER) AS results
  FROM chosen h LEFT JOIN used u ON h.project = u.project LEFT JOIN plan p ON p.project = u.project AND p.n = u.n
  WHERE h.c IS NULL OR h.c <> 3""",
)
INGEST["page_outcomes"] = with_(
    SEARCH,
    """SELECT side, outcome, count(*) AS pages FROM (
  SELECT 'result' AS side, CASE WHEN x.rank > h.last THEN 'not needed' ELSE CASE x.c WHEN 0 THEN 'missing' WHEN 1 THEN 'type'
    WHEN 2 THEN 'switch' WHEN 3 THEN 'error' WHEN 4 THEN 'without_items' ELSE 'usable' END END AS outcome
  FROM cand x JOIN chosen h ON x.project = h.project
  UNION ALL
  SELECT 'purchase', CASE WHEN p.n < u.n THEN 'not needed' ELSE CASE p.c WHEN 0 THEN 'missing' WHEN 1 THEN 'old' WHEN 2 THEN 'switch' ELSE 'usable' END END
  FROM plan p LEFT JOIN used u ON p.project = u.project) t GROUP BY side, outcome""",
)

OTHER = {
    "notice_json": with_(
        NOTICE,
        """SELECT concat('R', CAST(id AS VARCHAR)) AS result_source_article_id, epoch_ms(ts) AS scrape_timestamp, district_code,
  CAST(is_win_bid AS INT) AS is_win_bid, CAST(is_termination AS INT) AS is_termination, total_amount,
  concat('["R', CAST(id AS VARCHAR), '","S', CAST(id AS VARCHAR), '"]') AS result_article_id,
  concat('LOT-', CAST(id AS VARCHAR)) AS lot_name, unnest([1, 1]) AS lot_index, CAST(total_amount AS DOUBLE) AS lot_amount
  FROM notice WHERE id % 19 <> 0""",
    ),
    "corrupt_notices": with_(NOTICE, "SELECT 'notice: json not understood' AS message, count(*) AS count FROM notice WHERE id % 19 = 0"),
    "row_defaults": with_(
        NOTICE,
        """SELECT id, coalesce(purchasing_agency, '') AS purchasing_agency, is_win_bid, is_termination, total_budget FROM notice""",
    ),
    "dense_id": with_(
        NOTICE, "SELECT id AS notice, row_number() OVER (ORDER BY ts, id) - 1 AS id FROM notice"
    ),
    "upsert": """WITH fresh AS (SELECT code, name, balance FROM (
    SELECT c_custkey % 150 AS code, c_name AS name, c_acctbal AS balance, row_number() OVER (PARTITION BY c_custkey % 150 ORDER BY c_custkey DESC) AS r FROM customer) x WHERE r = 1)
  SELECT code, name, balance FROM fresh UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT code FROM fresh)""",
    "changed_keys": """SELECT k.code, CASE WHEN s_suppkey IS NULL THEN 'inserted' ELSE 'updated' END AS action
  FROM (SELECT DISTINCT c_custkey % 150 AS code FROM customer) k LEFT JOIN supplier ON code = s_suppkey""",
    "month_scaffold": """SELECT year(m) AS year, month(m) AS month, strftime(m, '%Y-%m-%d') AS begin_day, strftime(last_day(m), '%Y-%m-%d') AS end_day, day(last_day(m)) AS days
  FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders) x""",
    "calendar_columns": """SELECT o_orderkey AS id, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, quarter(o_orderdate) AS quarter,
  day(last_day(o_orderdate)) AS days, strftime(o_orderdate, '%Y-%m-%d') AS day_text, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS minute_text FROM orders""",
    "streamed_volume_cube": with_(NOTICE, VOLUME),
    "streamed_unique_events": "SELECT DISTINCT event_id, event_type FROM events",
    "streamed_daily_counts": with_(
        NOTICE,
        "SELECT strftime(ts, '%Y-%m-%d') AS day, district_code, count(*) AS count FROM notice GROUP BY 1, 2",
    ),
    "stored_notices_page": with_(
        NOTICE,
        """SELECT id, epoch_ms(ts) AS scrape_timestamp, district_code, purchaser FROM notice
  WHERE ts >= TIMESTAMP '1997-02-01' AND ts < TIMESTAMP '1997-03-01' ORDER BY ts, id LIMIT 20""",
    ),
    "json_by_month": with_(
        NOTICE,
        """SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS notices,
  max(purchaser) AS last_purchaser FROM notice GROUP BY 1, 2""",
    ),
    "latest_of_stream": with_(NOTICE, "SELECT max(epoch_ms(ts)) AS latest_timestamp FROM notice"),
    "text_helpers": r"""SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS solid_chars,
  strpos(text, ' ') AS first_blank, coalesce(try_cast(nullif(regexp_extract(text, '^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)', 1), '') AS DOUBLE), 0) AS leading_number,
  text LIKE '%。%' OR text LIKE '%;%' AS has_mark FROM documents""",
}

OTHER["stored_upsert"] = OTHER["upsert"]


def _page_sql(offset: int, size: int, where: str = "true") -> str:
    return with_(
        NOTICE,
        f"""SELECT id, epoch_ms(ts) AS scrape_timestamp, purchaser FROM notice WHERE {where}
  ORDER BY ts, id LIMIT {size} OFFSET {offset}""",
    )


OTHER["closed_daily_counts"] = with_(
    NOTICE,
    """, timed AS (SELECT *, least((year(ts) - 1992) // 2 + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END, 3) AS file FROM notice),
  mark AS (SELECT f.file, (SELECT max(ts) FROM timed t WHERE t.file < f.file) - INTERVAL 2 DAY AS before, (SELECT max(ts) FROM timed) - INTERVAL 2 DAY AS final
    FROM (SELECT DISTINCT file FROM timed) f)
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, district_code, count(*) AS count,
    CASE WHEN date_trunc('day', ts) + INTERVAL 1 DAY <= before THEN 'late' WHEN date_trunc('day', ts) + INTERVAL 1 DAY <= final THEN 'closed' ELSE 'open' END AS part
  FROM timed t JOIN mark m ON t.file = m.file GROUP BY ALL""",
).replace(") ,", "),")
OTHER["deep_page"] = _page_sql(39 * 20, 20)
OTHER["next_page"] = _page_sql(40 * 20, 20)
OTHER["deep_city_page"] = _page_sql(5 * 10, 10, "district_code = 450100")


def all_statements() -> dict[str, str]:
    return {**REPORTS, **SERVING, **INGEST, **OTHER}
