"""Every operator as a query over the given tables, next to the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tenderlake.plans.views import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The views of tenderlake.plans.views in SQL, by name and in order of use.
VIEWS = {
    "v_items": r"""
      SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS scraper, CAST(p - 1 AS INT) AS pos,
        regexp_extract(it, '<a href="([^"]*)"', 1) AS link, regexp_extract(it, '<a [^>]*>(.*?)</a>', 1) AS "text"
      FROM (SELECT page_id, url, unnest(l) AS it, generate_subscripts(l, 1) AS p
            FROM (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
                    '(?s)<li>(.*?)</li>', 1) AS l FROM pages))""",
    "v_listed": r"""
      SELECT page_id, url, unnest(flatten(list_transform(
        regexp_extract_all(html, '(?is)<nav(?:[ \t\n\f\r/][^>]*)?>(.*?)(?:</nav[ \t\n\f\r]*>|\z)', 1),
        lambda menu: regexp_extract_all(menu, '(?i)<li(?:[ \t\n\f\r/][^>]*)?>')))) AS tag FROM pages""",
    "v_hashed": "SELECT *, md5(link) AS _hash FROM v_items",
    "v_prior": """
      SELECT scraper, _hash, concat('r', page_id, '-', pos) AS id, page_id * 1000 + pos AS seq
      FROM v_hashed WHERE page_id % 3 = 0""",
    "v_links": """
      SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat(url, '/missing') ELSE url END AS link FROM pages""",
    "v_details": r"""
      SELECT page_id, html, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1),
        regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1)) AS url FROM pages""",
    "v_chain": """
      SELECT page_id, scraper AS host, url, lead(url) OVER (PARTITION BY scraper ORDER BY page_id) AS next_url,
        row_number() OVER (PARTITION BY scraper ORDER BY page_id) = 1 AS is_seed
      FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS scraper FROM pages)""",
    "v_scraper": """
      SELECT concat('s', c_custkey) AS id, c_name AS name, n_name AS city, c_acctbal < 0 AS running,
        false AS hidden, l AS "lastRunDate"
      FROM customer JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS l FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""",
    "v_result": """
      SELECT concat('r', o_orderkey) AS id, concat('s', o_custkey) AS scraper,
        md5(concat(o_orderkey, o_orderpriority, o_orderstatus)) AS _hash, CAST(o_orderkey % 8 AS INT) AS modality,
        CAST(o_orderkey AS VARCHAR) AS number, o_orderpriority AS agency,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS "openDate", o_orderstatus = 'F' AS approved,
        o_totalprice AS amount FROM orders""",
    "v_schedule": """
      SELECT concat('s', p_partkey) AS scraper, CASE WHEN p_size % 2 = 0 THEN 'weekly' ELSE 'daily' END AS frequency,
        CASE p_partkey % 10 WHEN 0 THEN '5 45 7 * * 2-4' WHEN 1 THEN '0 5,35 9 ? 11 TUE'
          WHEN 2 THEN '0 20 18 ? * WED-SAT' WHEN 3 THEN 'not cron'
          WHEN 4 THEN concat(p_partkey % 70, ' 5 * * 1') WHEN 5 THEN '*/5 0 * XYZ 1'
          ELSE concat(p_partkey % 60, ' ', p_partkey % 24, ' * * ', p_partkey % 7) END AS cron FROM part""",
    "v_ticks": "SELECT DISTINCT date_trunc('minute', ts) AS tick FROM events",
    "v_progress": """
      SELECT user_id AS task, event_id AS seq, ts, event_id % 20 >= 1 AS "isRunning",
        CAST(floor(value / 10) AS INT) AS "totalBiddings", CAST(floor(value / 20) AS INT) AS "totalExtracted",
        CAST(floor(value / 20) AS INT) AS "currentBidding", CAST(floor(value / 30) AS INT) AS "newBiddings",
        CAST(event_id % 3 AS INT) AS "currentTask", event_type AS message FROM events""",
    "v_updates": """
      SELECT user_id AS task, event_id AS seq, ts,
        CASE WHEN event_type = 'signup' THEN true WHEN event_type = 'error' THEN false END AS running,
        CASE event_type WHEN 'error' THEN 503 WHEN 'purchase' THEN 203 WHEN 'view' THEN 204 END AS code,
        CASE WHEN event_type <> 'click' THEN event_type END AS message FROM events""",
    "v_files": """
      SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('http://x.example/', doc_id) END AS uri,
        CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR) END AS id,
        CASE WHEN doc_id % 3 = 1 THEN concat('f', doc_id) END AS filename,
        CASE doc_id % 7 WHEN 0 THEN 'zip' WHEN 1 THEN 'rar' WHEN 2 THEN 'doc' WHEN 3 THEN 'docx' WHEN 4 THEN 'pdf'
          WHEN 5 THEN 'odt' WHEN 6 THEN 'PDF' END AS format, CAST(doc_id % 4 AS INT) - 1 AS "fileIndex" FROM documents""",
    "v_request": """
      SELECT o_orderkey AS task, CASE WHEN o_orderkey % 4 = 0 THEN concat('http://a.example/', o_orderkey) END AS uri,
        CASE WHEN o_orderkey % 6 <> 0 THEN 'http://b.example/' END AS "baseURI",
        CASE WHEN o_orderkey % 5 = 0 THEN 'q.aspx' END AS "postURI",
        CASE o_orderkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method,
        CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '$today' WHEN 2 THEN '$lastRunDate' WHEN 3 THEN '$nextYear'
          WHEN 4 THEN '$other' ELSE '14/10/2016' END AS form_value, concat('s', o_custkey) AS scraper FROM orders""",
}
NEEDS = {"v_hashed": ["v_items"], "v_prior": ["v_hashed"]}


def _with_views(sql: str) -> str:
    """Put the views the SQL names in front of it. A WITH of its own must come as ``{views}``."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for needed in NEEDS.get(name, []):
            want(needed)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if name in sql:
            want(name)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    if "{views}" in sql:
        return sql.replace("{views}", f"{views}," if views else "")
    return f"WITH {views}\n{sql}" if views else sql


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the tables, with the SQL of the same result."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = _with_views(sql)
        return build

    return register


for _module in ("extraction", "values", "increments", "store", "runs", "schedules", "requests", "files", "streams"):
    import_module(f"{__name__}.{_module}")
