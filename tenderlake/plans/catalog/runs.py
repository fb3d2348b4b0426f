"""F: counters, reports, progress, task state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators import runs as R
from tenderlake.operators.incremental import join_details, new_items, resolve_links
from tenderlake.plans.catalog import query
from tenderlake.plans.catalog.increments import run_time
from tenderlake.plans.views import Tables

# Every seventh page lists nothing: it counts as read all the same.
STATS_SQL = r"""
      SELECT p.scraper, coalesce("totalBiddings", 0) AS "totalBiddings", coalesce("newBiddings", 0) AS "newBiddings",
        coalesce("totalExtracted", 0) AS "totalExtracted", "totalPages"
      FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS scraper, count(*) AS "totalPages" FROM pages GROUP BY 1) p
      LEFT JOIN (SELECT scraper, count(*) AS "totalBiddings", count(*) FILTER (WHERE fresh) AS "newBiddings",
                   count(*) FILTER (WHERE fresh AND resolved IN (SELECT url FROM v_details)) AS "totalExtracted"
                 FROM (SELECT *, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), link) AS resolved,
                         NOT EXISTS (SELECT 1 FROM v_prior p WHERE p.scraper = i.scraper AND p._hash = i._hash) AS fresh
                       FROM v_hashed i WHERE page_id % 7 <> 0)
                 GROUP BY scraper) c ON c.scraper = p.scraper
"""


def _stats(t: Tables) -> DataFrame:
    items = t.hashed_items().filter("page_id % 7 <> 0")
    resolved = resolve_links(new_items(items, t.prior()))
    notices = join_details(resolved, t.detail_pages().select("page_id", "url"), "resolved")
    pages = t.site_pages().select("page_id", "url", "scraper", F.lit(-1).alias("pos"))
    return R.run_stats(items.unionByName(pages, allowMissingColumns=True), t.prior(), notices)


@query(STATS_SQL)
def run_stats(t: Tables) -> DataFrame:
    return _stats(t)


SHORT_TEMPLATE = "%scraper_name% %execution_time%: %new_biddings%/%found_biddings%/%found_biddings% (%scraper_name%) %year%"


@query(
    f"""
    SELECT scraper, concat(scraper, ' Mon Jan 01 2024: ', "newBiddings", '/', "totalBiddings", '/%found_biddings% (',
      scraper, ') 2024') AS report FROM ({STATS_SQL})
    """
)
def run_report(t: Tables) -> DataFrame:
    link = F.concat(F.lit("https://reports.example/"), "scraper")
    reports = R.render_report(_stats(t), SHORT_TEMPLATE, run_time(), F.col("scraper"), link)
    return reports.select("scraper", "report")


PROGRESS_SQL = """
    SELECT task, seq, ts, "isRunning", "totalBiddings", "totalExtracted", "currentBidding", "newBiddings",
      "currentTask", message
    FROM (SELECT *, lag(x) OVER (PARTITION BY task ORDER BY seq) AS y
          FROM (SELECT *, concat_ws('|', "isRunning", "totalBiddings", "totalExtracted", "currentBidding",
                  "newBiddings", "currentTask", message) AS x FROM v_progress))
    WHERE y IS NULL OR x <> y
"""


@query(PROGRESS_SQL)
def progress_changes(t: Tables) -> DataFrame:
    return R.changed_progress(t.progress())


STATE_SQL = """
    SELECT task, arg_max(running, seq) FILTER (WHERE running IS NOT NULL) AS running,
      arg_max(code, seq) FILTER (WHERE code IS NOT NULL) AS code,
      arg_max(message, seq) FILTER (WHERE message IS NOT NULL) AS message FROM v_updates GROUP BY task
"""


@query(STATE_SQL)
def task_state(t: Tables) -> DataFrame:
    return R.task_state(t.updates())


@query(
    f"""
    WITH {{views}} s AS ({STATE_SQL}),
      p AS (SELECT task, seq, row_number() OVER (PARTITION BY task ORDER BY seq) AS n
            FROM (SELECT user_id % 700 AS task, event_id AS seq FROM events WHERE event_type = 'view'))
    SELECT p.task, p.seq, 'answer' AS kind, CASE WHEN s.running OR n = 1 THEN s.running END AS running,
      CASE WHEN s.running OR n = 1 THEN s.code END AS code,
      CASE WHEN s.task IS NOT NULL AND (s.running OR n = 1) THEN s.message
        ELSE 'Nenhum processo em execução.' END AS message
    FROM p LEFT JOIN s ON s.task = p.task
    UNION ALL
    SELECT s.task, NULL, 'left', s.running, s.code, s.message FROM s
    WHERE s.running OR s.task NOT IN (SELECT task FROM p)
    """
)
def task_poll(t: Tables) -> DataFrame:
    """Every view event polls a task."""
    polls = t.events.filter("event_type = 'view'").select(
        (F.col("user_id") % 700).alias("task"), F.col("event_id").alias("seq")
    )
    answers, remaining = R.poll(R.task_state(t.updates()), polls)
    left = remaining.withColumn("kind", F.lit("left"))
    return answers.withColumn("kind", F.lit("answer")).unionByName(left, allowMissingColumns=True)


@query(
    """
    SELECT CASE code WHEN 503 THEN 'ERROR_EXTRACTION' WHEN 203 THEN 'SUCCESS_EXTRACTION'
      WHEN 204 THEN 'SUCCESS_DOWNLOAD' END AS result, count(*) AS n FROM v_updates GROUP BY 1
    """
)
def result_codes(t: Tables) -> DataFrame:
    return t.updates().groupBy(R.result_class(F.col("code")).alias("result")).agg(F.count(F.lit(1)).alias("n"))
