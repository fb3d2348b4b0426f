"""H: request planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators import requests as H
from tenderlake.plans.catalog import query
from tenderlake.plans.catalog.increments import run_time
from tenderlake.plans.views import Tables


@query(
    """
    SELECT r.task, CASE WHEN method = 'POST' AND form_value = '$today' THEN '01/01/2024'
      WHEN method = 'POST' AND form_value = '$lastRunDate'
        THEN coalesce(strftime(s."lastRunDate", '%d/%m/%Y'), '01/01/2024')
      WHEN method = 'POST' AND form_value = '$nextYear' THEN '31/12/2024' ELSE form_value END AS value,
      '7' AS fixed
    FROM v_request r LEFT JOIN v_scraper s ON s.id = r.scraper
    """
)
def dynamic_params(t: Tables) -> DataFrame:
    form = F.create_map(F.lit("from"), F.col("form_value"), F.lit("kind"), F.lit("7"))
    tasks = t.requests().withColumn("form", form)
    expanded = H.expand_params(tasks, t.scrapers(), run_time())
    return expanded.select("task", F.col("form")["from"].alias("value"), F.col("form")["kind"].alias("fixed"))


@query(
    """
    SELECT event_id, k AS key, CASE k WHEN 'both' THEN CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'base' END
      WHEN 'base' THEN CAST(user_id AS VARCHAR) ELSE event_type END AS value
    FROM events, (VALUES ('both'), ('base'), ('state')) t(k) WHERE k <> 'state' OR event_id % 3 <> 2
    """
)
def form_merge(t: Tables) -> DataFrame:
    """State that overrides, that only adds, and none."""
    turn = F.col("event_id") % 3
    base = F.create_map(F.lit("both"), F.lit("base"), F.lit("base"), F.col("user_id").cast("string"))
    kind = F.col("event_type")
    adds = F.create_map(F.lit("state"), kind)
    state = F.when(turn == 0, F.create_map(F.lit("state"), kind, F.lit("both"), kind)).when(turn == 1, adds)
    return t.events.select("event_id", F.explode(H.merge_form(base, state)).alias("key", "value"))


@query(
    """
    SELECT task, CASE WHEN error IS NULL THEN concat(target, coalesce("postURI", '')) END AS request_uri,
      CASE WHEN error IS NULL THEN m END AS request_method, error, "baseURI" || 'home' AS session_uri
    FROM (SELECT *, CASE WHEN target IS NULL THEN 'no_uri' WHEN m = 'POST' AND form_value IS NULL THEN 'no_form' END AS error
          FROM (SELECT *, coalesce(uri, "baseURI") AS target,
                  CASE WHEN "postURI" IS NOT NULL THEN 'POST' ELSE coalesce(method, 'GET') END AS m FROM v_request))
    """
)
def request_plan(t: Tables) -> DataFrame:
    form = F.when(F.col("form_value").isNotNull(), F.create_map(F.lit("from"), F.col("form_value")))
    plan = H.plan_requests(t.requests().withColumn("form", form))
    session = H.session_uri(F.col("baseURI"), F.lit("home"))
    return plan.select("task", "request_uri", "request_method", "error", session.alias("session_uri"))


_PLAN_SQL = """
    SELECT recipe, seq, wait_ms, sum(wait_ms) OVER (PARTITION BY recipe ORDER BY seq) AS start_ms
    FROM (SELECT *, CASE WHEN d < 1000 THEN NULL WHEN NOT random THEN 1000
            ELSE CAST(round(CAST(concat('0x', substr(md5(concat(recipe, seq)), 1, 4)) AS INT) / 65536 * (d - 1000) + 1000) AS BIGINT)
            END AS wait_ms
          FROM (SELECT regexp_extract(link, '^[a-z]+://([^/?#]+)', 1) AS recipe, page_id AS seq,
                  CASE page_id % 4 WHEN 0 THEN 2000 WHEN 1 THEN 5000 WHEN 2 THEN 1000 ELSE 500 END AS d,
                  page_id % 3 <> 0 AS random FROM v_links))
"""


def _requests(t: Tables) -> DataFrame:
    page = F.col("page_id")
    delay = F.when(page % 4 == 0, "2000").when(page % 4 == 1, "5000").when(page % 4 == 2, "soon").otherwise("500")
    return t.links().select(
        F.regexp_extract("link", r"^[a-z]+://([^/?#]+)", 1).alias("recipe"),
        page.alias("seq"),
        delay.alias("delay"),
        (page % 3 != 0).alias("randomizeDelay"),
    )


@query(f"""SELECT recipe, seq, wait_ms, CAST(coalesce(start_ms, 0) AS BIGINT) AS start_ms FROM ({_PLAN_SQL})""")
def crawl_plan(t: Tables) -> DataFrame:
    return H.crawl_plan(_requests(t)).select("recipe", "seq", "wait_ms", "start_ms")
