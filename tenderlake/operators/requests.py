"""Planning tables for the requests a crawler outside Spark would issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.notice import date_text
from tenderlake.functions.text import present
from tenderlake.operators.ordered import with_running_sum

MIN_DELAY = 1000


def expand_value(value: Column, last_run: Column, run_date: Column) -> Column:
    """A form value with ``$lastRunDate``, ``$today`` and ``$nextYear`` filled in."""
    today = date_text(run_date)
    next_year = date_text(F.date_add(run_date, 365))
    filled = (
        F.when(value.contains("lastRunDate"), F.coalesce(date_text(last_run), today))
        .when(value.contains("today"), today)
        .when(value.contains("nextYear"), next_year)
        .otherwise(value)
    )
    return F.when(value.startswith("$"), filled).otherwise(value)


def expand_params(tasks: DataFrame, scrapers: DataFrame, run_date: Column) -> DataFrame:
    """Expand the ``form`` map of POST tasks; the last run comes from the task's scraper."""
    runs = scrapers.select(F.col("id").alias("scraper"), F.col("lastRunDate").alias("__last"))
    joined = tasks.join(runs, "scraper", "left")
    filled = F.transform_values("form", lambda _, v: expand_value(v, F.col("__last"), run_date))
    form = F.when(F.col("method") == "POST", filled).otherwise(F.col("form"))
    return joined.withColumn("form", form).select(*tasks.columns)


def merge_form(base: Column, state: Column) -> Column:
    """Both maps in one; where a key is in both, ``state`` wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(state, k))
    return F.when(state.isNull(), base).when(base.isNull(), state).otherwise(F.map_concat(kept, state))


def session_uri(base_uri: Column, get_uri: Column) -> Column:
    """Address of a session request; NULL without a base, which is an error there."""
    return F.when(present(base_uri), F.concat(base_uri, F.coalesce(get_uri, F.lit(""))))


def plan_requests(tasks: DataFrame) -> DataFrame:
    """Add ``request_uri``, ``request_method`` and ``error`` to rows of uri, baseURI, postURI, method, form."""
    uri, base, post = F.col("uri"), F.col("baseURI"), F.col("postURI")
    target = F.when(present(uri), uri).when(present(base), base)
    posted = present(post)
    method = F.when(posted, "POST").when(present(F.col("method")), F.col("method")).otherwise("GET")
    error = F.when(target.isNull(), "no_uri").when((method == "POST") & F.col("form").isNull(), "no_form")
    return tasks.withColumns(
        {
            "request_uri": F.when(error.isNull(), F.when(posted, F.concat(target, post)).otherwise(target)),
            "request_method": F.when(error.isNull(), method),
            "error": error,
        }
    )


def request_delay(delay: Column, randomize: Column, unit: Column) -> Column:
    """Delay before a request in ms; NULL where the configured delay is too short.

    Without ``randomize`` the configured delay is not used at all.
    """
    given = F.coalesce(F.nullif(delay.try_cast("double"), F.lit(0.0)), F.lit(float(MIN_DELAY)))
    spread = F.round(unit * (given - MIN_DELAY) + MIN_DELAY).cast("bigint")
    return F.when(given >= MIN_DELAY, F.when(randomize, spread).otherwise(MIN_DELAY).cast("bigint"))


def crawl_plan(requests: DataFrame) -> DataFrame:
    """Add ``wait_ms`` and ``start_ms``: when each of a recipe's requests starts, one after the other.

    ``(recipe, seq, delay, randomizeDelay)`` rows in; the random part derives from recipe and seq, so
    a plan repeats.
    """
    digits = F.substring(F.md5(F.concat("recipe", F.col("seq").cast("string"))), 1, 4)
    unit = F.conv(digits, 16, 10).cast("double") / 65536
    waits = requests.withColumn("wait_ms", request_delay(F.col("delay"), F.col("randomizeDelay"), unit))
    return with_running_sum(waits, "recipe", "seq", F.col("wait_ms"), "start_ms")
