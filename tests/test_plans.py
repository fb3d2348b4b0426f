"""What the plans must and must not hold, whatever the size of the tables."""

import re

from pyspark.sql import functions as F
import pytest

from tenderlake.operators import incremental, runs, store
from tenderlake.operators.extract import extract_items, extract_notices
from tenderlake.operators.schedules import due, make_schedules
from tenderlake.plans.batch import asked_pages, new_notices, through_filter
from tenderlake.plans.catalog.extraction import SITE_RECIPE
from tenderlake.plans.catalog.increments import run_time
from tenderlake.plans.views import Tables
from tenderlake.session import cut
from tenderlake.sources.results import append_new, table

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def shuffled(text: str) -> list[str]:
    """The input columns of every exchange."""
    return re.findall(r"\) (?:Broadcast)?Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", text)


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_html_is_never_shuffled(t, no_broadcast):
    items = extract_items(t.site_pages(), [SITE_RECIPE])
    resolved = incremental.resolve_links(incremental.new_items(items, t.prior()))
    notices = new_notices(cut(resolved), t.detail_pages(), [SITE_RECIPE], run_time())
    for df in (resolved, notices, runs.run_stats(items, t.prior()), incremental.frontier(t.links(), t.pages)):
        moved = shuffled(plan(df))
        assert moved and not any("html" in columns for columns in moved)


def test_pages_are_reduced_before_the_scan_in_python(t):
    wanted = t.detail_pages().select(F.col("url").alias("resolved"), F.lit("site").alias("recipe_id")).limit(3)
    text = plan(extract_notices(asked_pages(cut(wanted), t.detail_pages()), [SITE_RECIPE]))
    assert text.index("BroadcastHashJoin") > text.index("MapInArrow")  # the tree prints from the top


def test_only_named_columns_are_read(t):
    text = plan(incremental.frontier(t.links(), t.pages))
    assert set(re.findall(r"ReadSchema: (\S+)", text)) == {"struct<page_id:bigint,url:string>", "struct<url:string>"}
    text = plan(runs.task_state(t.updates()))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text


def test_filters_reach_the_scan(t):
    text = plan(store.find_scrapers(t.customer, c_mktsegment="BUILDING"))
    assert "EqualTo(c_mktsegment,BUILDING)" in text


def test_stored_results_are_read_by_partition(spark, t, tmp_path):
    items = cut(t.hashed_items())
    append_new(items, str(tmp_path / "r"))
    few = cut(items.filter(F.col("scraper") == items.first().scraper))
    stored = table(spark, str(tmp_path / "r"), items.schema).read()
    text = plan(incremental.new_items(few, incremental.prior_of(few, stored)))
    assert re.search(r"PartitionFilters: \[[^\n]*scraper_bucket", text)
    assert "ReadSchema: struct<scraper:string,_hash:string>" in text


def test_progress_needs_no_window_over_rows(t):
    """Ranges hand on one row each; the rows themselves are compared in one pass over stored ranges."""
    text = plan(runs.changed_progress(t.progress()))
    windows = re.findall(r"\) Window\nInput \[\d+\]: \[([^\n]*)\]", text)
    assert len(windows) == 1 and "totalBiddings" not in windows[0].replace("last#", "")
    assert "BroadcastHashJoin" in text and not re.search("CartesianProduct|NestedLoop|BatchEvalPython", text)


def test_pages_let_through_in_error(spark):
    """The filter's share of errors does not grow with the addresses, and it never stops a wanted page."""
    page = lambda n, start: spark.range(start, start + n).select(F.concat(F.lit("http://h.example/"), "id").alias("url"))
    for count in (1_000, 300_000):
        wanted = cut(page(count, 0))
        assert through_filter(wanted, page(count, 0), count).count() == count
        assert through_filter(wanted, page(100_000, 10_000_000), count).count() < 2_000


def test_top_rows_need_no_full_sort(t):
    assert "TakeOrderedAndProject" in plan(store.last_run(t.scrapers()))


def test_joins_are_equalities(t, no_broadcast):
    made, _ = make_schedules(t.schedule_requests())
    for df in (
        due(made, t.ticks()),
        incremental.known_items(t.hashed_items(), t.prior(), "seq"),
        store.pending_with_scraper(t.results(), t.scrapers()),
    ):
        text = plan(df)
        assert "SortMergeJoin" in text and not re.search("CartesianProduct|NestedLoop|BatchEvalPython", text)


def test_schedules_are_not_broadcast(spark, tmp_path):
    """A small file may hold many schedules: its size says nothing of what a broadcast would take in the driver."""
    key = F.col("id")
    requests = spark.range(0, 60_000, 1, 1).select(
        F.concat(F.lit("s"), key).alias("scraper"), F.concat_ws(" ", key % 60, key % 24, F.lit("* * 1")).alias("cron"),
        F.when(key % 2 == 0, "weekly").otherwise("daily").alias("frequency"),
    )
    made = cut(make_schedules(requests)[0])
    moments = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-08', interval 1 minute)) AS tick")
    for ticks in (moments, moments.limit(3)):
        text = plan(due(made, ticks))
        assert "SortMergeJoin" in text and "Broadcast" not in text
    # 2024-01-01 is a Monday: a daily schedule is due on seven days, a weekly one on the first alone, but for midnight.
    counts = due(made, moments).groupBy("frequency", F.col("minute_of_day") == 0).count().collect()
    assert {tuple(r) for r in counts} == {("weekly", False, 29_500), ("daily", False, 210_000), ("weekly", True, 1_000)}


def test_lookups_start_from_a_shuffle(t, no_broadcast):
    """No aggregate between the last shuffle and the join: else a hot partition could not be split."""
    text = plan(incremental.known_items(t.hashed_items(), t.prior(), "seq"))
    tree = text.split("\n\n")[0]
    below = re.findall(r"SortMergeJoin[^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange", tree)
    assert len(below) == 1 and re.search(r"\+- Sort [^\n]*\n\s+\+- Exchange [^\n]*\n[^\n]*SortAggregate", tree)
