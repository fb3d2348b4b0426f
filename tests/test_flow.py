"""Skew, buckets, chains, the store, and the whole run."""

from pyspark.sql import Window
from pyspark.sql import functions as F
import pyarrow as pa
import pytest

from tenderlake.operators import archives, chains, incremental, ordered, runs, store
from tenderlake.operators.joins import lookup
from tenderlake.plans.batch import run_batch, store_batch
from tenderlake.plans.catalog import QUERIES, files
from tenderlake.plans.catalog.extraction import SITE_RECIPE
from tenderlake.plans.catalog.increments import run_time
from tenderlake.plans.views import Tables
from tenderlake.sources.results import append_results, read_results

FOLDER = "/root/testdata/sf0.001"


def test_hot_key_is_split(spark):
    """A key with a third of the rows: the join reads its partition in parts."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = spark.range(0, 60000, 1, 8).select(
            F.lit("s").alias("scraper"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("_hash"),
            F.col("id").alias("pos"),
        )
        prior = rows.filter("pos % 2 = 0").withColumn("seq", F.col("pos"))
        for found, count in (
            (incremental.new_items(rows, prior), 20000),
            (incremental.known_items(rows, prior, "seq"), 40000),
        ):
            found.write.format("noop").mode("overwrite").save()
            assert found.count() == count
            counted = found.select("pos")
            counted.collect()
            assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_lookup_keeps_rows_without_key(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n int")
    table = spark.createDataFrame([("a", "x"), (None, "y")], "k string, v string")
    assert sorted(map(tuple, lookup(left, table, ["k"], "left").select("n", "v").collect())) == [(1, None), (2, "x")]
    assert [r.n for r in lookup(left, table, ["k"], "left_anti").collect()] == [1]


@pytest.mark.parametrize("batch", ["7", "500"])
def test_scan_equals_one_window(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 11 > 0, F.col("id") % 11).alias("k"),
        F.when(F.col("id") > 9, F.col("id") * F.col("id") * 3).alias("seq"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("v"),
    )
    w = Window.partitionBy("k").orderBy("seq")
    want = rows.select("k", "seq", F.lag("v").over(w).alias("p"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")).where("seq > 3000")
    got = ordered.with_previous(rows, "k", "seq", ["v"]).select("k", "seq", F.col("__prev.v").alias("p")).where("seq > 3000")
    assert got.exceptAll(want.drop("s")).isEmpty() and want.drop("s").exceptAll(got).isEmpty()
    summed = ordered.with_running_sum(rows, "k", "seq", F.col("v"), "s").select("k", "seq", "s").where("seq > 3000")
    assert summed.exceptAll(want.drop("p")).isEmpty() and want.drop("p").exceptAll(summed).isEmpty()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def test_scan_of_one_key_with_equal_numbers(spark):
    rows = spark.range(100_000).select(F.lit("hot").alias("k"), F.lit(5).alias("seq"), F.col("id"), F.lit(1).alias("v"))
    spread = ordered._ranges(rows, "k", "seq").groupBy("__range").count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 50_000
    sums = ordered.with_running_sum(rows, "k", "seq", F.col("v"), "s")
    assert sums.agg(F.countDistinct("s"), F.min("s"), F.max("s")).first()[:] == (100_000, 1, 100_000)
    before = ordered.with_previous(rows, "k", "seq", ["id"])
    assert before.agg(F.countDistinct("__prev.id"), F.count_if(F.col("__prev").isNull())).first()[:] == (99_999, 1)


def test_chain(spark):
    """A long chain, a cycle, a shared end, a missing page, two pages of one address."""
    rows = [(f"a{i}", f"a{i + 1}", i == 0) for i in range(20)]
    rows += [("c0", "c1", True), ("c1", "c2", False), ("c2", "c0", False), ("d0", "a18", True), ("e0", "gone", True), ("f0", None, True)]
    pages = spark.createDataFrame(rows, "url string, next_url string, is_seed boolean")
    got = {}
    for row in chains.page_chain(pages, F.col("is_seed")).collect():
        got.setdefault(row.seed_url, {})[row.depth] = row.url
    assert got == {
        "a0": {i + 1: f"a{i}" for i in range(20)},
        "c0": {1: "c0", 2: "c1", 3: "c2"},
        "d0": {1: "d0", 2: "a18", 3: "a19"},
        "e0": {1: "e0"},
        "f0": {1: "f0"},
    }


def test_long_chain_and_last_fetch(spark):
    """A chain and a cycle of well over a thousand pages; an older fetch names another next page."""
    rows = [(i, f"a{i:04}", f"a{i + 1:04}", i == 0) for i in range(1500)]
    rows += [(2000 + i, f"c{i:04}", f"c{(i + 1) % 1100:04}", i == 0) for i in range(1100)]
    rows += [(-1, "a0007", "z", False)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, next_url string, is_seed boolean")
    got = {}
    for row in chains.page_chain(pages, F.col("is_seed")).collect():
        got.setdefault(row.seed_url, {})[row.depth] = row.url
    assert got["a0000"] == {i + 1: f"a{i:04}" for i in range(1500)}
    assert got["c0000"] == {i + 1: f"c{i:04}" for i in range(1100)}


def test_first_new_link_decides(spark):
    rows = [(1, "http://h.example/p", 3, "t$1"), (1, "http://h.example/p", 5, "/x"), (2, "http://h.example/p", 0, "/y"), (2, "http://h.example/p", 1, "t$2")]
    items = spark.createDataFrame(rows, "page_id bigint, url string, pos int, link string")
    responses = spark.createDataFrame([("http://h.example/p", "t$1", "http://h.example/f")], "page_url string, event_target string, final_url string")
    got = incremental.resolve_links(items, responses, F.lit(True)).orderBy("page_id", "pos").collect()
    assert [r.resolved for r in got] == ["http://h.example/f", None, "http://h.example/y", "http://h.example/t$2"]
    plain = incremental.resolve_links(items).orderBy("page_id", "pos").collect()
    assert plain[0].resolved == "http://h.example/t$1"


def test_last_fetch_of_a_page_counts(spark):
    items = spark.createDataFrame([("i", "u"), ("j", "u"), ("k", "v")], "n string, link string")
    details = spark.createDataFrame([(1, "u", "old"), (2, "u", "new")], "page_id bigint, url string, text string")
    got = incremental.join_details(items, details).orderBy("n").collect()
    assert [(r.n, r.detail.text) for r in got] == [("i", "new"), ("j", "new")]
    assert [r.link for r in incremental.frontier(items, details).collect()] == ["v"]


def test_run_twice_adds_nothing(spark, tmp_path):
    t = Tables(spark, FOLDER)
    path = str(tmp_path / "results")
    sizes = []
    for _ in range(2):
        batch = run_batch(t.site_pages(), t.detail_pages(), [SITE_RECIPE], read_results(spark, path), run_time())
        store_batch(batch, path)
        sizes.append(read_results(spark, path).count())
        counters = batch.stats.agg(F.sum("totalExtracted"), F.sum("totalBiddings"), F.sum("totalPages")).first()
    assert sizes[0] > 0 and sizes[1] == sizes[0]
    assert tuple(counters) == (0, batch.items.count(), 50)


def test_each_recipe_reads_its_own_details(spark):
    """Recipes that share an address: each item gets what its own recipe read, in whatever order they come."""
    from tenderlake.plans.batch import run_batch as run
    from tenderlake.sources.recipes import load_recipes, parse_recipes

    body = (
        '{"baseURI":"http://%s.example/","routine":[{"id":"GET_LINKS","list":true,"selectors":{"container":"ul","listItem":"li","link":"a"}},'
        '{"id":"GET_DETAILS","selectors":{"container":"body","number":"%s"}}]}'
    )
    bodies = spark.createDataFrame([("A", body % ("a", "h1")), ("B", body % ("b", "h2"))], "recipe_id string, body string")
    recipes = load_recipes(parse_recipes(bodies)[0])
    listing = '<body><ul><li><a href="http://d.example/1">x</a></li></ul></body>'
    lists = spark.createDataFrame(
        [(1, "http://a.example/l", listing), (2, "http://B.example/l", listing), (3, "http://none.example/l", listing)],
        "page_id bigint, url string, html string",
    )
    details = [(10, "http://d.example/1", recipe, "<body><h1>one</h1><h2>two</h2></body>") for recipe in "AB"]
    details = spark.createDataFrame(details, "page_id bigint, url string, recipe_id string, html string")
    none = spark.createDataFrame([], "scraper string, _hash string")
    for order in (recipes, recipes[::-1]):
        batch = run(lists, details, order, none, run_time())
        assert sorted((r.scraper, r.number) for r in batch.notices.collect()) == [("A", "one"), ("B", "two")]


def _recipes(spark, *bodies):
    from tenderlake.sources.recipes import load_recipes, parse_recipes

    return load_recipes(parse_recipes(spark.createDataFrame(list(bodies), "recipe_id string, body string"))[0])


LISTING = (
    '{"baseURI":"http://%s.example/","routine":[{"id":"GET_LINKS","list":true,"selectors":{"container":"ul","listItem":"li","link":"a",'
    '"nextPage":"a.next"}},{"id":"GET_DETAILS","selectors":{"container":"body","number":"%s"}}]}'
)
PAGE = "page_id bigint, url string, html string"


def test_details_on_a_foreign_host(spark):
    """One recipe or several: what a page is linked by reads it, wherever it lies."""
    a, b = _recipes(spark, ("A", LISTING % ("a", "h1")), ("B", LISTING % ("b", "h2")))
    listing = '<body><ul><li><a href="http://files.example/1">x</a></li></ul></body>'
    lists = spark.createDataFrame([(1, "http://a.example/l", listing), (2, "http://b.example/l", listing)], PAGE)
    details = spark.createDataFrame([(9, "http://files.example/1", "<body><h1>one</h1><h2>two</h2></body>")], PAGE)
    none = spark.createDataFrame([], "scraper string, _hash string")
    alone = run_batch(lists.filter("page_id = 1"), details, [a], none, run_time())
    both = run_batch(lists, details, [a, b], none, run_time())
    assert [(r.scraper, r.number) for r in alone.notices.collect()] == [("A", "one")]
    assert sorted((r.scraper, r.number) for r in both.notices.collect()) == [("A", "one"), ("B", "two")]
    assert both.to_fetch.isEmpty()
    # A page that was fetched for one recipe is still to be fetched for the other that asks for it.
    partly = run_batch(lists, details.withColumn("recipe_id", F.lit("B")), [a, b], none, run_time())
    assert [r.scraper for r in partly.notices.collect()] == ["B"]
    assert [r.link for r in partly.to_fetch.collect()] == ["http://files.example/1"]


def _listing(number, following):
    ahead = f'<a class="next" href="{following}">next</a>' if following else ""
    return (number, f"http://a.example/p{number}", f'<body><ul><li><a href="/n/{number}">x</a></li></ul>{ahead}</body>')


def test_pages_follow_each_other_over_three_runs(spark, tmp_path):
    from tenderlake.plans.job import store_chains, stored_chains

    recipes = _recipes(spark, ("A", LISTING % ("a", "h1")))
    details = spark.createDataFrame([], PAGE)
    none = spark.createDataFrame([], "scraper string, _hash string")
    path, frontiers = str(tmp_path / "chains"), []
    runs_ = [
        [_listing(1, "/p2"), _listing(2, "p3"), _listing(20, "/p21"), (30, "http://a.example/p30", "<body></body>")],
        [_listing(3, "/p4"), _listing(4, "/p5"), _listing(21, None)],
        [_listing(5, "/p2")],  # leads back: the chain ends
    ]
    for number, pages in enumerate(runs_):
        lists = spark.createDataFrame(pages, PAGE)
        batch = run_batch(lists, details, recipes, none, run_time(), chains=stored_chains(spark, path))
        frontiers.append(sorted(r.link.rpartition("/")[2] for r in batch.next_pages.collect()))
        assert batch.stats.first().totalPages == len(pages)
        for _ in range(2):  # storing again changes nothing
            store_chains(batch.chains, path, str(number))
    assert frontiers == [["p21", "p3"], ["p5"], []]
    rows = stored_chains(spark, path).pages.collect()
    short = sorted((r.seed_url.rpartition("/")[2], r.depth, r.url.rpartition("/")[2]) for r in rows)
    assert short == [("p1", i, f"p{i}") for i in range(1, 6)] + [("p20", 1, "p20"), ("p20", 2, "p21"), ("p30", 1, "p30")]


def test_runs_of_one_scraper_at_once(spark, tmp_path):
    from tenderlake.plans import job
    from tenderlake.sources.claims import Claims

    claims, moment = Claims(spark, str(tmp_path / "claims")), run_time()
    ids = spark.createDataFrame([("A",), ("B",)], "id string")
    with pytest.raises(RuntimeError), job.claimed(claims, ids, moment, "one") as first:
        with job.claimed(claims, ids, moment, "two") as second:
            assert second.isEmpty()
        assert sorted(r.id for r in first.collect()) == ["A", "B"]
        raise RuntimeError("the run fails")
    with job.claimed(claims, ids, moment, "three") as third:
        assert third.count() == 2
        recipes = _recipes(spark, ("A", LISTING % ("a", "h1")), ("C", LISTING % ("c", "h1")))
        pages = spark.createDataFrame([_listing(1, None), (2, "http://c.example/", "")], PAGE)
        assert [r.page_id for r in job.of_scrapers(pages, third, recipes).collect()] == [1]


def test_postbacks_become_requests_and_then_notices(spark):
    from tenderlake.plans.batch import run_batch as run
    from tenderlake.sources.recipes import load_recipes, parse_recipes

    body = (
        '{"aspnet":true,"delay":"2000","routine":[{"id":"GET_LINKS","list":true,"selectors":{"container":"ul","listItem":"li","link":"a"}},'
        '{"id":"GET_DETAILS","selectors":{"number":"h1"}}]}'
    )
    recipes = load_recipes(parse_recipes(spark.createDataFrame([("P", body)], "recipe_id string, body string"))[0])
    html = """<body><input id="__VIEWSTATE" value="vs"><ul><li><a href="javascript:__doPostBack('t$1','')">x</a></li></ul></body>"""
    lists = spark.createDataFrame([(1, "http://p.example/l", html)], "page_id bigint, url string, html string")
    details = spark.createDataFrame([(5, "http://p.example/d", "<body><h1>9/2020</h1></body>")], "page_id bigint, url string, html string")
    none = spark.createDataFrame([], "scraper string, _hash string")
    first = run(lists, details, recipes, none, run_time())
    (request,) = first.to_post.collect()
    assert (request.url, request.event_target, request.wait_ms) == ("http://p.example/l", "t$1", "2000")
    assert request.form["__EVENTTARGET"] == "t$1" and request.form["__VIEWSTATE"] == "vs"
    assert first.notices.collect() == []
    answers = spark.createDataFrame(
        [("http://p.example/l", "t$1", "http://p.example/old", 1), ("http://p.example/l", "t$1", "http://p.example/d", 2)],
        "page_url string, event_target string, final_url string, seq int",
    )
    second = run(lists, details, recipes, none, run_time(), answers)
    assert [r.number for r in second.notices.collect()] == ["9/2020"]
    assert second.to_post.collect() == []


def test_appends_of_missing_scrapers_repeat(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("", "h1"), (None, "h2"), ("s", "h3")], "scraper string, _hash string")
    for _ in range(3):
        append_results(rows, path)
    assert sorted((r.scraper, r._hash) for r in read_results(spark, path).collect()) == [("", "h1"), ("", "h2"), ("s", "h3")]


def test_keys_with_any_sign_stay_apart(spark):
    rows = spark.createDataFrame([("a", "b\x1fc"), ("a\x1fb", "c"), ("1:a", ""), ("1", ":a")], "scraper string, _hash string")
    stored = spark.createDataFrame([("a", "b\x1fc")], "scraper string, _hash string")
    assert incremental.new_items(rows.filter("_hash <> ''"), stored).count() == 2


def test_copies_within_a_run_stay(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("s", "h1"), ("s", "h1"), ("t", "h1"), ("s", "")], "scraper string, _hash string")
    append_results(rows, path)
    append_results(rows, path)
    assert read_results(spark, path).groupBy("scraper").count().orderBy("scraper").collect() == [("s", 2), ("t", 1)]


def test_pending_order(spark):
    rows = [("r1", "s", False, "2020-01-02"), ("r2", "s", False, None), ("r3", "s", True, "2020-01-01"), ("r4", "s", False, "2020-01-01")]
    results = spark.createDataFrame(rows, "id string, scraper string, approved boolean, d string")
    results = results.withColumn("openDate", F.col("d").cast("timestamp_ntz"))
    assert [r.id for r in store.pending(results, "s").collect()] == ["r2", "r4", "r1"]


def test_schedule_filters(spark):
    schedules = spark.createDataFrame([("s1", 1, "weekly"), ("s2", None, "daily")], "scraper string, weekday int, frequency string")
    scrapers = spark.createDataFrame([("s1", "One")], "id string, name string")

    def found(text):
        return sorted((r.scraper, r.scraper_name) for r in store.find_schedules(schedules, scrapers, text).collect())

    both = [("s1", "One"), ("s2", None)]
    assert found(None) == both and found("{") == both and found("[1]") == both
    assert found('{"weekday": 1}') == both[:1] and found('{"weekday": null}') == both[1:]
    assert found('{"weekday": "1"}') == both[:1] and found('{"weekday": "WED"}') == []
    with pytest.raises(ValueError):
        found('{"weekday": {"$gt": 0}}')
    assert found('{"nope": 1}') == [] and found('{"weekday": 1, "frequency": "daily"}') == []


def test_report_replaces_once_or_everywhere(spark):
    stats = spark.createDataFrame([("s", 3, 5, 2)], "scraper string, newBiddings long, totalBiddings long, totalExtracted long")
    template = "%scraper_name% %scraper_name% %new_biddings%%new_biddings% %found_biddings% %found_biddings% %year% %other% 100%"
    row = runs.render_report(stats, template, run_time(), F.lit("N"), F.lit("l")).first()
    assert row.report == "N N 33 5 %found_biddings% 2024 %other% 100%"
    html = runs.render_report(stats, runs.REPORT_TEMPLATE, run_time(), F.lit("N"), F.lit("l")).first().report
    assert "%" not in html and "Mon Jan 01 2024" in html


def test_poll(spark):
    state = spark.createDataFrame([(1, False, 203, "done"), (2, True, None, "busy"), (3, False, 1, "x")], "task long, running boolean, code int, message string")
    polls = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 13), (9, 14)], "task long, seq long")
    answers, left = runs.poll(state, polls)
    assert [r.message for r in answers.orderBy("seq").collect()] == ["done", runs.NO_TASK, "busy", "busy", runs.NO_TASK]
    assert sorted(r.task for r in left.collect()) == [2, 3]


def test_archives(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name in ("z.txt", "EDITAL/a.pdf", "edital.doc", "d/"):
            archive.writestr(name, "x" * len(name))
    rows = [("a", buffer.getvalue()), ("r", b"Rar!.."), ("n", b"none"), ("e", None)]
    listing = archives.list_archives(spark.createDataFrame(rows, "archive_id string, body binary"))
    got = sorted(map(tuple, listing.collect()), key=str)
    assert got == sorted(
        [("a", 0, "EDITAL/a.pdf", 12, "ok"), ("a", 1, "edital.doc", 10, "ok"), ("a", 2, "z.txt", 5, "ok"),
         ("r", None, None, None, "not_built"), ("n", None, None, None, "unreadable"), ("e", None, None, None, "unreadable")],
        key=str,
    )
    picked = {r.archive_id: (r.notice_idx, r.notice_name) for r in archives.pick_notice(listing).collect()}
    assert picked == {"a": (1, ""), "r": (-1, None), "n": (-1, None), "e": (-1, None)}


def test_job_over_folders(spark, tmp_path):
    """Two portals with their own recipes, chosen by page; the second run stores nothing more."""
    from tenderlake.plans.job import main

    html = '<nav><ul><li><a href="/n/1">1</a><li><a href="n/2">2</a></ul></nav>'
    pages = [(1, "http://h.example/l", "site", html), (2, "http://g.example/l", "other", html)]
    notice = "<article><h1>7/2017</h1><p>Objeto</p></article>"
    details = [(3, "http://h.example/n/1", "site", notice), (4, "http://h.example/x", "site", notice)]
    schema = "page_id bigint, url string, recipe_id string, html string"
    folders = {n: str(tmp_path / n) for n in ("list-pages", "detail-pages", "results", "frontier", "reports")}
    spark.createDataFrame(pages, schema).write.parquet(folders["list-pages"])
    spark.createDataFrame(details, schema).write.parquet(folders["detail-pages"])
    arguments = ["--recipes", "tests/fixtures/recipes", "--run-ts", "2024-01-01 06:00:00"]
    arguments += ["--chains", str(tmp_path / "chains"), "--claims", str(tmp_path / "claims")]
    for name, folder in folders.items():
        arguments += [f"--{name}", folder]
    for _ in range(2):
        main(arguments, spark)
        row = read_results(spark, folders["results"]).collect()
        assert [(r.scraper, r.number, r.description, r.website, r.amount) for r in row] == [
            ("site", "7/2017", "Objeto", "http://h.example/n/1", 0.0)
        ]
        assert [r.link for r in spark.read.parquet(folders["frontier"]).collect()] == ["http://h.example/n/2"]
    report = {r.scraper: r.report for r in spark.read.parquet(folders["reports"]).collect()}
    assert set(report) == {"site"} and "1 of 2 notices are new" in report["site"]


def test_run_of_scrapers(spark, tmp_path):
    from tenderlake.plans.job import run_scrapers

    t = Tables(spark, FOLDER)
    rows = [("s1", "One", "C", False), ("s2", "Two", "C", True), ("s3", "Three", "C", False)]
    scrapers = spark.createDataFrame(rows, "id string, name string, city string, running boolean")
    scrapers = scrapers.withColumns({"hidden": F.lit(False), "lastRunDate": F.lit(None).cast("timestamp_ntz")})
    ids = spark.createDataFrame([("s1",), ("s2",)], "id string")
    after, refused, batch = run_scrapers(
        scrapers, ids, t.site_pages(), t.detail_pages(), [SITE_RECIPE], str(tmp_path / "r"), "2024-01-01 06:00:00"
    )
    got = {r.id: (r.running, r.lastRunDate is not None) for r in after.collect()}
    assert got == {"s1": (False, True), "s2": (True, False), "s3": (False, False)}
    assert [r.id for r in refused.collect()] == ["s2"] and not batch.notices.isEmpty()


def test_recipes_of_new_scrapers(spark):
    from tenderlake.sources.recipes import find_recipe

    rows = [("a", "A", "C", '{"name": "x"}'), ("b", "", "C", "{}"), ("c", "C", "C", None)]
    bodies = store.inserted_recipes(spark.createDataFrame(rows, "id string, name string, city string, config string"))
    assert [tuple(r) for r in bodies.collect()] == [("a", '{"name": "x"}')]
    assert find_recipe(bodies, "a").count() == 1 and find_recipe(bodies, "b").count() == 0


def test_archives_are_zipped_one_by_one():
    """An archive leaves before the rows after it are read."""
    read = []

    def batches():
        for name in ("a", "a", "b", "c"):
            read.append(name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{len(read)}.txt"]), pa.array(["text"])], names=["archive_id", "path", "text"])

    made = files._zip(batches())
    first = next(made)
    assert first.column("archive_id").to_pylist() == ["a", "a.rar"]
    assert read == ["a", "a", "b"]
    assert [b.column("archive_id").to_pylist()[0] for b in made] == ["b", "c"]


def test_every_archive_is_picked_from(spark):
    """The zipped archives and their stubs have a row each, besides those of the sources."""
    t = Tables(spark, FOLDER)
    picked = QUERIES["archive_pick"](spark, FOLDER)
    archived = {r[0] for r in QUERIES["archive_listing"](spark, FOLDER).select("archive_id").distinct().collect()}
    sources = {r[0] for r in t.documents.select("source").distinct().collect()}
    assert {r.archive_id for r in picked.collect()} == archived | sources
    assert {r.notice_idx for r in picked.filter("archive_id LIKE '%.rar'").collect()} == {-1}
