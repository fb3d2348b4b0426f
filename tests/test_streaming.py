"""Streams in several micro-batches against the batch operators."""

from pyspark.sql import functions as F

from tenderlake.operators import incremental, runs, schedules
from tenderlake.operators.extract import extract_items
from tenderlake.plans.catalog import QUERIES, streams
from tenderlake.plans.catalog.extraction import SITE_RECIPE
from tenderlake.plans.views import Tables, tick
from tenderlake.streaming import jobs
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


def in_parts(spark, df, path, order, parts):
    """Write ``df`` as files that follow each other in ``order``, and stream them one by one."""
    bounds = df.stat.approxQuantile(order, [i / parts for i in range(parts + 1)], 0.0)
    for i in range(parts):
        low, high = bounds[i], bounds[i + 1]
        last = i == parts - 1
        part = df.filter((F.col(order) >= low) & ((F.col(order) <= high) if last else (F.col(order) < high)))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_progress(spark, tmp_path):
    t = Tables(spark, FOLDER)
    stream = in_parts(spark, t.events, str(tmp_path / "in"), "event_id", 4)
    run = jobs.stream_progress(t.progress(stream), str(tmp_path / "job"))
    run.awaitTermination()
    assert run.lastProgress.batchId >= 3
    got = spark.read.parquet(str(tmp_path / "job/out")).drop("batch")
    assert same(got, runs.changed_progress(t.progress()))


def test_new_items_follow_each_other(spark, tmp_path):
    t = Tables(spark, FOLDER)
    stream = in_parts(spark, t.site_pages(), str(tmp_path / "in"), "page_id", 3)
    jobs.stream_new_items(stream, [SITE_RECIPE], str(tmp_path / "job")).awaitTermination()
    got = jobs.stored_items(spark, str(tmp_path / "job")).read()
    everything = extract_items(t.site_pages(), [SITE_RECIPE]).select("scraper", "_hash").distinct()
    assert same(got.select("scraper", "_hash").distinct(), everything)
    # A key stored by one batch is not taken up by a later one: all its rows are of one batch of pages.
    assert got.count() < t.items().count()


def test_due(spark, tmp_path):
    t = Tables(spark, FOLDER)
    made, _ = schedules.make_schedules(t.schedule_requests())
    stream = in_parts(spark, t.events.select("event_id", tick().alias("tick")), str(tmp_path / "in"), "event_id", 3)
    jobs.stream_due(stream, made, str(tmp_path / "job")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "job/out")).drop("batch")
    assert same(got, schedules.due(made, t.ticks()))


def test_task_state_leaves_and_starts_anew(spark, tmp_path):
    rows = [
        (1, 1, 0, True, None, "one"), (2, 2, 1, True, 204, "two"), (1, 3, 2, False, 203, None),
        (2, 4, 9, None, None, "more"),
        (1, 5, 11, None, None, "again"),
    ]
    df = spark.createDataFrame(rows, "task long, seq long, s int, running boolean, code int, message string")
    df = df.select("task", "seq", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("ts"), "running", "code", "message")
    path, seen = str(tmp_path / "in"), []
    for low, high in ((1, 3), (4, 4), (5, 5)):
        df.filter(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).parquet(path)
        for _ in range(2):  # the second start finds nothing new
            jobs.stream_task_state(stream, str(tmp_path / "job")).awaitTermination()
        state = jobs.current_state(spark, str(tmp_path / "job"), df)
        seen.append({r.task: (r.running, r.code, r.message) for r in state.collect()})
    assert seen == [
        {1: (False, 203, "one"), 2: (True, 204, "two")},
        {2: (True, 204, "more")},
        {1: (None, None, "again"), 2: (True, 204, "more")},
    ]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A step overwrites what a failed attempt of the same batch left behind."""
    t = Tables(spark, FOLDER)
    root = str(tmp_path)
    halves = [t.events.filter("event_id < 500"), t.events.filter("event_id >= 500")]
    step = jobs.progress_step(root)
    for number, attempts in ((0, 2), (1, 3)):
        for _ in range(attempts):
            step(t.progress(halves[number]), number)
    got = spark.read.parquet(f"{root}/out").drop("batch")
    assert same(got, runs.changed_progress(t.progress()))


def test_repeated_batch_of_items(spark, tmp_path):
    """Copies within a batch stay when it is repeated, and another run adds nothing."""
    t = Tables(spark, FOLDER)
    root = str(tmp_path)
    for run in ("first", "first", "other"):
        jobs.new_items_step([SITE_RECIPE], root, run)(t.site_pages(), 0)
    columns = ["page_id", "scraper", "pos", "link", "_hash"]
    assert same(jobs.stored_items(spark, root).read().select(columns), t.hashed_items().select(columns))


def test_due_takes_a_stream_of_ticks(spark, tmp_path):
    t = Tables(spark, FOLDER)
    made, _ = schedules.make_schedules(t.schedule_requests())
    t.ticks().coalesce(1).write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(t.ticks().schema).parquet(str(tmp_path / "in"))
    out = schedules.due(made, ticks).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    out.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert same(spark.read.parquet(str(tmp_path / "out")), schedules.due(made, t.ticks()))


def test_stream_equals_sequence_of_batches(spark):
    """New items of two page sets in turn, as the stream does it."""
    t = Tables(spark, FOLDER)
    items = t.hashed_items()
    first, second = items.filter("page_id < 25"), items.filter("page_id >= 25")
    fresh = incremental.new_items(second, incremental.identified(first))
    keys = first.select("scraper", "_hash").distinct()
    assert fresh.join(keys, ["scraper", "_hash"], "left_semi").isEmpty()


def test_late_updates_of_a_finished_task(spark, tmp_path):
    """A task finishes in the first file; what comes for it in later ones is folded with all before it."""
    kinds = ["signup", "view", "error", *["click"] * 3, "purchase", *["click"] * 5]
    rows = [(i, i * 60, 1 if i in (0, 1, 2, 6, 11) else 2, kind) for i, kind in enumerate(kinds)]
    rows += [(i, i * 60, 3, kind) for i, kind in ((12, "error"), (13, "view"), (14, "signup"), (15, "click"))]
    events = spark.createDataFrame(rows, "event_id long, s int, user_id long, event_type string")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("ts")
    events = events.select("event_id", at, "user_id", "event_type", F.lit(1.0).alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (next((tmp_path / "parts").glob("*.parquet"))).rename(tmp_path / "events.parquet")
    assert compare(spark, duck(str(tmp_path)), str(tmp_path), "stream_task_state") is None


def test_parts_are_written_by_several_tasks(spark, tmp_path):
    """A part of a table in several files comes as several files, in one batch of its own."""
    Tables(spark, FOLDER).events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    seen = []

    def start(stream):
        count = lambda batch, _: seen.append((batch.select(F.input_file_name()).distinct().count(), batch.count()))
        run = stream.writeStream.foreachBatch(count).option("checkpointLocation", str(tmp_path / "c"))
        return run.trigger(availableNow=True).start()

    t = Tables(spark, str(tmp_path))
    streams._streamed(t, "events", "event_id", start)
    assert len(seen) == streams.FILES and sum(rows for _, rows in seen) == t.events.count()
    assert min(files for files, _ in seen) > 1


def test_schedules_are_made_once(spark, monkeypatch):
    """The stream of ticks reads stored schedules: no batch works them out anew."""
    given = []
    real = jobs.stream_due
    monkeypatch.setattr(jobs, "stream_due", lambda ticks, schedules, root: given.append(schedules) or real(ticks, schedules, root))
    QUERIES["stream_due"](spark, FOLDER)
    assert len(given) == streams.FILES and all("cut-" in f for s in given for f in s.inputFiles())
