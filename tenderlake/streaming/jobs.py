"""Streams as repeated micro-batch steps over the batch operators.

State lives in tables next to the output: a batch adds the rows of the keys it touched, under its own number, and
a step repeated after a failure finds them there. Steps aggregate before the shuffle and scan ordered work by
ranges, so a task that holds a third of the rows is split; what a batch reads of the state are the buckets of its keys.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tenderlake.operators.extract import extract_items
from tenderlake.operators.incremental import new_items, prior_of
from tenderlake.operators.joins import lookup
from tenderlake.operators.runs import STATE_FIELDS, changed_progress
from tenderlake.operators.schedules import due
from tenderlake.schemas import ITEM_FIELDS
from tenderlake.session import cut
from tenderlake.sources.recipes import Recipe
from tenderlake.sources.results import read_table
from tenderlake.sources.tables import LogTable, pruned

RETENTION_SECONDS = 5
ITEM_ROW = StructType(
    [
        StructField("page_id", LongType()),
        *(StructField(c, StringType()) for c in ("url", "scraper", "recipe_id")),
        StructField("pos", IntegerType()),
        *(StructField(c, StringType()) for c in ("link", *ITEM_FIELDS, "_hash")),
    ]
)


def _start(
    stream: DataFrame, root: str, step: Callable[[DataFrame, int], None], run: str = "checkpoint"
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", os.path.join(root, run))
        .trigger(availableNow=True)
        .start()
    )


def _version(root: str, name: str, batch: int) -> str:
    return os.path.join(root, name, f"batch={batch}")


def output(spark, root: str, schema) -> DataFrame:
    """All output rows of a job, empty while there are none."""
    return read_table(spark, os.path.join(root, "out"), schema)


def stored_items(spark, root: str) -> LogTable:
    """The items of a job: a base and small parts, one per batch until they are merged."""
    return LogTable(spark, os.path.join(root, "items"), ITEM_ROW)


def new_items_step(recipes: list[Recipe], root: str, run: str) -> Callable[[DataFrame, int], None]:
    def step(batch: DataFrame, number: int) -> None:
        items = cut(extract_items(batch, recipes))
        stored_items(batch.sparkSession, root).append(
            lambda stored: new_items(items, prior_of(items, stored)), f"{run}/{number}"
        )

    return step


def stream_new_items(pages: DataFrame, recipes: list[Recipe], root: str, run: str = "first") -> StreamingQuery:
    """Append the new items of each batch of pages to ``stored_items``; of what is stored only the two key columns
    of the batch's scrapers are read. A repeated batch adds nothing.

    A ``run`` of another name reads all pages again, as a repeated crawl would.
    """
    return _start(pages, root, new_items_step(recipes, root, run), f"checkpoint-{run}")


def _last_of_tasks(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each task."""
    rest = [c for c in rows.columns if c != "task"]
    last = rows.groupBy("task").agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
    return last.select("task", "row.*").select(*rows.columns)


def _task_table(spark, root: str, schema: StructType, fold: Callable[[DataFrame, str | None], DataFrame]) -> LogTable:
    """State by task: a batch adds the rows of the tasks it touched, merges keep the last of each."""
    return LogTable(spark, os.path.join(root, "state"), schema, "task", fold)


def _of_tasks(table: LogTable, rows: DataFrame) -> DataFrame:
    """Stored rows of the tasks of (materialised) ``rows``; of the others' buckets none is read."""
    stored = pruned(table.read(), rows, "task")
    return lookup(stored, rows.select("task").distinct(), ["task"], "left_semi")


def progress_step(root: str) -> Callable[[DataFrame, int], None]:
    def step(batch: DataFrame, number: int) -> None:
        table = _task_table(batch.sparkSession, root, batch.schema, lambda rows, _: _last_of_tasks(rows.select(*batch.columns), "seq"))
        if table.has(f"batch/{number}"):
            return  # its output was written before its state
        touched = cut(_last_of_tasks(batch, "seq"))
        last = _last_of_tasks(_of_tasks(table, touched).select(*batch.columns), "seq")
        rows = batch.withColumn("__old", F.lit(False)).unionByName(last.withColumn("__old", F.lit(True)))
        fresh = changed_progress(rows).filter(~F.col("__old")).drop("__old")
        fresh.write.mode("overwrite").parquet(_version(root, "out", number))
        table.append(lambda _: touched, f"batch/{number}")

    return step


def stream_progress(progress: DataFrame, root: str) -> StreamingQuery:
    """Append the changed snapshots of each batch, compared with the last snapshot of earlier ones.

    What a batch reads and writes of the state goes with the tasks it touches, one row each, also for a task that
    holds a third of the rows.
    """
    return _start(progress, root, progress_step(root))


def stamped_state(updates: DataFrame, fields: list[str] = STATE_FIELDS) -> DataFrame:
    """Per task the last supplied value of each field, with the order number and time it came at."""

    return updates.groupBy("task").agg(*_last_values(fields))


def _last_values(fields: list[str]) -> list[Column]:
    given = lambda f: F.when(F.col(f).isNotNull(), F.col("seq"))
    return [F.max_by(F.struct(f, "seq", "ts"), given(f)).alias(f) for f in fields]


def _as_updates(state: DataFrame, fields: list[str]) -> DataFrame:
    """Stamped state as updates again, one per field, to be folded with later ones. One without any field keeps
    the tasks that were given none yet."""
    kinds = {f: state.schema[f].dataType[f].dataType for f in fields}
    at = state.schema[fields[0]].dataType
    bare = {"seq": at["seq"].dataType, "ts": at["ts"].dataType, **kinds}
    parts = [state.select("task", *[F.lit(None).cast(kind).alias(c) for c, kind in bare.items()])]
    parts += [
        state.filter(F.col(f).isNotNull()).select(
            "task",
            F.col(f"{f}.seq").alias("seq"),
            F.col(f"{f}.ts").alias("ts"),
            *[(F.col(f"{f}.{f}") if g == f else F.lit(None).cast(kinds[g])).alias(g) for g in fields],
        )
        for f in fields
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def stream_task_state(
    updates: DataFrame,
    root: str,
    retention: int | None = RETENTION_SECONDS,
    fields: list[str] = STATE_FIELDS,
) -> StreamingQuery:
    """Keep the folded state of each task; finished tasks leave it ``retention`` seconds after finishing.

    Time is event time: the latest update seen. A task that left starts anew with its next update. Without
    ``retention`` none leaves what is stored: a late update of a finished task is folded with all before it, however
    the updates fall into batches, and ``current_state`` alone leaves out the tasks that are past their time.
    """

    def step(batch: DataFrame, number: int) -> None:
        empty = stamped_state(batch.limit(0), fields).withColumn("version", F.lit(0))
        table = _state_table(batch.sparkSession, root, empty.schema, retention)
        if table.has(f"batch/{number}"):
            return
        # One row per task from here on.
        made = batch.groupBy("task").agg(F.max("ts").alias("__ts"), *_last_values(fields))
        touched = cut(made)
        earlier = table.state()[1].get("mark")
        latest = touched.agg(F.max("__ts").cast("string")).first()[0]
        stored = _last_of_tasks(_of_tasks(table, touched).select(*empty.columns), "version")
        stored = stored.filter(~_has_left(earlier, retention))  # a task that left starts anew
        rows = _as_updates(touched, fields).unionByName(_as_updates(stored, fields))
        folded = stamped_state(rows, fields).withColumn("version", F.lit(number))
        clock = max((c for c in (earlier, latest) if c), key=_moment, default=None)
        table.append(lambda _: folded, f"batch/{number}", clock)

    return _start(updates, root, step)


def _moment(clock: str) -> datetime:
    return datetime.fromisoformat(clock)


def _has_left(clock: str | None, retention: int | None) -> Column:
    """Whether a task finished more than ``retention`` seconds before the clock."""
    if retention is None:
        return F.lit(False)
    over = F.col("running.running") == F.lit(False)
    expired = F.col("running.ts") + F.expr(f"INTERVAL {int(retention)} SECOND") < F.lit(clock).try_cast("timestamp_ntz")
    return F.coalesce(over & expired, F.lit(False))


def _state_table(spark, root: str, schema: StructType, retention: int | None) -> LogTable:
    def fold(rows: DataFrame, clock: str | None) -> DataFrame:
        last = _last_of_tasks(rows.select(*schema.names), "version")
        return last.filter(~_has_left(clock, retention))

    return _task_table(spark, root, schema, fold)


def current_state(
    spark, root: str, updates: DataFrame, retention: int = RETENTION_SECONDS, fields: list[str] = STATE_FIELDS
) -> DataFrame:
    """The state after the last batch of a job over ``updates`` (its columns' types are those of the state)."""
    empty = spark.createDataFrame([], updates.schema)
    schema = stamped_state(empty, fields).withColumn("version", F.lit(0)).schema
    table = _state_table(spark, root, schema, retention)
    state = _last_of_tasks(table.read().select(*schema.names), "version")
    kept = state.filter(~_has_left(table.state()[1].get("mark"), retention))
    return kept.select("task", *[F.col(f"{f}.{f}").alias(f) for f in fields])


def stream_due(ticks: DataFrame, schedules: DataFrame, root: str, late: str = "1 day") -> StreamingQuery:
    """Append the schedules due at each tick not seen before.

    Ticks are remembered until the latest one is ``late`` ahead of them; a tick that comes even later is past its
    time and starts nothing. So the state has the ticks of that span, however long the stream runs.
    """
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', tick)")
    # Event time needs a point on the time line: the tick's own digits, whatever the session's time zone.
    timed = ticks.filter("tick IS NOT NULL").select("tick", F.timestamp_micros(micros).alias("at"))
    fresh = timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["at"]).select("tick")

    def step(batch: DataFrame, number: int) -> None:
        due(schedules, batch).write.mode("overwrite").parquet(_version(root, "out", number))

    return _start(fresh, root, step)
