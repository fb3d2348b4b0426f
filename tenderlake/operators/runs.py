"""Counters, reports, progress and file-task state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.notice import literal_map
from tenderlake.operators.incremental import IDENTITY
from tenderlake.operators.joins import distinct_keys, lookup
from tenderlake.operators.ordered import with_previous

# Result codes of file tasks.
RESULT_CODES = {
    0: "NONE",
    501: "ERROR_CONVERT_PDF",
    502: "ERROR_UPLOAD_FTP",
    503: "ERROR_EXTRACTION",
    504: "ERROR_DOWNLOAD",
    505: "ERROR_FILE_NOT_FOUND",
    506: "ERROR_UNSUPPORTED_FILE",
    201: "SUCCESS_CONVERT_PDF",
    202: "SUCCESS_UPLOAD_FTP",
    203: "SUCCESS_EXTRACTION",
    204: "SUCCESS_DOWNLOAD",
}

# The fields whose change makes a progress snapshot worth reporting.
PROGRESS_FIELDS = [
    "isRunning",
    "totalBiddings",
    "totalExtracted",
    "currentBidding",
    "newBiddings",
    "currentTask",
    "message",
]

STATE_FIELDS = ["running", "code", "message"]
# Fixed value: the answer to a poll of no task.
NO_TASK = "Nenhum processo em execução."

# Report placeholders replaced wherever they occur, and those replaced once.
EVERYWHERE = ("scraper_name", "new_biddings")
ONCE = ("execution_time", "found_biddings", "extracted_biddings", "scraper_details_page", "year")

REPORT_TEMPLATE = """<html><body>
<h1>%scraper_name%</h1>
<p>%execution_time%: %new_biddings% of %found_biddings% notices are new.</p>
<table><tr><th>%scraper_name%</th><td>%new_biddings%</td><td>%extracted_biddings%</td></tr></table>
<a href="%scraper_details_page%">details</a><footer>%year%</footer>
</body></html>"""


def run_stats(listing: DataFrame, results: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """Per scraper: items with identity, new ones among them, notices made, and listing pages read.

    Pages have a row of their own in the listing, at position -1; where it holds items alone, pages count by
    their first item. Either way no distinct count is needed, and the listing is read once.
    """
    known = distinct_keys(results, IDENTITY).withColumn("__known", F.lit(True))
    # Items without identity have no key to look up.
    keyed = listing.withColumn("_hash", F.when(F.col("pos") >= 0, F.nullif("_hash", F.lit(""))))
    counted = lookup(keyed, known, IDENTITY, "left")
    found = F.col("_hash").isNotNull()
    stats = counted.groupBy("scraper").agg(
        F.count_if(found).alias("totalBiddings"),
        F.count_if(found & F.col("__known").isNull()).alias("newBiddings"),
        F.greatest(F.count_if(F.col("pos") == -1), F.count_if(F.col("pos") == 0)).alias("totalPages"),
    )
    if notices is None:
        stats = stats.withColumn("totalExtracted", F.lit(0).cast("bigint"))
    else:
        made = notices.groupBy("scraper").agg(F.count(F.lit(1)).alias("totalExtracted"))
        stats = stats.join(made, "scraper", "left")
    counters = ["totalBiddings", "newBiddings", "totalExtracted", "totalPages"]
    return stats.select("scraper", *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])


def render_report(stats: DataFrame, template: str, start: Column, name: Column, link: Column) -> DataFrame:
    """Add the report of each run. The template is taken apart once, on the driver, so each row is one
    concatenation."""
    values = {
        "scraper_name": name,
        "new_biddings": F.col("newBiddings").cast("string"),
        "execution_time": F.date_format(start, "EEE MMM dd yyyy"),
        "found_biddings": F.col("totalBiddings").cast("string"),
        "extracted_biddings": F.col("totalExtracted").cast("string"),
        "scraper_details_page": link,
        "year": F.year(start).cast("string"),
    }
    parts, seen = [], set()
    for piece in re.split("(" + "|".join(f"%{p}%" for p in EVERYWHERE + ONCE) + ")", template):
        key = piece[1:-1]
        if piece.startswith("%") and key in values and not (key in ONCE and key in seen):
            seen.add(key)
            parts.append(F.coalesce(values[key], F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return stats.withColumn("report", F.concat(*parts))


def changed_progress(progress: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before them of their task in a reported field."""
    previous = with_previous(progress, "task", "seq", PROGRESS_FIELDS)
    changed = F.col("__prev").isNull()
    for field in PROGRESS_FIELDS:
        changed = changed | ~F.col(field).eqNullSafe(F.col(f"__prev.{field}"))
    return previous.filter(changed).select(*progress.columns)


def task_state(updates: DataFrame, fields: list[str] = STATE_FIELDS) -> DataFrame:
    """Last supplied value of each field per task; NULL counts as not supplied."""
    return updates.groupBy("task").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    )


def poll(state: DataFrame, polls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers to polls in order of ``seq``, and the state that stays.

    A finished task answers its first poll and leaves; later polls, and polls of unknown tasks, get
    the no-task message.
    """
    first = polls.groupBy("task").agg(F.min("seq").alias("__first"))
    known = state.join(first, "task", "left")
    running = F.coalesce("running", F.lit(False))
    remaining = known.filter(running | F.col("__first").isNull()).select(*state.columns)
    asked = known.filter(F.col("__first").isNotNull())
    answers = lookup(polls, asked, ["task"], "left")
    live = F.col("__first").isNotNull() & (running | (F.col("seq") == F.col("__first")))
    fields = [c for c in state.columns if c not in ("task", "message")]
    answers = answers.select(
        "task",
        "seq",
        *[F.when(live, F.col(c)).alias(c) for c in fields],
        F.when(live, F.col("message")).otherwise(NO_TASK).alias("message"),
    )
    return answers, remaining


def result_class(code: Column) -> Column:
    return F.try_element_at(literal_map(RESULT_CODES), code.cast("int"))
