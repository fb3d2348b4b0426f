"""File requests and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import path_name, present
from tenderlake.operators.ordered import with_running_sum


def route_files(requests: DataFrame) -> DataFrame:
    """Add ``action``, the intended result ``code``, and ``steps``: the codes a task passes on its way.

    Requests hold uri, id, filename, format and fileIndex. Formats are told apart by case.
    """
    kind = F.col("format")
    by_uri = present(F.col("uri")) & present(kind)
    by_id = (
        present(F.col("id")) & present(F.col("filename")) & present(kind)
        & F.coalesce(F.col("fileIndex") >= 0, F.lit(False))
    )
    packed, word, pdf = kind.isin("zip", "rar"), kind.isin("doc", "docx"), kind == "pdf"
    routes = [
        (by_uri & packed, "extract", 203, "204,203"),
        (by_uri & word, "convert", 202, "204,201,202"),
        (by_uri, "reject", 505, "204,505"),
        (by_id & word, "convert", 202, "0,201,202"),
        (by_id & pdf, "upload", 202, "202"),
        (by_id, "reject", 506, "506"),
    ]
    route = F.lit(None)
    for condition, action, code, steps in reversed(routes):
        chosen = F.struct(F.lit(action).alias("action"), F.lit(code).alias("code"), F.lit(steps).alias("steps"))
        route = F.when(condition, chosen).otherwise(route)
    routed = requests.withColumn("__route", route)
    return routed.withColumns(
        {
            "action": F.coalesce("__route.action", F.lit("missing_params")),
            "code": F.col("__route.code"),
            "steps": F.col("__route.steps"),
        }
    ).drop("__route")


def list_archives(archives: DataFrame) -> DataFrame:
    """Files inside each ``(archive_id, body)``: ``(archive_id, idx, path, size, status)``.

    ``idx`` counts from 0 by path. Archives that are no zip give one row without a path: rar is
    ``not_built``, anything else ``unreadable``.
    """

    def rows(archive_id: str, body: bytes | None) -> Iterator[tuple]:
        try:
            names = zipfile.ZipFile(io.BytesIO(body or b"")).infolist()
        except (zipfile.BadZipFile, UnicodeDecodeError, NotImplementedError, OverflowError, ValueError):
            yield archive_id, None, None, None, "not_built" if (body or b"")[:4] == b"Rar!" else "unreadable"
            return
        files = sorted((i.filename, i.file_size) for i in names if not i.is_dir())
        for index, (path, size) in enumerate(files):
            yield archive_id, index, path, size, "ok"

    schema = pa.schema(
        [("archive_id", pa.string()), ("idx", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("status", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive_id, body in zip(batch.column(0), batch.column(1)):  # one body at a time
                columns = zip(*rows(archive_id.as_py(), body.as_py()))
                columns = [list(c) for c in columns] or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                )

    return archives.select("archive_id", "body").mapInArrow(
        run, "archive_id string, idx int, path string, size bigint, status string"
    )


def with_index(files: DataFrame) -> DataFrame:
    """Add ``idx``, a file's place in its archive by path, from 0. An archive may hold any number of files: they are
    counted by ranges of paths."""
    counted = with_running_sum(files, "archive_id", "path", F.lit(1), "idx")
    return counted.withColumn("idx", (F.col("idx") - 1).cast("int"))


def pick_notice(listing: DataFrame) -> DataFrame:
    """Per archive the last file whose path speaks of an ``edital``: its index, else -1, and name."""
    match = F.lower("path").contains("edital")
    best = F.max(F.when(match, F.struct("idx", "path")))
    return listing.groupBy("archive_id").agg(best.alias("best")).select(
        "archive_id",
        F.coalesce("best.idx", F.lit(-1)).alias("notice_idx"),
        path_name(F.col("best.path"), True).alias("notice_name"),
    )
