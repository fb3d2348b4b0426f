"""What several operators share: columns made in Python, label splits, shared scratch tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from tenderlake.session import cut, passing

__all__ = ["add_columns", "cut", "find_all", "free_name", "passing", "remainder", "sampled", "slices", "small_batches", "training_documents"]

SLICE_BYTES = 1_000_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started inside hand Python at most ``rows`` rows at a time: for rows with long lists, of which a default
    batch would fill buffers on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def add_columns(
    df: DataFrame,
    source: str | list[str],
    fields: list[StructField],
    prepare: Callable[[], Callable[[list], list[list]]],
) -> DataFrame:
    """Append ``fields``, computed from column ``source`` one slice of an Arrow batch at a time.

    ``prepare`` runs once per task and returns the function from a slice's values (of several sources: one list
    each) to one list per field. Slices are cut by the bytes of the first source.
    Columns of ``df`` that already have a field's name are replaced. No shuffle: rows stay in their partition.
    """
    made = {field.name for field in fields}
    kept = [name for name in df.columns if name not in made]
    sources = [df.columns.index(name) for name in ([source] if isinstance(source, str) else source)]
    places = [df.columns.index(name) for name in kept]
    types = [to_arrow_type(field.dataType) for field in fields]
    names = kept + [field.name for field in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in slices(batches, sources[0]):
            columns = [batch.column(i) for i in places]
            values = (batch.column(i).to_pylist() for i in sources)
            columns += [pa.array(v, t) for v, t in zip(work(*values), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, StructType([df.schema[name] for name in kept] + fields))


def slices(batches: Iterable[pa.RecordBatch], place: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``place``, texts, bytes or lists of them, holds about ``most`` bytes in each:
    that much is made into Python values at a time, whatever the session's batch size. A longer value comes alone."""
    for batch in batches:
        column = batch.column(place)
        inner = column.flatten() if pa.types.is_list(column.type) else column
        ends = np.cumsum(pc.fill_null(pc.binary_length(inner), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        if inner is not column:
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], ends])[np.cumsum(lengths, dtype=np.int64)]
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``: the fold a document belongs to. NULL for a NULL id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % modulus


def sampled(df: DataFrame, key: Column, sample: int) -> DataFrame:
    """About ``sample`` rows of ``df``, all if it has no more: those whose hash of ``key`` is small.

    One count sets the limit, so nothing is sorted, and the same rows are taken whatever the partitioning.
    """
    count = df.count()
    if count <= sample:
        return df
    spread = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(spread)) < spread * sample // count)


def training_documents(
    documents: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, sample: int
) -> DataFrame:
    """(doc_id, text, label) of about ``sample`` labelled documents outside the held-out fold, stored.

    The sample is the bound of what a model is fitted on. Several labels of one document count as their majority; documents with as
    many ones as zeros teach nothing. Texts stay distributed: a single one may be very long.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).where(
        remainder("doc_id", modulus) != held_out
    )
    votes = (
        sampled(usable, F.col("doc_id"), sample)
        .groupBy("doc_id")
        .agg(F.avg(F.col(target).cast("double")).alias("vote"))
        .where("vote <> 0.5")
        .select("doc_id", (F.col("vote") > 0.5).cast("int").alias("label"))
    )
    return cut(
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(votes), "doc_id")  # about ``sample`` rows of two numbers
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("label").alias("label"))
    )


def find_all(pattern: re.Pattern, text: str) -> Iterator[list[str]]:
    """Matches of a pattern in lists: one for an ordinary text, several for a very long one."""
    if len(text) <= 1_000_000:
        yield pattern.findall(text)
    else:
        yield from batches_of((m.group() for m in pattern.finditer(text)), 100_000)


def batches_of(values: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` values."""
    part: list = []
    for value in values:
        part.append(value)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
