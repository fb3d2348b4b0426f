"""Ordered work per key that no single task has to do for a whole key: a scan over ranges.

Rows are dealt by ranges of (key, order, tie) and sorted within each. A range works through its own rows in one
pass and leaves one small row: what its last row was, or the sum so far of its last key. From these rows each
range learns what the ranges before it hand on. So a key with a third of all rows spans many ranges, however its
order numbers lie, and rows with equal numbers are dealt by a hash of their columns. Ranges are stored once: what
they hand on belongs to the ranges that were read, also when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, MapType, StructField, StructType, VariantType

from tenderlake.session import cut

_TIE, _RANGE, _PREV, _SUM, _VALUE, _FIRST = "__tie", "__range", "__prev", "__sum", "__value", "__first"


def _ranges(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows dealt by (key, order, tie), sorted, with the number of their range."""
    hashed = [c.name for c in df.schema if not isinstance(c.dataType, MapType | VariantType)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = (key, order, _TIE)
    return (
        df.withColumn(_TIE, F.xxhash64(*hashed))
        .repartitionByRange(parts, *columns)
        .sortWithinPartitions(*columns)
        .withColumn(_RANGE, F.spark_partition_id())
    )


def _same_key(column: pa.Array, last: pa.Array | None) -> np.ndarray:
    """Whether each row has the key of the row before; NULL is a key like any other."""
    if last is None:
        last = pa.nulls(1, column.type)
        first = np.array([False])
    else:
        first = None
    before = pa.concat_arrays([last, column.slice(0, len(column) - 1)])
    equal = pc.fill_null(pc.equal(column, before), False).to_numpy(zero_copy_only=False)
    both = pc.and_(column.is_null(), before.is_null()).to_numpy(zero_copy_only=False)
    same = equal | both
    if first is not None:
        same[0] = False
    return same


def _scanned(
    ranges: DataFrame, key: str, fields: list[StructField], make: Callable[[], Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]]]
) -> DataFrame:
    """One pass over the sorted rows of each range, stored: ``fields`` from each batch and its ``_same_key``."""
    place = ranges.columns.index(key)
    names = [*ranges.columns, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = make(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(place)
            made = step(batch, _same_key(column, last))
            last = column.slice(len(column) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return cut(ranges.mapInArrow(run, StructType([*ranges.schema.fields, *fields])))


def _before(scanned: DataFrame, key: str, order: str, handed: Column) -> DataFrame:
    """Per range the last row of the range before it: its key and what it hands on. One small row per range."""
    last = scanned.groupBy(_RANGE).agg(F.max_by(F.struct(F.col(key).alias("k"), handed.alias("h")), F.struct(key, order, _TIE)).alias("last"))
    ranged = Window.orderBy(_RANGE)
    return last.select(_RANGE, F.lag("last").over(ranged).alias("__carry"))


def with_previous(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Add ``__prev``: a struct of ``columns`` of the row before, per key. NULL on the first row.

    Rows without a key or order number come first among their like, as in a window. Rows with one order number
    follow each other in a fixed order of no meaning.
    """
    ranges = _ranges(df, key, order)
    places = [ranges.columns.index(c) for c in columns]
    kind = StructType([StructField(c, ranges.schema[c].dataType) for c in columns])

    def make():
        held: list[pa.Array] = []

        def step(batch: pa.RecordBatch, same: np.ndarray) -> list[pa.Array]:
            before = []
            for i, place in enumerate(places):
                column = batch.column(place)
                start = held[i] if held else pa.nulls(1, column.type)
                before.append(pa.concat_arrays([start, column.slice(0, len(column) - 1)]))
            first = np.zeros(len(same), bool)
            first[0] = not held
            held[:] = [batch.column(place).slice(batch.num_rows - 1) for place in places]
            previous = pa.StructArray.from_arrays(before, names=columns, mask=pa.array(~same))
            return [previous, pa.array(first)]

        return step

    scanned = _scanned(ranges, key, [StructField(_PREV, kind), StructField(_FIRST, BooleanType())], make)
    before = _before(scanned, key, order, F.struct(*columns))
    # As many rows as ranges; only a range's first row may need one.
    at = F.when(F.col(_FIRST), F.col(_RANGE))
    joined = scanned.withColumn(_RANGE, at).join(F.broadcast(before), _RANGE, "left")
    carried = F.when(F.col("__carry").isNotNull() & F.col("__carry.k").eqNullSafe(F.col(key)), F.col("__carry.h"))
    return joined.withColumn(_PREV, F.when(F.col(_FIRST), carried).otherwise(F.col(_PREV))).select(*df.columns, _PREV)


def with_running_sum(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of the whole number ``value`` over all rows of the key up to this one. NULL adds
    nothing. Rows with one order number are added one after the other, in a fixed order of no meaning."""
    ranges = _ranges(df.withColumn(_VALUE, value.cast("long")), key, order)
    place = ranges.columns.index(_VALUE)

    def make():
        held = [0]

        def step(batch: pa.RecordBatch, same: np.ndarray) -> list[pa.Array]:
            total = np.cumsum(pc.fill_null(batch.column(place), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            # What had come together when a key began does not count for it.
            begins = np.flatnonzero(~same)
            offset = np.full(len(same), -held[0] if same[0] else 0, np.int64)
            if len(begins):
                values = np.where(begins > 0, total[begins - 1], 0)
                offset[begins[0] :] = np.repeat(values, np.diff(np.append(begins, len(same))))
            sums = total - offset
            held[0] = int(sums[-1])
            return [pa.array(sums)]

        return step

    scanned = _scanned(ranges, key, [StructField(_SUM, LongType())], make)
    last = scanned.groupBy(_RANGE).agg(
        F.max_by(F.struct(F.col(key).alias("k"), F.col(_SUM).alias("s")), F.struct(key, order, _TIE)).alias("last")
    )
    # A key that goes on through several ranges is the last key of all of them but the last.
    so_far = Window.partitionBy("last.k").orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, 0)
    summed = last.withColumn("s", F.sum("last.s").over(so_far))
    before = summed.select(_RANGE, F.lag(F.struct(F.col("last.k").alias("k"), "s")).over(Window.orderBy(_RANGE)).alias("__carry"))
    joined = scanned.join(F.broadcast(before), _RANGE, "left")  # as many rows as ranges
    carried = F.when(F.col("__carry").isNotNull() & F.col("__carry.k").eqNullSafe(F.col(key)), F.col("__carry.s"))
    return joined.withColumn(name, F.col(_SUM) + F.coalesce(carried, F.lit(0))).select(*df.columns, name)
