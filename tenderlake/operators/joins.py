"""Lookups against stored tables that stay whole and even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = "__lookup_key"


def lookup_key(*names: str) -> Column:
    """One text from the key columns, NULL if any of them is NULL. Each value has its length in front, so
    no two keys give the same text."""
    texts = [F.col(name).cast("string") for name in names]
    return F.concat(*(part for text in texts for part in (F.length(text), F.lit(":"), text)))


def lookup(left: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join ``left`` with a table that was aggregated to one row per key.

    The join runs on one derived key, so both sides reach it straight from a shuffle of its own. Were the
    aggregate's shuffle reused, the plan would have an aggregate between shuffle and join, and adaptive
    execution could not split a partition in which one key holds a third of the left rows.
    """
    key = lookup_key(*keys)
    right = table.withColumn(_KEY, key).drop(*keys)
    return left.withColumn(_KEY, key).join(right, _KEY, how).drop(_KEY)


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys once each. Copies collapse before the shuffle, within each task."""
    return df.select(*keys).distinct()
