"""The result table: complete rows in, no identity stored twice by a repeated run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.operators.incremental import new_items, prior_of
from tenderlake.schemas import RESULT
from tenderlake.session import cut
from tenderlake.sources.tables import LogTable

# Defaults of stored results.
DEFAULTS = {"amount": 0.0, "approved": False, "ignored": False, "exclusive": False}


def with_defaults(df: DataFrame) -> DataFrame:
    """The result columns in order: absent ones NULL, the defaults filled in, others dropped."""
    columns = []
    for field in RESULT.fields:
        col = F.col(field.name) if field.name in df.columns else F.lit(None)
        col = col.cast(field.dataType)
        if field.name in DEFAULTS:
            col = F.coalesce(col, F.lit(DEFAULTS[field.name]))
        columns.append(col.alias(field.name))
    return df.select(*columns)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, empty while nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(df: DataFrame, path: str) -> None:
    """Append the rows whose ``(scraper, _hash)`` the table lacks. Repeating an append adds nothing.

    A missing scraper is stored as the empty one, so that it meets itself again. Readers see all of an append or
    nothing of it, and only the buckets are read that the rows have a scraper of.
    """
    rows = cut(df.withColumn("scraper", F.coalesce("scraper", F.lit(""))))
    table(df.sparkSession, path, df.schema).append(lambda stored: new_items(rows, prior_of(rows, stored)))


def table(spark: SparkSession, path: str, schema: T.StructType) -> LogTable:
    return LogTable(spark, path, schema)


def append_results(df: DataFrame, path: str) -> None:
    append_new(with_defaults(df), path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, with the buckets by which a run prunes them."""
    return table(spark, path, RESULT).read()
