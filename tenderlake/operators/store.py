"""Set-oriented queries and changes over the stored scrapers, results and schedules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import present

INTERNAL = "__v"


def usable_id(col: Column) -> Column:
    """Ids must be given and must not be written as a number: decimal, or 0x, 0o, 0b, or infinite."""
    number = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|0[xX][0-9A-Fa-f]+|0[oO][0-7]+|0[bB][01]+|[+-]?Infinity"
    return present(col) & ~col.rlike(rf"^\s*(?:{number})?\s*$")


def find_scrapers(scrapers: DataFrame, **equal) -> DataFrame:
    """Scrapers whose columns equal the given values. Numeric ids and cities are refused: no rows."""
    found = scrapers
    for name, value in equal.items():
        found = found.filter(F.col(name) == F.lit(value))
        if name in ("id", "city"):
            found = found.filter(usable_id(F.lit(value)))
    return found.drop(INTERNAL)


def last_run(scrapers: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` scrapers run last; never run ones come last, ties by id."""
    return scrapers.orderBy(F.desc_nulls_last("lastRunDate"), "id").limit(n).drop(INTERNAL)


def pending(results: DataFrame, scraper: str | None = None) -> DataFrame:
    """Results not approved, by open date, undated ones first. Ignored results are included."""
    found = results.filter(~F.col("approved"))
    if scraper is not None:
        found = found.filter(F.col("scraper") == scraper)
    return found.orderBy(F.asc_nulls_first("openDate"), "id").drop(INTERNAL)


def pending_with_scraper(results: DataFrame, scrapers: DataFrame, scraper: str | None = None) -> DataFrame:
    """Pending results, each with its scraper as a struct (rows, not one list per scraper)."""
    packed = scrapers.select(
        F.col("id").alias("scraper"),
        F.struct(*[c for c in scrapers.columns if c != INTERNAL]).alias("scraper_doc"),
    )
    found = results.filter(~F.col("approved"))
    if scraper is not None:
        found = found.filter(F.col("scraper") == scraper)
    return found.join(packed, "scraper", "left").orderBy(F.asc_nulls_first("openDate"), "id").drop(INTERNAL)


def find_schedules(schedules: DataFrame, scrapers: DataFrame, filter_json: str | None = None) -> DataFrame:
    """Schedules with the scraper's name. The filter is a JSON object of equalities; a broken one is none."""
    found = schedules
    for name, value in _equalities(filter_json).items():
        if name not in schedules.columns:
            found = found.filter(F.lit(value is None))
        elif value is None:
            found = found.filter(F.col(name).isNull())
        else:
            # A value that does not read as the column's type equals nothing.
            found = found.filter(F.col(name) == F.lit(value).try_cast(schedules.schema[name].dataType))
    names = scrapers.select(F.col("id").alias("scraper"), F.col("name").alias("scraper_name"))
    return found.join(names, "scraper", "left").drop(INTERNAL)


def _equalities(text: str | None) -> dict:
    try:
        parsed = json.loads(text) if text else {}
    except ValueError:
        return {}
    if not isinstance(parsed, dict):
        return {}
    if any(isinstance(value, (dict, list)) for value in parsed.values()):
        raise ValueError("a schedule filter holds equalities only")
    return parsed


def insert_scrapers(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All scrapers after the insert, and the refused rows. Name and city are required."""
    complete = present(F.col("name")) & present(F.col("city"))
    accepted = new.filter(complete).select(
        "id",
        "name",
        "city",
        F.lit(False).alias("running"),
        F.lit(False).alias("hidden"),
        F.lit(None).cast("timestamp_ntz").alias("lastRunDate"),
    )
    return existing.unionByName(accepted), new.filter(~complete)


def inserted_recipes(new: DataFrame) -> DataFrame:
    """Recipes that came with accepted new scrapers in ``config``, as ``(recipe_id, body)``."""
    complete = present(F.col("name")) & present(F.col("city")) & present(F.col("config"))
    return new.filter(complete).select(F.col("id").alias("recipe_id"), F.col("config").alias("body"))


def patch(df: DataFrame, patches: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Apply partial updates. ``fields`` lists the columns a patch sets, so a set NULL differs from an
    absent one; of several patches of a column the last by ``order`` counts. Unusable keys are skipped.
    """
    columns = [c for c in patches.columns if c in df.columns and c != key]
    sets = {c: F.array_contains("fields", c) for c in columns}
    folded = (
        patches.filter(usable_id(F.col(key)))
        .groupBy(key)
        .agg(*[F.max_by(F.struct(c), F.when(sets[c], F.col(order))).alias(f"__set_{c}") for c in columns])
    )
    joined = df.join(folded, key, "left")
    changed = {
        c: F.when(F.col(f"__set_{c}").isNotNull(), F.col(f"__set_{c}.{c}")).otherwise(F.col(c))
        for c in columns
    }
    return joined.withColumns(changed).select(*df.columns)


def delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows left after deleting those with the given ids. Unusable ids delete nothing."""
    doomed = ids.filter(usable_id(F.col(key))).select(key)
    return df.join(doomed, key, "left_anti")


def start_runs(scrapers: DataFrame, ids: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Scrapers after the start, and the refused ids: those already running."""
    asked = ids.filter(usable_id(F.col("id"))).select("id").distinct().withColumn("__asked", F.lit(True))
    joined = scrapers.join(asked, "id", "left")
    starts = F.coalesce("__asked", F.lit(False)) & ~F.coalesce("running", F.lit(False))
    after = joined.withColumns(
        {
            "lastRunDate": F.when(starts, run_ts).otherwise(F.col("lastRunDate")),
            "running": F.col("running") | starts,
        }
    ).select(*scrapers.columns)
    refused = scrapers.filter("running").join(asked, "id", "left_semi").select("id")
    return after, refused


def finish_runs(scrapers: DataFrame, ids: DataFrame) -> DataFrame:
    """Scrapers with the given ids set to not running; the run date stays."""
    asked = ids.select("id").distinct().withColumn("__asked", F.lit(True))
    return (
        scrapers.join(asked, "id", "left")
        .withColumn("running", F.col("running") & F.col("__asked").isNull())
        .select(*scrapers.columns)
    )
