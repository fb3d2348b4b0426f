"""Schedules from cron requests, and which are due at a tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.cron import cron_field, cron_valid
from tenderlake.functions.text import present


def _whole(col: Column) -> Column:
    return F.when(col.rlike(r"^[0-9]+\z"), col.try_cast("int"))


def make_schedules(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schedules of the valid ``(scraper, cron, frequency)`` requests, and the refused requests.

    Fields that are no plain number are NULL, and such schedules are never due.
    """
    valid = present(F.col("scraper")) & cron_valid(F.col("cron")) & present(F.col("frequency"))
    hours, minutes = (_whole(cron_field(F.col("cron"), f)) for f in ("hours", "minutes"))
    made = requests.filter(valid).select(
        "scraper",
        _whole(cron_field(F.col("cron"), "dow")).alias("weekday"),
        hours.alias("hours"),
        minutes.alias("minutes"),
        (hours * 60 + minutes).alias("minute_of_day"),
        "frequency",
        F.col("cron").alias("cronExpression"),
    )
    return made, requests.filter(~valid)


def due(schedules: DataFrame, ticks: DataFrame) -> DataFrame:
    """Schedules due at each ``tick``: at their minute of the day, weekly ones on their weekday only.

    Weekday 0 is Sunday. Each tick stands once for its weekday and once for any day, so equalities on day and minute
    decide and a schedule is one row. Neither side is broadcast: small files may hold many schedules, all of which
    would go through the driver. Both are sorted, and adaptive execution may split a crowded minute.
    """
    weekly = F.coalesce(F.col("frequency") == "weekly", F.lit(False))
    day = F.when(weekly, F.col("weekday")).otherwise(0)
    slots = schedules.filter(F.col("minute_of_day").isNotNull()).withColumns({"__weekly": weekly, "__day": day})
    tick = F.col("tick")
    on_day = F.struct(F.lit(True).alias("__weekly"), (F.dayofweek(tick) - 1).alias("__day"))
    any_day = F.struct(F.lit(False).alias("__weekly"), F.lit(0).alias("__day"))
    moments = ticks.select(
        "tick",
        F.inline(F.array(on_day, any_day)),
        (F.hour(tick) * 60 + F.minute(tick)).alias("minute_of_day"),
    )
    return slots.hint("merge").join(moments, ["__weekly", "__day", "minute_of_day"]).drop("__weekly", "__day")
