"""Which run works on which scrapers: claims that one run at a time holds, and that end by themselves.

The claims stand in parts named by manifests, like any table here. A run reads the last version, adds the scrapers
that no live claim holds, and commits the next version; if another run has done so first, it starts over from what
that one left. So of two runs that ask for one scraper at once, one gets it. A claim has a term: a run that dies
frees its scrapers when the term ends.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.store import usable_id
from tenderlake.session import cut
from tenderlake.sources.tables import LogTable

CLAIM = "scraper string, run string, until timestamp_ntz"
LEASE_SECONDS = 6 * 3600


class Claims:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.table = LogTable(spark, root, spark.createDataFrame([], CLAIM).schema)

    def live(self, moment: Column) -> DataFrame:
        """The claims that hold at ``moment``."""
        return self.table.read().select("scraper", "run", "until").filter(F.col("until") > moment)

    def claim(self, ids: DataFrame, run: str, moment: Column, lease: int = LEASE_SECONDS) -> DataFrame:
        """Claim the scrapers of ``ids`` for ``run``; gives those it got (``id``). Unusable ids claim nothing, and
        asking again prolongs what the run holds."""
        asked = cut(ids.filter(usable_id(F.col("id"))).select(F.col("id").alias("scraper")).distinct())
        until = moment + F.expr(f"INTERVAL {int(lease)} SECOND")

        def with_new(stored: DataFrame) -> DataFrame:
            held = stored.select("scraper", "run", "until").filter(F.col("until") > moment)
            others = held.join(asked, "scraper", "left_anti").union(
                held.filter(F.col("run") != run).join(asked, "scraper", "left_semi").select("scraper", "run", "until")
            )
            taken = others.select("scraper")
            own = asked.join(taken, "scraper", "left_anti").select("scraper", F.lit(run).alias("run"), until.alias("until"))
            return others.union(own)

        self.table.replace(with_new)
        return self.live(moment).filter(F.col("run") == run).join(asked, "scraper", "left_semi").select(F.col("scraper").alias("id"))

    def release(self, run: str) -> None:
        """Give back all that ``run`` holds."""
        self.table.replace(lambda stored: stored.filter(F.col("run") != run))


def run_name() -> str:
    return f"run-{time.time_ns()}"
