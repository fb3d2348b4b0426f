"""E: queries and changes over stored scrapers, results and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators import store as E
from tenderlake.operators.schedules import make_schedules
from tenderlake.plans.catalog import query
from tenderlake.plans.catalog.increments import run_time
from tenderlake.plans.views import Tables


def _number(col: str):
    """The number in an id such as s12."""
    return F.expr(f"CAST(substr({col}, 2) AS BIGINT)")


@query("SELECT * FROM v_scraper WHERE running")
def scrapers_running(t: Tables) -> DataFrame:
    return E.find_scrapers(t.scrapers(), running=True)


@query("SELECT * FROM v_scraper WHERE city IN ('NATION_3', 'NATION_7')")
def scrapers_by_city(t: Tables) -> DataFrame:
    """Two cities, and a numeric one that is refused."""
    scrapers = t.scrapers()
    found = [E.find_scrapers(scrapers, city=city) for city in ("NATION_3", "NATION_7", "12")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""SELECT * FROM v_scraper ORDER BY "lastRunDate" DESC NULLS LAST, id LIMIT 5""")
def last_run(t: Tables) -> DataFrame:
    return E.last_run(t.scrapers())


@query("SELECT * FROM v_result WHERE NOT approved")
def pending_results(t: Tables) -> DataFrame:
    return E.pending(t.results())


@query(
    """
    SELECT r.id, r.scraper, r._hash, r."openDate", s.name AS scraper_name, s.city AS scraper_city
    FROM v_result r LEFT JOIN v_scraper s ON s.id = r.scraper WHERE NOT r.approved
    """
)
def pending_with_scraper(t: Tables) -> DataFrame:
    found = E.pending_with_scraper(t.results(), t.scrapers())
    return found.select(
        "id", "scraper", "_hash", "openDate", F.col("scraper_doc.name").alias("scraper_name"),
        F.col("scraper_doc.city").alias("scraper_city"),
    )


@query(
    """
    SELECT c.scraper, c.cron AS "cronExpression", s.name AS scraper_name, n.kind
    FROM v_schedule c LEFT JOIN v_scraper s ON s.id = c.scraper
    JOIN (VALUES ('filter'), ('broken')) n(kind) ON n.kind = 'broken' OR c.frequency = 'weekly'
    WHERE c.cron <> '*/5 0 * XYZ 1' AND NOT (CAST(substr(c.scraper, 2) AS BIGINT) % 10 = 4
      AND CAST(substr(c.scraper, 2) AS BIGINT) % 70 > 59)
    """
)
def schedules_populated(t: Tables) -> DataFrame:
    """A filter, and a broken one that filters nothing."""
    schedules, _ = make_schedules(t.schedule_requests())
    scrapers = t.scrapers()
    filtered = E.find_schedules(schedules, scrapers, '{"frequency": "weekly"}').withColumn("kind", F.lit("filter"))
    everything = E.find_schedules(schedules, scrapers, '{"frequency": ').withColumn("kind", F.lit("broken"))
    return filtered.unionByName(everything).select("scraper", "cronExpression", "scraper_name", "kind")


@query(
    """
    SELECT id, name, city, running, hidden, "lastRunDate", false AS refused FROM v_scraper
    UNION ALL
    SELECT concat('n', c_custkey), c_name, c_mktsegment, false, false, NULL, false FROM customer WHERE c_custkey % 3 = 0
    UNION ALL
    SELECT concat('n', c_custkey), CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE '' END,
      CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment END, NULL, NULL, NULL, true FROM customer WHERE c_custkey % 3 <> 0
    """
)
def scrapers_insert(t: Tables) -> DataFrame:
    """New scrapers, some without a name or city."""
    turn = F.col("c_custkey") % 3
    new = t.customer.select(
        F.concat(F.lit("n"), "c_custkey").alias("id"),
        F.when(turn == 2, "").otherwise(F.col("c_name")).alias("name"),
        F.when(turn != 1, F.col("c_mktsegment")).alias("city"),
    )
    everyone, refused = E.insert_scrapers(t.scrapers(), new)
    return everyone.withColumn("refused", F.lit(False)).unionByName(
        refused.withColumn("refused", F.lit(True)), allowMissingColumns=True
    )


@query(
    """
    SELECT id, scraper, _hash, modality, number, "openDate",
      CASE WHEN k % 5 = 0 THEN true ELSE approved END AS approved,
      CASE WHEN k % 5 = 0 THEN 'final' WHEN k % 5 = 1 THEN NULL ELSE agency END AS agency,
      CASE WHEN k % 5 = 1 THEN 1.5 ELSE amount END AS amount
    FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM v_result)
    """
)
def results_patch(t: Tables) -> DataFrame:
    """Patches in sequence: later ones win per field, and a field may be set to NULL."""
    results = t.results()
    key = _number("id")
    turn = key % 5

    def change(seq: int, fields: list[str], when, approved=None, agency=None, amount=None) -> DataFrame:
        return results.filter(when).select(
            "id",
            F.lit(seq).alias("seq"),
            F.array(*[F.lit(f) for f in fields]).alias("fields"),
            F.lit(approved).cast("boolean").alias("approved"),
            F.lit(agency).cast("string").alias("agency"),
            F.lit(amount).cast("double").alias("amount"),
        )

    patches = (
        change(1, ["approved", "agency"], turn == 0, approved=True, agency="draft")
        .unionByName(change(2, ["agency"], turn == 0, agency="final"))
        .unionByName(change(3, ["agency", "amount"], turn == 1, amount=1.5))
        .unionByName(change(4, ["agency"], turn == 2, agency="lost").withColumn("id", _number("id").cast("string")))
    )
    return E.patch(results, patches)


@query("SELECT * FROM v_scraper WHERE CAST(substr(id, 2) AS BIGINT) % 4 <> 0")
def scrapers_delete(t: Tables) -> DataFrame:
    """Every fourth scraper goes; ids that read as numbers delete nothing."""
    scrapers = t.scrapers()
    usable = scrapers.filter(_number("id") % 4 == 0).select("id")
    numeric = scrapers.select(_number("id").cast("string").alias("id"))
    return E.delete(scrapers, usable.unionByName(numeric))


@query(
    """
    SELECT id, CASE WHEN k % 2 = 0 THEN k % 3 <> 0 ELSE running END AS running,
      CASE WHEN k % 2 = 0 AND NOT running THEN TIMESTAMP '2024-01-01 06:00:00' ELSE "lastRunDate" END AS "lastRunDate",
      k % 2 = 0 AND running AS refused
    FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM v_scraper)
    """
)
def run_state(t: Tables) -> DataFrame:
    """Every other scraper is started, and every third of those finished."""
    scrapers = t.scrapers()
    ids = scrapers.filter(_number("id") % 2 == 0).select("id")
    started, refused = E.start_runs(scrapers, ids, run_time())
    after = E.finish_runs(started, ids.filter(_number("id") % 3 == 0))
    marked = after.join(refused.withColumn("refused", F.lit(True)), "id", "left")
    return marked.select("id", "running", "lastRunDate", F.coalesce("refused", F.lit(False)).alias("refused"))
