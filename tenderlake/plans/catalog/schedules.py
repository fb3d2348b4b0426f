"""G: cron expressions and due schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import cron
from tenderlake.operators import schedules as G
from tenderlake.plans.catalog import query
from tenderlake.plans.views import Tables

# Field by field: name lookups and ranges as a table, one row per expression and field.
_PARTS = """
      SELECT scraper, cron, i, n, v, f.name, f.lo, f.hi, f.specials
      FROM (SELECT scraper, cron, len(p) AS n, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS i
            FROM (SELECT DISTINCT scraper, cron, string_split(cron, ' ') AS p FROM {source}))
      JOIN (VALUES (0, 'seconds', 0, 59, '*,-'), (1, 'minutes', 0, 59, '*,-'), (2, 'hours', 0, 23, '*,-'),
              (3, 'dom', 1, 31, '*,-?LW'), (4, 'month', 1, 12, '*,-'), (5, 'dow', 0, 6, '*,-?L#'),
              (6, 'year', 1970, 2099, '*,-')) f(k, name, lo, hi, specials)
        ON f.k = i + CASE WHEN n = 5 THEN 1 ELSE 0 END WHERE n BETWEEN 5 AND 7"""
_NUMBERS = """
      SELECT x AS word, x AS num, 'any' AS name FROM (SELECT CAST(unnest(range(0, 2100)) AS VARCHAR) AS x)
      UNION ALL SELECT '', '0', 'any'
      UNION ALL SELECT unnest(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']),
        CAST(unnest(range(1, 13)) AS VARCHAR), 'month'
      UNION ALL SELECT unnest(['sun','mon','tue','wed','thu','fri','sat']), CAST(unnest(range(0, 7)) AS VARCHAR), 'dow'"""
VALID_SQL = f"""
    SELECT s.scraper, s.cron, coalesce(b.ok, s.cron <> '') AS valid
    FROM (SELECT DISTINCT scraper, cron FROM {{source}}) s LEFT JOIN (
      SELECT scraper, cron, bool_and(ok) AS ok FROM (
        SELECT q.scraper, q.cron, q.i, CASE
            WHEN length(v) = 1 AND contains(specials, v) THEN true
            WHEN length(v) > 1 AND NOT contains(v, '-') AND NOT contains(v, ',') AND contains(v, '/') THEN true
            ELSE bool_and(coalesce(CASE WHEN length(v) > 1 AND contains(v, '-') AND e = 1 THEN CAST(w.num AS INT) >= lo
                WHEN length(v) > 1 AND contains(v, '-') THEN CAST(w.num AS INT) <= hi
                ELSE CAST(w.num AS INT) BETWEEN lo AND hi END, false)) END AS ok
        FROM (SELECT *, unnest(l) AS word, generate_subscripts(l, 1) AS e FROM (SELECT *,
                CASE WHEN length(v) > 1 AND contains(v, '-') THEN string_split(v, '-')[1:2]
                  WHEN length(v) > 1 AND contains(v, ',') THEN string_split(v, ',') ELSE [v] END AS l FROM ({_PARTS}))) q
        LEFT JOIN ({_NUMBERS}) w ON w.word = lower(q.word) AND w.name IN ('any', q.name)
        GROUP BY q.scraper, q.cron, q.i, v, specials, lo, hi)
      GROUP BY scraper, cron) b ON b.scraper = s.scraper AND b.cron = s.cron
"""

# Besides the given requests, expressions over the whole range of fields, built from the orders.
_MIXED = """(SELECT concat('o', o_orderkey) AS scraper, concat_ws(' ', CASE o_orderkey % 3 WHEN 0 THEN '0' END,
    concat(o_orderkey % 65, CASE WHEN o_orderkey % 4 = 0 THEN concat(',', o_orderkey % 61) ELSE '' END),
    CASE o_orderkey % 7 WHEN 0 THEN '*/2' WHEN 1 THEN '?' WHEN 2 THEN '' ELSE CAST(o_custkey % 26 AS VARCHAR) END,
    CASE o_orderkey % 6 WHEN 0 THEN 'L' WHEN 1 THEN '?' WHEN 2 THEN '5-' ELSE CAST(o_custkey % 33 AS VARCHAR) END,
    CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%b') WHEN 1 THEN 'JAN-mar' ELSE '*' END,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%a') WHEN 1 THEN '#' WHEN 2 THEN '1,MON,x' ELSE '*' END,
    CASE WHEN o_orderkey % 9 = 0 THEN '2020' WHEN o_orderkey % 9 = 1 THEN '1900-2000' END) AS cron FROM orders)"""


def _mixed(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def pick(n: int, *options):
        out = None
        for i, option in enumerate(options[:-1]):
            out = (F if out is None else out).when(key % n == i, option)
        return out.otherwise(options[-1])

    listed = F.when(key % 4 == 0, F.concat(F.lit(","), key % 61)).otherwise("")
    parts = [
        F.when(key % 3 == 0, "0"),
        F.concat(key % 65, listed),
        pick(7, "*/2", "?", "", (cust % 26).cast("string")),
        pick(6, "L", "?", "5-", (cust % 33).cast("string")),
        pick(5, F.date_format("o_orderdate", "MMM"), "JAN-mar", "*"),
        pick(4, F.date_format("o_orderdate", "EEE"), "#", "1,MON,x", "*"),
        F.when(key % 9 == 0, "2020").when(key % 9 == 1, "1900-2000"),
    ]
    return t.orders.select(F.concat(F.lit("o"), key).alias("scraper"), F.concat_ws(" ", *parts).alias("cron"))


@query(VALID_SQL.format(source=f"(SELECT scraper, cron FROM v_schedule UNION ALL SELECT * FROM {_MIXED})"))
def cron_valid(t: Tables) -> DataFrame:
    expressions = t.schedule_requests().select("scraper", "cron").unionByName(_mixed(t))
    return expressions.withColumn("valid", cron.cron_valid(F.col("cron")))


_FIELDS_SQL = f"""
    SELECT scraper, cron, valid, p, len(p) AS n FROM (SELECT *, string_split(cron, ' ') AS p FROM ({VALID_SQL}))
"""


@query(
    "SELECT scraper, CASE WHEN valid AND n >= 6 THEN p[1] ELSE '0' END AS seconds, "
    + ", ".join(
        f"CASE WHEN valid AND n = 7 THEN p[{i + 1}] WHEN valid AND n IN (5, 6) THEN p[{i}] ELSE '0' END AS \"{f}\""
        for i, f in enumerate(cron.FIELDS)
        if i
    )
    + f" FROM ({_FIELDS_SQL.format(source=f'(SELECT scraper, cron FROM v_schedule UNION ALL SELECT * FROM {_MIXED})')})"
)
def cron_fields(t: Tables) -> DataFrame:
    expressions = t.schedule_requests().select("scraper", "cron").unionByName(_mixed(t))
    fields = cron.cron_fields(F.col("cron"))
    return expressions.select("scraper", *[c.alias(f) for f, c in fields.items()])


_ROWS_SQL = f"""
    SELECT f.scraper, s.frequency, f.cron AS "cronExpression", hours * 60 + minutes AS minute_of_day, hours, minutes, weekday
    FROM (SELECT scraper, cron, valid, TRY_CAST(CASE WHEN n IN (5, 6) THEN p[1] ELSE '0' END AS INT) AS minutes,
            TRY_CAST(CASE WHEN n IN (5, 6) THEN p[2] ELSE '0' END AS INT) AS hours,
            TRY_CAST(CASE WHEN n IN (5, 6) THEN p[5] ELSE '0' END AS INT) AS weekday
          FROM ({_FIELDS_SQL.format(source='v_schedule')})) f
    JOIN v_schedule s ON s.scraper = f.scraper WHERE valid
"""


@query(_ROWS_SQL)
def schedule_rows(t: Tables) -> DataFrame:
    made, _ = G.make_schedules(t.schedule_requests())
    return made


DUE_SQL = f"""
    SELECT s.scraper, s.frequency, k.tick FROM ({_ROWS_SQL}) s JOIN v_ticks k
      ON hour(k.tick) * 60 + minute(k.tick) = s.minute_of_day
      AND (s.frequency <> 'weekly' OR s.weekday = dayofweek(k.tick))
"""


@query(DUE_SQL)
def due_schedules(t: Tables) -> DataFrame:
    made, _ = G.make_schedules(t.schedule_requests())
    return G.due(made, t.ticks()).select("scraper", "frequency", "tick")
