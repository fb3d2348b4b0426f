"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal size. Its weight, as a share n of a period of M slots, gives block j
the release time floor(j * M / n) and the deadline ceil((j + 1) * M / n). Earliest deadline first among
released blocks gives every slot of the period one source (ties go to the smaller name). As the shares add
up to the period, the fluid schedule fills all windows exactly, so no deadline is missed and at every slot
each source is less than one block away from its share of the slots so far.

After M slots every source has had exactly n blocks and the pattern repeats, so only one period is
scheduled, and block b of a source stands at slot (b div n) * M + (slot of b mod n in the pattern). A source
that has run out leaves its slots empty: the others then share the remaining order in their proportions.
Slots order the mixture; every document has exactly one, none is dropped or repeated.

Documents of a source are taken in the order of a hash of their id. The running size that cuts blocks is
taken in buckets of that hash plus one small row per bucket, so a hot source is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import cut, free_name

PERIOD = 1000
BLOCK_SIZE = 65_536
BUCKET_ROWS = 500


def quotas(totals: DataFrame, weights: dict[str, float] | None, period: int) -> DataFrame:
    """Sources with their slots ``n`` of a period, at least one each, and the period's true length ``m``.

    ``totals`` has ``name`` and ``size``. Without given weights a source weighs the square root of its
    size, so large sources count for less than their size and small ones for more.
    """
    if weights is None:
        weight = F.floor(F.sqrt(F.col("size").cast("double")))
    else:
        given = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair)) if weights else None
        weight = F.floor(1e6 * F.coalesce(given[F.col("name")], F.lit(0.0))) if weights else F.lit(0)
    rows = totals.select("name", weight.cast("long").alias("w"))
    sums = rows.agg(F.greatest(F.sum("w"), F.lit(1)).alias("all"))
    n = F.expr(f"greatest(1L, (2 * {period} * w + `all`) div (2 * `all`))")
    shares = rows.join(F.broadcast(sums)).select("name", n.alias("n"))  # one row of sums
    return shares.join(F.broadcast(shares.agg(F.sum("n").alias("m"))))


def pattern(shares: DataFrame) -> DataFrame:
    """Earliest deadline first over one period: rows (name, n, m, j, slot), one per slot.

    The sources' names and shares come together in one row; the schedule is a fold over the slots.
    """
    release = "s.done[i] * m div all[i].n"
    deadline = "((s.done[i] + 1) * m + all[i].n - 1) div all[i].n"
    pick = f"""array_min(transform(
        filter(sequence(0, size(all) - 1), i -> s.done[i] < all[i].n and {release} <= t),
        i -> named_struct('deadline', {deadline}, 'i', i))).i"""
    step = f"""transform(array({pick}), p -> named_struct(
        'done', transform(s.done, (d, i) -> if(i = p, d + 1, d)),
        'slots', concat(s.slots, array(named_struct('i', p, 'j', s.done[p])))))[0]"""
    start = """named_struct('done', transform(all, x -> 0L),
        'slots', cast(array() as array<struct<i:int,j:bigint>>))"""
    row = shares.agg(
        F.sort_array(F.collect_list(F.struct("name", "n"))).alias("all"), F.coalesce(F.max("m"), F.lit(0)).alias("m")
    ).where("m > 0")
    return (
        row.withColumn("slots", F.expr(f"aggregate(if(m > 0, sequence(0L, m - 1), array()), {start}, (s, t) -> {step}, s -> s.slots)"))
        .select("all", "m", F.posexplode("slots").alias("slot", "x"))
        .selectExpr("all[x.i].name as name", "all[x.i].n as n", "m", "x.j as j", "cast(slot as long) as slot")
    )


def mix(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    block_size: int = BLOCK_SIZE,
    period: int = PERIOD,
) -> DataFrame:
    """Add ``block``, ``slot``, ``start``, ``release`` and ``deadline``; (slot, start, id) orders the mixture.

    ``weights`` maps sources to target weights; sources it leaves out get one slot of the period.
    ``start`` is where the document begins in its source, in units of ``size`` (characters of ``text``).
    A NULL source counts as the empty name, a NULL text as empty, and NULL ids come first. Rows equal in
    source and id follow each other by size. Existing columns of the new names are replaced; an empty table
    gives an empty result.
    """
    new = ["block", "slot", "start", "release", "deadline"]
    df = df.drop(*(c for c in new if c in df.columns))
    size = F.length(F.coalesce(F.col("text"), F.lit(""))) if size is None else size
    name, amount, key, bucket, parts, before, n, m, j, at = free_name(
        df, "mix_name", "mix_size", "mix_key", "mix_bucket", "mix_parts", "mix_before", "mix_n", "mix_m", "mix_j", "mix_at"
    )

    named = (
        df.withColumn(name, F.coalesce(F.col(source).cast("string"), F.lit("")))
        .withColumn(amount, size.cast("long"))
        .withColumn(key, F.coalesce(F.md5(F.col(doc_id).cast("string").cast("binary")), F.lit("")))
    )
    totals = cut(
        named.groupBy(F.col(name).alias("name")).agg(
            F.sum(amount).alias("size"), F.ceil(F.count("*") / BUCKET_ROWS).cast("long").alias("parts")
        )
    )
    # Stored, these tables of one row per source and slot have a known size: Spark broadcasts them if small.
    slots = cut(pattern(quotas(totals, weights, period)))

    place = F.expr(f"coalesce(conv(substr({key}, 1, 8), 16, 10), 0)").cast("long") * F.col(parts)
    rows = named.join(totals.select(F.col("name").alias(name), F.col("parts").alias(parts)), name).withColumn(
        bucket, F.shiftright(place, 32)
    )
    earlier = Window.partitionBy(name).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(name, bucket)
        .agg(F.sum(amount).alias(at))
        .select(name, bucket, F.coalesce(F.sum(at).over(earlier), F.lit(0)).alias(before))
    )
    inside = (
        Window.partitionBy(name, bucket)
        .orderBy(key, doc_id, amount)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cycle = slots.groupBy("name").agg(F.first("n").alias(n), F.first("m").alias(m))
    placed = (
        rows.withColumn("start", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(cut(offsets), [name, bucket])
        .withColumn("start", F.col("start") + F.col(before))
        .withColumn("block", F.expr(f"start div {block_size}"))
        .join(cycle.withColumnRenamed("name", name), name)
        .withColumn(j, F.col("block") % F.col(n))
        .join(slots.select(F.col("name").alias(name), F.col("j").alias(j), F.col("slot").alias(at)), [name, j])
        .withColumn("slot", F.expr(f"(block div {n}) * {m} + {at}"))
        .withColumn("release", F.expr(f"(block * {m}) div {n}"))
        .withColumn("deadline", F.expr(f"((block + 1) * {m} + {n} - 1) div {n}"))
    )
    return placed.select(*df.columns, *new)


def in_mixture_order(mixed: DataFrame, columns: list[str], files: int) -> DataFrame:
    """``columns`` of what ``mix`` returned, with partitions and rows in the order of the mixture.

    Partition i holds the i-th part of the slots, so files written from it are read in that order. Slots
    hold one block each, which keeps the parts even; the last slot is all that is asked for beforehand.
    """
    last = mixed.agg(F.max("slot")).first()[0] or 0
    (part,) = free_name(mixed, "mix_part")
    return (
        mixed.withColumn(part, F.expr(f"cast(slot * {files} div {last + 1} as int)"))
        .repartitionById(files, part)
        .sortWithinPartitions("slot", "start", "doc_id")
        .select(*columns)
    )


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, length(coalesce(text, '')) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents
), placed AS (
    SELECT doc_id, source, coalesce(sum(size) OVER (
        PARTITION BY coalesce(source, '') ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    ), 0)::BIGINT AS start FROM d
), w AS (
    SELECT coalesce(source, '') AS name, floor(sqrt(sum(size)))::BIGINT AS w FROM d GROUP BY 1
), q AS (
    SELECT name, greatest(1, (2 * {PERIOD} * w + total) // (2 * total))::BIGINT AS n
    FROM w, (SELECT greatest(sum(w), 1)::BIGINT AS total FROM w)
), lists AS (
    SELECT list(name ORDER BY name) AS names, list(n ORDER BY name) AS n, sum(n)::BIGINT AS m FROM q
), edf AS (
    SELECT 0::BIGINT AS t, list_transform(n, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, 0::BIGINT AS j FROM lists
    UNION ALL
    SELECT t + 1, list_transform(range(1, len(n) + 1), lambda i: done[i] + (i = p)::BIGINT), p, done[p]
    FROM (
        SELECT t, done, n, m, list_position(due, list_min(due))::BIGINT AS p
        FROM (
            SELECT t, done, n, m, list_transform(range(1, len(n) + 1), lambda i: CASE
                WHEN done[i] < n[i] AND done[i] * m // n[i] <= t THEN ((done[i] + 1) * m + n[i] - 1) // n[i]
                ELSE 1000000000 END) AS due
            FROM edf, lists WHERE t < m
        )
    )
), slots AS (
    SELECT names[pick] AS name, j, t - 1 AS slot FROM edf, lists WHERE t > 0
), blocks AS (
    SELECT doc_id, source, start, start // {BLOCK_SIZE} AS block, n, m
    FROM placed JOIN q ON q.name = coalesce(source, ''), lists AS l(names, ns, m)
)
SELECT doc_id, source, block, (block // n) * m + slot AS slot, start,
       block * m // n AS release, ((block + 1) * m + n - 1) // n AS deadline
FROM blocks JOIN slots ON slots.name = coalesce(source, '') AND slots.j = block % n
"""
