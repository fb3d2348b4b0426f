"""Pagination chains over already fetched listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import present, resolve_url
from tenderlake.operators.joins import lookup
from tenderlake.session import cut, scratch_path


def page_chain(pages: DataFrame, seed: Column) -> DataFrame:
    """Pages reached from each seed by following ``next_url``: ``(seed_url, url, depth)``, depth from 1.

    A chain stops at a missing or unknown next page, or at an address it already holds. Of several fetches
    of an address the last (``page_id``) counts. Jumps double each round, so a chain of n pages takes
    log2(n) rounds of joins rather than n; the rounds end when one reaches no new page. Each round is
    materialised: the plan stays short and a lost executor costs one round.
    """
    order = F.col("page_id") if "page_id" in pages.columns else F.coalesce("next_url", F.lit(""))
    links = cut(
        pages.withColumn("is_seed", seed)
        .groupBy("url")
        .agg(F.max_by(F.struct("next_url"), order).alias("last"), F.max("is_seed").alias("is_seed"))
        .select("url", "last.next_url", "is_seed")
    )
    # Only pages that were fetched can be stepped on.
    steps = lookup(
        links.filter(F.col("next_url").isNotNull()).select(F.col("url").alias("start"), F.col("next_url").alias("url")),
        links.select("url"),
        ["url"],
        "left_semi",
    )
    seeds = links.filter("is_seed").select(F.col("url").alias("start"), "url")
    state = cut(_round(seeds.withColumn("depth", F.lit(1)), steps))
    span, size = 1, 0  # the jumps lead ``span`` pages ahead
    while True:
        reached, jumps = (state.filter(F.col("is_jump") == flag).drop("is_jump") for flag in (False, True))
        before, size = size, reached.count()
        if size == before or jumps.isEmpty():
            break
        ahead = jumps.select(F.col("start").alias("url"), F.col("url").alias("end"))
        further = lookup(reached, ahead, ["url"], "inner").select(
            "start", F.col("end").alias("url"), (F.col("depth") + span).alias("depth")
        )
        # On a repeated address the first visit stays.
        reached = reached.unionByName(further).groupBy("start", "url").agg(F.min("depth").alias("depth"))
        jumps = lookup(jumps, ahead, ["url"], "inner").select("start", F.col("end").alias("url"))
        state = cut(_round(reached, jumps))
        span *= 2
    return state.filter(~F.col("is_jump")).select(F.col("start").alias("seed_url"), "url", "depth")


def _round(reached: DataFrame, jumps: DataFrame) -> DataFrame:
    """Pages reached so far and jumps as one table, so a round is one write."""
    return reached.withColumn("is_jump", F.lit(False)).unionByName(
        jumps.select("start", "url", F.lit(None).cast("int").alias("depth"), F.lit(True).alias("is_jump"))
    )


def fetch_chains(pages: DataFrame, seed: Column) -> DataFrame:
    """Pages reached from each seed where every fetch counts: ``(seed_url, url, depth, n)``.

    ``pages`` are fetches ``(page_id, url, next_url)``, ``page_id`` once each. A next address leads to each fetch of
    it, and each fetch to the page it names, so a chain branches at an address fetched several times; it ends before
    an address it already holds. ``n`` is the number of chains of the seed that are at the page at that depth.

    A fetch that is the only one of its address, and the only way to it, is followed but once: between the others
    (``heads``) whole stretches are found at first, by doubling jumps. Then a round leads each chain from head to head;
    chains of one end, depth and set of heads go on as one. Rounds are written tables. Their number goes with the
    heads on a chain; the number of chains may double with each address of several fetches.
    """
    fetches = cut(pages.withColumn("is_seed", F.coalesce(seed, F.lit(False))).select("page_id", "url", "next_url", "is_seed"))
    named = fetches.filter("next_url IS NOT NULL").groupBy(F.col("next_url").alias("url")).agg(F.count(F.lit(1)).alias("n_named"))
    held = fetches.groupBy("url").agg(
        F.count(F.lit(1)).alias("n_held"), F.max("is_seed").alias("begins"), F.min("page_id").alias("place")
    )
    single = (F.col("n_held") == 1) & (F.col("n_named") == 1) & ~F.col("begins")
    places = cut(lookup(held, named, ["url"], "left").select("url", "place", F.coalesce(single, F.lit(False)).alias("single")))
    ahead = places.select(F.col("url").alias("next_url"), F.col("place").alias("next_place"), F.col("single").alias("next_single"))
    steps = cut(lookup(lookup(fetches, places, ["url"], "inner"), ahead, ["next_url"], "left"))
    links = steps.select(
        F.col("page_id").cast("string").alias("url"),
        F.when(F.col("next_single"), F.col("next_place").cast("string")).alias("next_url"),
        (~F.col("single")).alias("is_head"),
    )
    stretches = page_chain(links, F.col("is_head")).select(
        F.col("seed_url").cast("long").alias("head"), F.col("url").cast("long").alias("page_id"), (F.col("depth") - 1).alias("ahead")
    )
    stretches = cut(stretches.join(steps.select("page_id", "url", "next_place", "next_single"), "page_id"))
    heads = steps.filter(~F.col("single")).select(F.col("page_id").alias("to"), F.col("place").alias("next_place"))
    edges = cut(
        stretches.filter("next_place IS NOT NULL AND NOT next_single")
        .join(heads, "next_place")
        .select("head", "to", F.col("next_place").alias("to_place"), (F.col("ahead") + 1).cast("long").alias("span"))
    )
    root, number, spark = scratch_path(pages.sparkSession, "chains"), 0, pages.sparkSession
    chains = steps.filter("is_seed").select(
        F.col("url").alias("seed_url"), F.col("page_id").alias("head"), F.lit(1).cast("long").alias("depth"),
        F.array("place").alias("seen"), F.lit(1).cast("long").alias("n"),
    )
    while True:
        # Chains that hold the same heads, in whatever order, go on alike.
        path = f"{root}/round={number}"
        chains.groupBy("seed_url", "head", "depth", "seen").agg(F.sum("n").alias("n")).write.parquet(path)
        chains = spark.read.schema("seed_url string, head long, depth long, seen array<long>, n long").parquet(path)
        if chains.isEmpty():
            break
        further = chains.join(edges, "head").filter(~F.array_contains("seen", F.col("to_place")))
        chains = further.select(
            "seed_url", F.col("to").alias("head"), (F.col("depth") + F.col("span")).alias("depth"),
            F.array_sort(F.array_append("seen", F.col("to_place"))).alias("seen"), "n",
        )
        number += 1
    rounds = spark.read.schema("seed_url string, head long, depth long, n long, round int").parquet(root)
    reached = rounds.groupBy("seed_url", "head", "depth").agg(F.sum("n").alias("n"))
    return reached.join(stretches, "head").select(
        "seed_url", "url", (F.col("depth") + F.col("ahead")).cast("int").alias("depth"), "n"
    )


AT_ONCE = 10_000


def repeated(df: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column ``n`` says, in short lists however large the number."""
    parts = df.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) DIV {AT_ONCE}"))))
    rest = F.least(F.lit(AT_ONCE).cast("long"), F.col(n) - F.col("__part") * AT_ONCE)
    return parts.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), rest))).drop("__part", "__copy", n)


def next_links(listing: DataFrame) -> DataFrame:
    """(url, next_url) of listing pages from the rows at position -1 of ``extract_listing``, by page.

    The link resolves against its page; NULL on a last page, and where it is an event target, which no address
    names. Of several fetches of a page the last counts.
    """
    target = F.when(present(F.col("link")) & ~F.col("link").contains("$"), resolve_url(F.col("url"), F.col("link")))
    pages = listing.filter(F.col("pos") == -1).select("page_id", "url", target.alias("next_url"))
    return pages.groupBy("url").agg(F.max_by(F.struct("next_url"), "page_id").alias("last")).select("url", "last.next_url")


def extend_chains(links: DataFrame, stored: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a run adds to the chains of earlier runs, and where they end now.

    ``links`` (url, next_url) are the listing pages the run has fetched, ``stored`` (seed_url, url, depth) the pages
    of all chains so far, ``ends`` (seed_url, next_url, depth) the chains that wait for a page. Only these are
    followed on, and pages that nothing leads to begin chains of their own; closed chains are not looked at, but
    for the addresses they hold: a chain ends where it comes back to itself. Returns new rows for ``stored`` and
    the ``ends`` that take the place of the old ones.
    """
    links, ends = cut(links), cut(ends)
    named = links.select(F.col("next_url").alias("url")).union(ends.select(F.col("next_url").alias("url")))
    known = stored.select("url").union(named.filter("url IS NOT NULL")).distinct()
    begun = lookup(links.select("url"), known, ["url"], "left_anti").select(F.col("url").alias("seed_url"), F.col("url").alias("wanted"), F.lit(0).alias("base"))
    waiting = ends.select("seed_url", F.col("next_url").alias("wanted"), F.col("depth").alias("base")).union(begun)
    waiting = cut(waiting.distinct())
    followed = lookup(links, waiting.select(F.col("wanted").alias("url"), F.lit(True).alias("is_seed")).distinct(), ["url"], "left")
    pieces = page_chain(followed.withColumn("is_seed", F.coalesce("is_seed", F.lit(False))), F.col("is_seed"))
    found = pieces.select(F.col("seed_url").alias("wanted"), "url", "depth").join(waiting, "wanted")
    found = cut(found.select("seed_url", "url", (F.col("base") + F.col("depth")).alias("depth")))
    # A chain that comes to a page it holds ends before it.
    held = stored.select("seed_url", "url").distinct()
    again = lookup(found, held, ["seed_url", "url"], "left_semi").groupBy("seed_url").agg(F.min("depth").alias("stop"))
    kept = lookup(found, again, ["seed_url"], "left").filter("stop IS NULL OR depth < stop")
    rows = cut(kept.select("seed_url", "url", "depth", F.col("stop").isNotNull().alias("back")))
    last = rows.groupBy("seed_url").agg(F.max_by(F.struct("url", "depth", "back"), "depth").alias("last"))
    tips = lookup(last.select("seed_url", "last.*"), links, ["url"], "inner").filter("next_url IS NOT NULL AND NOT back")
    # A next page that was fetched and is no part of the chain would have been followed: it leads back.
    fetched = links.select(F.col("url").alias("next_url"))
    own = held.union(rows.select("seed_url", "url")).withColumnRenamed("url", "next_url")
    opened = lookup(lookup(tips, fetched, ["next_url"], "left_anti"), own, ["seed_url", "next_url"], "left_anti")
    opened = opened.select("seed_url", "next_url", "depth")
    closed = lookup(ends.select("seed_url", "next_url", "depth"), fetched, ["next_url"], "left_anti")
    return rows.select("seed_url", "url", "depth"), cut(opened.union(closed))


def chain_items(chain: DataFrame, items: DataFrame) -> DataFrame:
    """Items of all pages of each chain, with the page's place in it."""
    return items.join(chain, "url")
