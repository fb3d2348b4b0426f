"""One incremental run over fetched pages, from listing pages to new notices."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.chains import extend_chains, next_links
from tenderlake.operators.extract import extract_listing, extract_notices, form_state
from tenderlake.operators.incremental import (
    enrich,
    frontier,
    join_details,
    new_items,
    postback_requests,
    prior_of,
    resolve_links,
)
from tenderlake.operators.runs import run_stats
from tenderlake.session import cut
from tenderlake.sources.recipes import Recipe
from tenderlake.sources.results import append_results, with_defaults

MOST_BROADCAST = 1_000_000
MOST_WORDS = 1 << 22


@dataclass(frozen=True)
class Chains:
    """Pages of the page chains of earlier runs (seed_url, url, depth), and the chains that wait for a page
    (seed_url, next_url, depth)."""

    pages: DataFrame
    ends: DataFrame


@dataclass(frozen=True)
class Batch:
    """What a run found. ``notices`` is materialised, so counting and storing do not repeat the run.

    ``to_fetch`` are links to detail pages, ``next_pages`` listing pages that follow those of the run;
    ``chains.pages`` are the rows this run adds to the chains, ``chains.ends`` all that are open after it. Chains
    are followed when first asked for.
    """

    items: DataFrame
    notices: DataFrame
    to_fetch: DataFrame
    to_post: DataFrame
    stats: DataFrame
    listing: DataFrame
    before: Chains

    @cached_property
    def chains(self) -> Chains:
        return Chains(*extend_chains(next_links(self.listing), self.before.pages, self.before.ends))

    @property
    def next_pages(self) -> DataFrame:
        return self.chains.ends.select(F.col("next_url").alias("link")).distinct()


def no_chains(spark: SparkSession) -> Chains:
    return Chains(
        spark.createDataFrame([], "seed_url string, url string, depth int"),
        spark.createDataFrame([], "seed_url string, next_url string, depth int"),
    )


def assign_recipes(pages: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Listing pages with the recipe that reads them: their own ``recipe_id``, else the only recipe, else the one of
    their site. Pages of no recipe's site drop out; several recipes of one site each get the page."""
    if "recipe_id" in pages.columns:
        return pages
    if len(recipes) == 1:
        return pages.withColumn("recipe_id", F.lit(recipes[0].recipe_id))
    sites = pages.sparkSession.createDataFrame([(r.recipe_id, r.base_uri) for r in recipes], "recipe_id string, base string")
    sites = sites.select("recipe_id", site(F.col("base")).alias("__site")).filter("__site <> ''")
    few = len(recipes) <= MOST_BROADCAST
    return pages.withColumn("__site", site(F.col("url"))).join(F.broadcast(sites) if few else sites, "__site").drop("__site")


def site(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def asked_pages(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that (materialised) links ask for, each with the recipes that ask (``recipe_ids``), whatever site it
    is on; pages with a ``recipe_id`` of their own keep it.

    Addresses and recipes meet the pages where these are read, before any is parsed: as a broadcast table while
    there are at most ``MOST_BROADCAST`` addresses, and else by a join of the pages that a bit set lets through.
    """
    wanted = resolved.select(F.col("resolved").alias("url"), "recipe_id").filter("url IS NOT NULL")
    asked = cut(wanted.groupBy("url").agg(F.collect_set("recipe_id").alias("recipe_ids")))
    if "recipe_id" in pages.columns:
        asked = asked.select("url")
    count = asked.count()
    if count <= MOST_BROADCAST:
        return pages.join(F.broadcast(asked), "url")
    return through_filter(asked, pages, count).join(asked, "url")


def through_filter(wanted: DataFrame, pages: DataFrame, count: int) -> DataFrame:
    """The pages of ``wanted`` addresses and a few more, by a blocked Bloom filter of 16 bits an address.

    An address sets two bits of one word. There are as many words as ``count`` asks for, ``MOST_WORDS`` at most
    (64 MB), which lets under two in a hundred other pages through for up to 16 million addresses.
    """
    words = min(MOST_WORDS, 1 << max(10, (count // 4).bit_length()))
    hashed = F.xxhash64("url")
    word = F.pmod(hashed, F.lit(words))
    bits_of = "shiftleft(1L, cast(shiftrightunsigned(xxhash64(url), 58) as int)) | shiftleft(1L, cast(shiftrightunsigned(xxhash64(url), 52) & 63 as int))"
    table = wanted.select("url").groupBy(word.alias("__word")).agg(F.bit_or(F.expr(bits_of)).alias("__bits"))
    return (
        pages.withColumn("__word", word)
        .join(F.broadcast(table), "__word")
        .filter(F.expr(f"(__bits & ({bits_of})) = ({bits_of})"))
        .drop("__word", "__bits")
    )


def new_notices(resolved: DataFrame, detail_pages: DataFrame, recipes: list[Recipe], run_ts: Column) -> DataFrame:
    """Complete result rows for items whose detail page is there."""
    # The detail pages shrink to their notice fields where they are read; only those are shuffled.
    details = extract_notices(asked_pages(resolved, detail_pages), recipes).drop("scraper")
    joined = join_details(resolved.select("scraper", "_hash", "recipe_id", "resolved"), details, "resolved")
    notices = joined.select("scraper", "_hash", F.col("resolved").alias("url"), "detail.*")
    return with_defaults(enrich(notices, run_ts))


def run_batch(
    list_pages: DataFrame,
    detail_pages: DataFrame,
    recipes: list[Recipe],
    results: DataFrame,
    run_ts: Column,
    responses: DataFrame | None = None,
    chains: Chains | None = None,
) -> Batch:
    """Items, new ones, their links, their notices, the chains of listing pages, and what is still to be fetched."""
    listed = assign_recipes(list_pages, recipes)
    listing = cut(extract_listing(listed, recipes))
    items = listing.filter("pos >= 0")
    postback = [r.recipe_id for r in recipes if r.aspnet]
    aspnet = F.col("recipe_id").isin(postback) if postback else None
    stored = prior_of(items, results)
    resolved = cut(resolve_links(new_items(items, stored), responses, aspnet))
    notices = cut(new_notices(resolved, detail_pages, recipes, run_ts))
    return Batch(
        items,
        notices,
        frontier(resolved, detail_pages, "resolved"),
        _to_post(resolved, listed, recipes, postback),
        run_stats(listing, stored, notices),
        listing,
        chains or no_chains(listing.sparkSession),
    )


def _to_post(resolved: DataFrame, listed: DataFrame, recipes: list[Recipe], postback: list[str]) -> DataFrame:
    """Postback requests of the recipes of such sites; only their pages are read again for their forms."""
    asked = [r for r in recipes if r.recipe_id in postback]
    forms = form_state(listed.filter(F.col("recipe_id").isin(postback)), asked)
    open_links = resolved.filter(F.col("recipe_id").isin(postback))
    return postback_requests(open_links, forms).join(
        resolved.sparkSession.createDataFrame([(r.recipe_id, r.delay) for r in asked], "recipe_id string, wait_ms string"),
        "recipe_id",
    )


def store_batch(batch: Batch, path: str) -> None:
    append_results(batch.notices, path)
