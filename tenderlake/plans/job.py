"""A run as a job: ``spark-submit tenderlake/plans/job.py --recipes ... --list-pages ... --results ...``.

Each path is a folder in any file system Spark reads. Page tables are parquet with page_id, url, html and,
where recipes are chosen by page, recipe_id; ``scraper`` defaults to the recipe.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.runs import REPORT_TEMPLATE, render_report
from tenderlake.operators.store import finish_runs, start_runs
from tenderlake.plans.batch import MOST_BROADCAST, Batch, Chains, assign_recipes, run_batch, store_batch
from tenderlake.session import build_session, cut
from tenderlake.sources.claims import LEASE_SECONDS, Claims, run_name
from tenderlake.sources.recipes import Recipe, compile_recipes, read_recipes
from tenderlake.sources.results import read_results
from tenderlake.sources.tables import BUCKET, BUCKETS, LogTable


def run_scrapers(
    scrapers: DataFrame,
    ids: DataFrame,
    list_pages: DataFrame,
    detail_pages: DataFrame,
    recipes: list[Recipe],
    results_path: str,
    run_ts: str,
) -> tuple[DataFrame, DataFrame, Batch]:
    """Run the scrapers asked for, store what is new, and give the scrapers after it and the refused ids.

    The pages must be of these scrapers; scrapers that are running already are left alone.
    """
    spark = scrapers.sparkSession
    moment = F.lit(run_ts).cast("timestamp_ntz")
    started, refused = start_runs(scrapers, ids, moment)
    batch = run_batch(list_pages, detail_pages, recipes, read_results(spark, results_path), moment)
    store_batch(batch, results_path)
    begun = ids.join(refused, "id", "left_anti")
    return finish_runs(started, begun), refused, batch


@contextmanager
def claimed(claims: Claims, ids: DataFrame, moment: Column, run: str, lease: int = LEASE_SECONDS) -> Iterator[DataFrame]:
    """The ids that this run got, while it works on them; they are free again however it ends."""
    try:
        yield cut(claims.claim(ids, run, moment, lease))
    finally:
        claims.release(run)


def of_scrapers(pages: DataFrame, ids: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """The pages of the claimed scrapers; a page without a scraper belongs to its recipe's."""
    assigned = assign_recipes(pages, recipes)
    own = F.col("recipe_id")
    scraper = F.coalesce("scraper", own) if "scraper" in assigned.columns else own
    few = ids.count() <= MOST_BROADCAST
    held = ids.select(F.col("id").alias("__id"))
    return assigned.withColumn("__id", scraper).join(F.broadcast(held) if few else held, "__id", "left_semi").drop("__id")


def stored_chains(spark: SparkSession, path: str) -> Chains:
    """The page chains of earlier runs below ``path``: pages that were reached, and the ends that wait."""
    tables = (LogTable(spark, os.path.join(path, name), schema) for name, schema in _chain_schemas(spark).items())
    return Chains(*(t.read().drop(BUCKET, BUCKETS) for t in tables))


def store_chains(chains: Chains, path: str, run: str) -> None:
    """Add a run's chain rows and put its open ends in place of the old ones. A repeated run adds nothing."""
    spark = chains.pages.sparkSession
    schemas = _chain_schemas(spark)
    named = chains.pages.withColumn("scraper", F.col("seed_url"))
    ends = chains.ends.withColumn("scraper", F.col("seed_url"))
    LogTable(spark, os.path.join(path, "pages"), schemas["pages"]).append(lambda _: named, f"runs/{run}")
    LogTable(spark, os.path.join(path, "ends"), schemas["ends"]).replace(lambda _: ends)


def _chain_schemas(spark: SparkSession) -> dict:
    rows = {"pages": "seed_url string, url string, depth int, scraper string", "ends": "seed_url string, next_url string, depth int, scraper string"}
    return {name: spark.createDataFrame([], schema).schema for name, schema in rows.items()}


def reports(batch: Batch, run_ts: str, site: str, template: str = REPORT_TEMPLATE) -> DataFrame:
    """The report text of each scraper of a run."""
    moment = F.lit(run_ts).cast("timestamp_ntz")
    link = F.concat(F.lit(site), "scraper")
    return render_report(batch.stats, template, moment, F.col("scraper"), link)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("recipes", "list-pages", "detail-pages", "results", "frontier", "reports", "run-ts"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--requests", help="where to write the postback requests that no response answers yet")
    parser.add_argument("--responses", help="answers to postback requests: page_url, event_target, final_url")
    parser.add_argument("--rejects", help="where to write the recipes that cannot run, with the reason")
    parser.add_argument("--site", default="", help="address in front of a scraper's id in its report")
    parser.add_argument("--chains", help="where page chains are kept from run to run; their next pages join the frontier")
    parser.add_argument("--claims", help="where runs claim their scrapers; pages of scrapers that another run holds are left out")
    given = parser.parse_args(arguments)
    spark = spark or build_session()
    tasks, unread = read_recipes(spark, given.recipes)
    recipes, unsupported = compile_recipes(tasks)
    if given.rejects:
        unread.unionByName(unsupported).write.mode("overwrite").parquet(given.rejects)
    list_pages, detail_pages = (spark.read.parquet(p) for p in (given.list_pages, given.detail_pages))
    if not given.claims:
        return _run(spark, given, recipes, list_pages, detail_pages)
    moment = F.lit(given.run_ts).cast("timestamp_ntz")
    listed = assign_recipes(list_pages, recipes)
    scraper = F.coalesce("scraper", "recipe_id") if "scraper" in listed.columns else F.col("recipe_id")
    ids = listed.select(scraper.alias("id")).distinct()
    with claimed(Claims(spark, given.claims), ids, moment, run_name()) as own:
        _run(spark, given, recipes, of_scrapers(list_pages, own, recipes), detail_pages)


def _run(spark: SparkSession, given: argparse.Namespace, recipes: list[Recipe], list_pages: DataFrame, detail_pages: DataFrame) -> None:
    responses = spark.read.parquet(given.responses) if given.responses else None
    moment = F.lit(given.run_ts).cast("timestamp_ntz")
    chains = stored_chains(spark, given.chains) if given.chains else None
    batch = run_batch(list_pages, detail_pages, recipes, read_results(spark, given.results), moment, responses, chains)
    store_batch(batch, given.results)
    if given.requests:
        batch.to_post.write.mode("overwrite").parquet(given.requests)
    wanted = batch.to_fetch
    if given.chains:
        wanted = wanted.union(batch.next_pages).distinct()
    wanted.write.mode("overwrite").parquet(given.frontier)
    reports(batch, given.run_ts, given.site).write.mode("overwrite").parquet(given.reports)
    if given.chains:
        store_chains(batch.chains, given.chains, given.run_ts)


if __name__ == "__main__":
    main()
