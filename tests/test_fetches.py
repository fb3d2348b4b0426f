"""Queries against their SQL on pages of which some addresses were fetched several times."""

from pyspark.sql import functions as F
import pytest

from tenderlake.operators import chains
from tenderlake.plans.catalog import QUERIES
from tenderlake.plans.views import Tables
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The pages, and every fourth again after them under the address of the one before it."""
    path = tmp_path_factory.mktemp("fetches")
    pages = Tables(spark, FOLDER).pages.select("page_id", "url", "html")
    again = pages.filter("page_id % 4 = 1").withColumn("page_id", F.col("page_id") + 1000)
    older = pages.filter("page_id % 8 = 2").select((F.col("page_id") - 1000).alias("page_id"), "url", F.replace("html", F.lit("<h1>"), F.lit("<h1>old ")).alias("html"))
    pages.unionByName(again).unionByName(older).toPandas().to_parquet(path / "pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["detail_join", "enrich_results", "page_chain"])
def test_every_fetch_counts(spark, folder, name):
    assert compare(spark, duck(folder), folder, name) is None


def test_items_of_every_menu_count(spark, tmp_path):
    """A page may have several menus, tags may carry attributes or lack their ends, and items may hold items."""
    item = '<li><a href="/x">x</a></li>'
    pages = [
        f"<nav><ul>{item}{item}</ul></nav><article><ul>{item}</ul></article><nav><ul>{item}</ul></nav>",
        f'<NAV class="side"><ul><li id="a">{item}{item}</ul></NAV >{item}<navy>{item}</navy>',
        f"<nav>\n<ul><LI>one<li\nclass='b'>two<ul>{item}<li>four</li></ul></li></ul>\n</nav><nav></nav>",
        f"<p>{item}</p>",
        None,
        f"<nav><ul>{item}<link><list>",
    ]
    rows = [(i, f"http://h.example/{i}", html) for i, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    got = QUERIES["page_chain"](spark, str(tmp_path)).select("depth", "n_items").collect()
    assert {tuple(r) for r in got} == {(1, 3), (2, 3), (3, 4), (6, 1)}
    assert compare(spark, duck(str(tmp_path)), str(tmp_path), "page_chain") is None


def test_chains_branch_at_addresses_fetched_again(spark):
    """Two fetches of ``b``: one leads on, one into a cycle; and a page that two others name."""
    rows = [(1, "a", "b", True), (2, "b", "c", False), (3, "b", "a", False), (4, "c", "d", False), (5, "e", "d", True),
            (6, "d", "f", False), (7, "f", "c", False), (8, "f", "gone", False)]
    pages = spark.createDataFrame(rows, "page_id long, url string, next_url string, is_seed boolean")
    got = chains.fetch_chains(pages, F.col("is_seed")).groupBy("seed_url", "url", "depth").agg(F.sum("n")).collect()
    assert {tuple(r) for r in got} == {
        ("a", "a", 1, 1), ("a", "b", 2, 2), ("a", "c", 3, 1), ("a", "d", 4, 1), ("a", "f", 5, 2),
        ("e", "e", 1, 1), ("e", "d", 2, 1), ("e", "f", 3, 2), ("e", "c", 4, 1),
    }
    counted = spark.createDataFrame([(1, 3), (2, 25_000)], "k int, n long")
    assert dict(chains.repeated(counted, "n").groupBy("k").count().collect()) == {1: 3, 2: 25_000}
