"""Stand-ins for the stored collections, derived from the given tables and growing with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.joins import lookup
from tenderlake.operators.ordered import with_previous

SITE = r"^([a-z]+://[^/?#]+)"
MENU = r"(?is)<nav(?:[ \t\n\f\r/][^>]*)?>(.*?)(?:</nav[ \t\n\f\r]*>|\z)"
ITEM = r"(?i)<li(?:[ \t\n\f\r/][^>]*)?>"


def tick() -> Column:
    """The minute of an event, without a detour over the session's time zone."""
    return F.expr("ts - make_dt_interval(0, 0, 0, extract(SECOND FROM ts))")


class Tables:
    """The given tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def site_pages(self) -> DataFrame:
        """Pages with their host as scraper."""
        host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
        return self.pages.select("page_id", "url", host.alias("scraper"), "html")

    def items(self) -> DataFrame:
        """List items by regular expression, in the JVM alone."""
        nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
        listed = F.regexp_extract_all(nav, F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))
        return (
            self.site_pages()
            .select("page_id", "url", "scraper", F.posexplode(listed).alias("pos", "it"))
            .select(
                "page_id",
                "url",
                "scraper",
                "pos",
                F.regexp_extract("it", '<a href="([^"]*)"', 1).alias("link"),
                F.regexp_extract("it", r"<a [^>]*>(.*?)</a>", 1).alias("text"),
            )
        )

    def listed(self) -> DataFrame:
        """A row for each item in any menu of a page, with the page's address.

        Items are counted where their tags open, as their ends may be left out and items may hold further ones.
        """
        menus = F.regexp_extract_all("html", F.lit(MENU), F.lit(1))
        tags = F.flatten(F.transform(menus, lambda menu: F.regexp_extract_all(menu, F.lit(ITEM), F.lit(0))))
        return self.pages.select("page_id", "url", F.explode(tags).alias("tag"))

    def hashed_items(self) -> DataFrame:
        return self.items().withColumn("_hash", F.md5("link"))

    def prior(self) -> DataFrame:
        """Results stored by an earlier run, which had read every third page."""
        return (
            self.hashed_items()
            .filter("page_id % 3 = 0")
            .select(
                "scraper",
                "_hash",
                F.concat(F.lit("r"), "page_id", F.lit("-"), "pos").alias("id"),
                (F.col("page_id") * 1000 + F.col("pos")).alias("seq"),
            )
        )

    def links(self) -> DataFrame:
        """Item links; the pages of every fifth were never fetched."""
        missing = F.concat("url", F.lit("/missing"))
        return self.pages.select(
            "page_id", F.when(F.col("page_id") % 5 == 0, missing).otherwise(F.col("url")).alias("link")
        )

    def detail_pages(self) -> DataFrame:
        """Pages under the address their first menu link names."""
        first = F.regexp_extract("html", r'<nav><ul><li><a href="([^"]*)"', 1)
        return self.pages.select(
            "page_id", F.concat(F.regexp_extract("url", SITE, 1), first).alias("url"), "html"
        )

    def chain_pages(self) -> DataFrame:
        """Pages of a host in sequence, each naming the next."""
        listed = self.site_pages().select("page_id", F.col("scraper").alias("host"), "url")
        # The page after is the page before in descending order.
        ahead = with_previous(listed.withColumn("back", -F.col("page_id")), "host", "back", ["url"])
        first = listed.groupBy("host").agg(F.min("page_id").alias("first"))
        return lookup(ahead, first, ["host"], "left").select(
            "page_id", "host", "url", F.col("__prev.url").alias("next_url"), (F.col("page_id") == F.col("first")).alias("is_seed")
        )

    def scrapers(self) -> DataFrame:
        last = self.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("lastRunDate"))
        return (
            self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select(
                F.concat(F.lit("s"), "c_custkey").alias("id"),
                F.col("c_name").alias("name"),
                F.col("n_name").alias("city"),
                (F.col("c_acctbal") < 0).alias("running"),
                F.lit(False).alias("hidden"),
                "lastRunDate",
            )
        )

    def results(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.orders.select(
            F.concat(F.lit("r"), key).alias("id"),
            F.concat(F.lit("s"), "o_custkey").alias("scraper"),
            F.md5(F.concat(key.cast("string"), "o_orderpriority", "o_orderstatus")).alias("_hash"),
            (key % 8).cast("int").alias("modality"),
            key.cast("string").alias("number"),
            F.col("o_orderpriority").alias("agency"),
            F.when(key % 11 != 0, F.col("o_orderdate")).alias("openDate"),
            (F.col("o_orderstatus") == "F").alias("approved"),
            F.col("o_totalprice").alias("amount"),
        )

    def schedule_requests(self) -> DataFrame:
        key = F.col("p_partkey")
        turn = key % 10
        plain = F.concat_ws(" ", key % 60, key % 24, F.lit("* *"), key % 7)
        cron = (
            F.when(turn == 0, "5 45 7 * * 2-4")
            .when(turn == 1, "0 5,35 9 ? 11 TUE")
            .when(turn == 2, "0 20 18 ? * WED-SAT")
            .when(turn == 3, "not cron")
            .when(turn == 4, F.concat(key % 70, F.lit(" 5 * * 1")))
            .when(turn == 5, "*/5 0 * XYZ 1")
            .otherwise(plain)
        )
        return self.part.select(
            F.concat(F.lit("s"), key).alias("scraper"),
            F.when(F.col("p_size") % 2 == 0, "weekly").otherwise("daily").alias("frequency"),
            cron.alias("cron"),
        )

    def ticks(self) -> DataFrame:
        return self.events.select(tick().alias("tick")).distinct()

    def progress(self, events: DataFrame | None = None) -> DataFrame:
        event, value = F.col("event_id"), F.col("value")

        def per(n: int):
            return F.floor(value / n).cast("int")

        return (self.events if events is None else events).select(
            F.col("user_id").alias("task"),
            event.alias("seq"),
            "ts",
            (event % 20 >= 1).alias("isRunning"),
            per(10).alias("totalBiddings"),
            per(20).alias("totalExtracted"),
            per(20).alias("currentBidding"),
            per(30).alias("newBiddings"),
            (event % 3).cast("int").alias("currentTask"),
            F.col("event_type").alias("message"),
        )

    def updates(self, events: DataFrame | None = None) -> DataFrame:
        kind = F.col("event_type")
        return (self.events if events is None else events).select(
            F.col("user_id").alias("task"),
            F.col("event_id").alias("seq"),
            "ts",
            F.when(kind == "signup", True).when(kind == "error", False).alias("running"),
            F.when(kind == "error", 503).when(kind == "purchase", 203).when(kind == "view", 204).alias("code"),
            F.when(kind != "click", kind).alias("message"),
        )

    def file_requests(self) -> DataFrame:
        key = F.col("doc_id")
        name = key.cast("string")
        formats = F.array(*[F.lit(f) for f in ("zip", "rar", "doc", "docx", "pdf", "odt", "PDF")])
        return self.documents.select(
            "doc_id",
            F.when(key % 3 == 0, F.concat(F.lit("http://x.example/"), name)).alias("uri"),
            F.when(key % 3 == 1, name).alias("id"),
            F.when(key % 3 == 1, F.concat(F.lit("f"), name)).alias("filename"),
            F.get(formats, (key % 7).cast("int")).alias("format"),
            ((key % 4).cast("int") - 1).alias("fileIndex"),
        )

    def requests(self) -> DataFrame:
        key = F.col("o_orderkey")
        value = (
            F.when(key % 7 == 1, "$today")
            .when(key % 7 == 2, "$lastRunDate")
            .when(key % 7 == 3, "$nextYear")
            .when(key % 7 == 4, "$other")
            .when(key % 7 != 0, "14/10/2016")
        )
        return self.orders.select(
            key.alias("task"),
            F.when(key % 4 == 0, F.concat(F.lit("http://a.example/"), key)).alias("uri"),
            F.when(key % 6 != 0, "http://b.example/").alias("baseURI"),
            F.when(key % 5 == 0, "q.aspx").alias("postURI"),
            F.when(key % 3 == 0, "GET").when(key % 3 == 1, "POST").alias("method"),
            value.alias("form_value"),
            F.concat(F.lit("s"), "o_custkey").alias("scraper"),
        )
