"""URL filter: rules where they fit, and PageRank over the link graph of hosts where none does.

A rule names a host and a path; it fits its host and all subdomains, for paths that start with the rule's,
and the longest fitting rule decides. For the other pages their host decides, by two numbers from 0 to 1.

Trust flows along links, by personalised PageRank from the hosts' shares of allowed pages; distrust flows against
them, from the shares of blocked pages: who links to blocked hosts is suspect. A rank alone thins out where a host
hands it to many, so it is held against the rank that the same host receives in the same direction when all hosts
start alike: the part of what comes in that stems from trusted, or blocked, ones. To this, damped once and for the
share of its pages without a rule, a host adds its own share. A host is blocked if its distrust reaches
``threshold`` and exceeds its trust. Both ranks go through the same rounds, so one table carries them.

Edges are counted per pair of hosts before anything else, so the graph is as large as the host pairs, not
the links. Ranks meet edges by joins of plain rows: a host with very many links is split like any hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import cut, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
STEADY = 1e-6
ROUNDS_PER_TABLE = 4
# Sums in another order differ by less.
NOISE = 1e-9
THRESHOLD = 0.5
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """Lower-case host after the first ``://``; empty without one."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], part: str) -> Column:
    """``part`` ("rule" or "verdict") of the longest rule that fits; NULL if none does."""
    found: list[Column] = []
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found.append(F.when(fits, F.lit(name + prefix if part == "rule" else verdict)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))
    return (
        pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(links)).alias("link"))
        .select("src", F.translate("link", UPPER, LOWER).alias("dst"))
        .where("src <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank over weighted edges (src, dst, n), for every column of ``seeds`` beside ``host`` at once.

    A rank is what a walk leaves at a host that starts at the seeds and ends with the same chance at each step; at a
    host without edges it ends anyway. So ranks add up over seeds, and a larger seed never gives a smaller rank.
    Rounds end when they move no rank by ``STEADY``; ``ROUNDS_PER_TABLE`` of them are one written table.
    """
    columns = [c for c in seeds.columns if c != "host"]
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = cut(
        edges.join(out, "src").select(F.col("src").alias("host"), "dst", (damping * F.col("n") / F.col("all")).alias("share"))
    )
    starts = cut(seeds.groupBy("host").agg(*(((1 - damping) * F.sum(c)).alias(c) for c in columns)))
    if shares.isEmpty():
        return starts
    ranks, old = starts, [f"old_{c}" for c in columns]
    while True:
        new = ranks
        for _ in range(ROUNDS_PER_TABLE):
            before = new
            moved = before.join(shares, "host").select(F.col("dst").alias("host"), *((F.col(c) * F.col("share")).alias(c) for c in columns))
            new = moved.union(starts.select("host", *columns)).groupBy("host").agg(*(F.sum(c).alias(c) for c in columns))
        # The last round beside the one before it: their difference bounds all that is still to come.
        zero, last = F.lit(0.0), [F.col(c).alias(o) for c, o in zip(columns, old, strict=True)]
        both = new.select("host", *columns, *(zero.alias(o) for o in old)).union(
            before.select("host", *(zero.alias(c) for c in columns), *last)
        )
        both = cut(both.groupBy("host").agg(*(F.sum(c).alias(c) for c in (*columns, *old))))
        moves = [F.max(F.abs(F.col(c) - F.col(o))) for c, o in zip(columns, old, strict=True)]
        ranks = both.select("host", *columns)
        if max(both.agg(*moves).first(), default=0.0) < STEADY:
            return ranks


def flow(edges: DataFrame, shares: DataFrame, own: str) -> DataFrame:
    """(host, rank): a host's share ``own``, plus, damped and for its share ``open``, the part of the PageRank it
    receives that stems from such shares."""
    known = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host")))
    known = known.union(shares.select("host")).distinct()
    seeds = known.join(shares.select("host", F.col(own).alias("own")), "host", "left")
    ranks = spread(edges, seeds.select("host", F.coalesce("own", F.lit(0.0)).alias("own"), F.lit(1.0).alias("every")))
    came = F.col("rank_own") - (1 - DAMPING) * F.col(own)
    all_came = F.col("every") - (1 - DAMPING)
    part = F.when(all_came > NOISE, F.least(F.greatest(came, F.lit(0.0)) / all_came, F.lit(1.0))).otherwise(0.0)
    joined = shares.join(ranks.withColumnRenamed("own", "rank_own"), "host")
    return joined.select("host", (F.col(own) + DAMPING * F.col("open") * part).alias("rank"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row, with the host's two numbers.

    A NULL url or one without ``://`` has an empty host and path, fits no rule and is allowed: hosts without
    a name take no part in the graph. NULL html has no links. Repeated rows are judged each and count each
    in their host's shares. An empty table gives an empty result. Other columns are not read.
    """
    key, address, text = free_name(pages, "url_page", "url_address", "url_text")
    rows = pages.select(F.col(page_id).alias(key), F.col(url).alias(address), F.col(html).alias(text))
    rows = rows.withColumns({"host": host_of(F.col(address)), "path": path_of(F.col(address))})
    rows = rows.withColumns({p: rule_of(F.col("host"), F.col("path"), rules, p) for p in ("rule", "verdict")})
    edges = cut(host_edges(rows, "host", text))
    judged = rows.select(F.col(key).alias(page_id), "host", "path", "rule", "verdict")
    share = lambda found: F.avg(found.cast("double"))
    shares = cut(
        judged.where("host <> ''")
        .groupBy("host")
        .agg(
            *(share(F.coalesce("verdict", F.lit("")) == v).alias(v) for v in ("allow", "block")),
            share(F.col("verdict").isNull()).alias("open"),
        )
    )
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust, distrust = flow(edges, shares, "allow"), flow(against, shares, "block")
    hosts = cut(
        shares.select("host")
        .join(trust.withColumnRenamed("rank", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
        .select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
    )
    bad = (F.col("distrust") >= threshold - NOISE) & (F.col("distrust") > F.col("trust") + NOISE)
    verdict = F.coalesce("verdict", F.when(bad, "block").otherwise("allow"))
    return judged.join(hosts, "host", "left").select(
        page_id, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust"
    )
