"""C: normalising single values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import notice as N
from tenderlake.functions import text as X
from tenderlake.plans.catalog import query
from tenderlake.plans.views import Tables

SPELLINGS = [
    "PP", "Pregão Presencial", "pe", "PREGÃO ELETRÔNICO", "concorrência", "Concorrência Pública", "cp", "Convite",
    "concurso", "Leilão", "tomada de preço", "Tomada de Preços", "convênio", "pregao presencial", " pp", "",
]


@query(
    """
    SELECT o_orderkey, CASE WHEN k <= 1 THEN 0 WHEN k <= 3 THEN 1 WHEN k <= 6 THEN 2 WHEN k = 7 THEN 3
      WHEN k = 8 THEN 4 WHEN k = 9 THEN 5 WHEN k <= 11 THEN 6 WHEN k = 12 THEN 7 END AS modality
    FROM (SELECT o_orderkey, o_orderkey % 16 AS k FROM orders)
    """
)
def modality_code(t: Tables) -> DataFrame:
    spelling = F.get(F.array(*[F.lit(s) for s in SPELLINGS]), (F.col("o_orderkey") % 16).cast("int"))
    return t.orders.select("o_orderkey", N.modality_code(spelling).alias("modality"))


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 8 <= 2
      THEN CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) + INTERVAL 3 HOUR END AS opened
    FROM orders
    """
)
def notice_date(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    turn = F.col("o_orderkey") % 8
    texts = (
        F.when(turn == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(turn == 1, F.date_format(day, "dd-MM-yyyy"))
        .when(turn == 2, F.date_format(day, "d/M/yyyy"))
        .when(turn == 3, F.date_format(day, "dd/MM"))
        .when(turn == 4, F.date_format(day, "'31/02/'yyyy"))
        .when(turn == 5, F.date_format(day, "dd.MM.yyyy"))
        .when(turn == 6, F.date_format(day, "dd/MM/yyyy/d"))
        .otherwise(F.date_format(day, "dd/MM/yy"))
    )
    return t.orders.select("o_orderkey", N.notice_date(texts).alias("opened"))


@query(
    r"""
    SELECT page_id, pos, pos IN (0, 1, 2, 4) AS valid FROM v_items
    """
)
def uri_valid(t: Tables) -> DataFrame:
    return t.items().select("page_id", "pos", X.is_uri(_variants()).alias("valid"))


def _variants():
    """By position: root path, absolute, parent path, relative, query, fragment."""
    pos, link = F.col("pos"), F.col("link")
    return (
        F.when(pos == 0, link)
        .when(pos == 1, F.col("url"))
        .when(pos == 2, F.concat(F.lit(".."), link))
        .when(pos == 3, F.expr("substr(link, 2)"))
        .when(pos == 4, F.concat(F.lit("?"), link))
        .otherwise(F.concat(F.lit("#"), link))
    )


@query(
    r"""
    SELECT page_id, pos, CASE pos WHEN 0 THEN concat(site, link) WHEN 1 THEN url
        WHEN 2 THEN concat(site, regexp_replace(regexp_replace(folder, '[^/]*/$', ''), '^$', '/'), substr(link, 2))
        WHEN 3 THEN concat(site, folder, substr(link, 2)) WHEN 4 THEN concat(site, path, '?', link)
        ELSE concat(site, path, q, '#', link) END AS resolved
    FROM (SELECT *, regexp_extract(path, '^(.*/)', 1) AS folder
          FROM (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site,
                  regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
                  regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q FROM v_items))
    """
)
def resolve_url(t: Tables) -> DataFrame:
    return t.items().select("page_id", "pos", X.resolve_url(F.col("url"), _variants()).alias("resolved"))


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN md5(concat(o_orderkey, o_orderpriority, o_orderstatus))
      WHEN o_orderkey % 4 = 1 THEN md5(concat('/n/', o_custkey)) WHEN o_orderkey % 4 = 2 THEN ''
      ELSE md5(concat(o_orderkey, o_orderpriority, o_orderstatus)) END AS _hash FROM orders
    """
)
def item_hash(t: Tables) -> DataFrame:
    """Full key, link alone, neither, and both."""
    turn = F.col("o_orderkey") % 4
    link = F.when(turn.isin(1, 3), F.concat(F.lit("/n/"), "o_custkey")).otherwise("")
    agency = F.when(turn.isin(0, 3), F.col("o_orderpriority")).when(turn == 1, "")
    number = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", N.item_hash(number, agency, F.col("o_orderstatus"), link).alias("_hash"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def date_text(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", N.date_text(F.col("o_orderdate")).alias("day"))


@query(
    r"""
    SELECT page_id, regexp_extract(x, '([^/]*)$', 1) AS with_ext,
      CASE WHEN page_id % 3 = 0 THEN concat('p', page_id, '.v') WHEN page_id % 3 = 1 THEN '' ELSE '' END AS without_ext,
      '' AS bare
    FROM (SELECT page_id, concat(regexp_extract(url, '^([^?#]*)', 1), CASE page_id % 3 WHEN 0 THEN concat('/p', page_id, '.v.html')
            WHEN 1 THEN '/x' ELSE '/' END) AS x FROM pages WHERE page_id % 3 = 0
          UNION ALL SELECT page_id, concat('d/p', page_id) FROM pages WHERE page_id % 3 = 1
          UNION ALL SELECT page_id, 'd.e/' FROM pages WHERE page_id % 3 = 2)
    """
)
def path_name(t: Tables) -> DataFrame:
    """Paths with two dots, without a dot, and with a dot only before the slash."""
    page = F.col("page_id")
    path = (
        F.when(page % 3 == 0, F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("/p"), page, F.lit(".v.html")))
        .when(page % 3 == 1, F.concat(F.lit("d/p"), page))
        .otherwise("d.e/")
    )
    return t.pages.select(
        "page_id",
        X.path_name(path, True).alias("with_ext"),
        X.path_name(path, False).alias("without_ext"),
        X.path_name(F.concat(F.lit("p"), page, F.lit(".html")), True).alias("bare"),
    )
