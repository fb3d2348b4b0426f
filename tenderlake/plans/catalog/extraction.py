"""A and B: sources, and extraction from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import js_function_name, link_target, download_info, reduce_pattern
from tenderlake.operators.dom import Selector
from tenderlake.operators.extract import (
    extract_items,
    extract_notices,
    form_state,
    item_fields,
    page_links,
    recipe_coverage,
)
from tenderlake.plans.catalog import query
from tenderlake.plans.views import Tables
from tenderlake.session import scratch_path
from tenderlake.sources.pages import decode_pages, list_files
from tenderlake.sources.recipes import Recipe, Task, parse_recipes
from tenderlake.sources.results import append_new, table, with_defaults

JS_CLASS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def task(task_id: str, selectors: dict, patterns: dict | None = None) -> Task:
    compiled = {
        k: tuple(Selector(s) for s in ([v] if isinstance(v, str) else v)) for k, v in selectors.items()
    }
    return Task(task_id, task_id == "GET_LINKS", False, compiled, patterns or {})


MENU = {"container": "nav > ul", "listItem": "li", "link": "a"}
SITE_RECIPE = Recipe(
    "site",
    "utf-8",
    False,
    (
        task("GET_LINKS", MENU),
        task("GET_DETAILS", {"container": "article", "number": "h1", "description": ["h2", "h1"]}),
    ),
)


@query(
    """
    SELECT concat('c', c_custkey) AS recipe_id, c_name AS recipe_name, CAST(i AS INT) AS task_idx,
      CASE i WHEN 0 THEN 'GET_LINKS' WHEN 1 THEN 'GET_DETAILS' END AS task_id,
      i = 0 AND c_custkey % 10 <> 3 AS is_list,
      CAST(1000 + c_custkey % 7 * 500 AS VARCHAR) AS delay,
      CASE WHEN i = 0 THEN CAST(c_nationkey AS VARCHAR) END AS form_area,
      CASE WHEN i = 0 THEN c_mktsegment END AS form_text,
      CASE i WHEN 0 THEN 2 WHEN 1 THEN 1 END AS n_link_selectors,
      CAST(NULL AS VARCHAR) AS reason
    FROM customer LEFT JOIN (VALUES (0), (1)) t(i) ON c_custkey % 10 <> 3
    WHERE c_custkey % 10 > 2
    UNION ALL
    SELECT concat('c', c_custkey), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      CASE WHEN c_custkey % 10 = 1 THEN 'empty' ELSE 'unparsable' END
    FROM customer WHERE c_custkey % 10 <= 2
    """
)
def recipe_tasks(t: Tables) -> DataFrame:
    """One recipe per customer; some broken, empty, of the wrong shape or without tasks."""
    routine = F.concat(
        F.lit(
            ',"routine":[{"id":"GET_LINKS","list":true,"selectors":{"container":"nav > ul","link":["a.x","a"]},'
            '"request":{"method":"POST","form":{"area":'
        ),
        "c_nationkey",
        F.lit(',"text":"'),
        "c_mktsegment",
        F.lit('"}}},{"id":"GET_DETAILS","selectors":{"link":"a.doc"},"patterns":{"number":"[0-9]+"}}]'),
    )
    turn = F.col("c_custkey") % 10
    body = (
        F.when(turn == 0, '{"name": ')
        .when(turn == 1, "{}")
        .when(turn == 2, "[1, 2]")
        .otherwise(
            F.concat(
                F.lit('{"name":"'),
                "c_name",
                F.lit('","delay":'),
                1000 + F.col("c_custkey") % 7 * 500,
                F.when(turn == 3, "").otherwise(routine),
                F.lit("}"),
            )
        )
    )
    bodies = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("recipe_id"), body.alias("body"))
    tasks, rejects = parse_recipes(bodies)
    form = F.col("request.form")
    return tasks.select(
        "recipe_id",
        "recipe_name",
        "task_idx",
        "task_id",
        "is_list",
        "delay",
        F.try_element_at(form, F.lit("area")).alias("form_area"),
        F.try_element_at(form, F.lit("text")).alias("form_text"),
        F.size(F.try_element_at("selectors", F.lit("link"))).alias("n_link_selectors"),
        F.lit(None).cast("string").alias("reason"),
    ).unionByName(rejects, allowMissingColumns=True)


@query(
    r"""
    SELECT page_id, page_id % 8 = 2 AS entities, page_id % 8 = 3 AS rejected,
      CASE WHEN page_id % 8 <> 3 THEN md5(h) END AS html_md5,
      CASE WHEN page_id % 8 <> 3 THEN CAST(length(h) AS INT) END AS n_chars
    FROM (SELECT page_id, CASE WHEN page_id % 8 = 0 THEN regexp_replace(html, '[^\x{00}-\x{FF}]', '?', 'g')
                          ELSE html END AS h FROM pages)
    """
)
def pages_decode(t: Tables) -> DataFrame:
    """Pages encoded in several character sets, without a named one, and under an unknown name."""
    turn = F.col("page_id") % 8
    latin = F.encode(F.regexp_replace("html", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    wide = {4: ("UTF-16LE", "utf-16le", ""), 5: ("UTF-16BE", "UTF-16", "\ufeff"), 6: ("UTF-16LE", "utf-16", ""), 7: ("UTF-32", "utf-32", "")}
    body, charset = F.when(turn == 0, latin), F.when(turn == 0, "ISO-8859-1").when(turn == 1, "utf-8").when(turn == 3, "koi8-r")
    for number, (kind, name, mark) in wide.items():
        body = body.when(turn == number, F.encode(F.concat(F.lit(mark), "html"), kind))
        charset = charset.when(turn == number, name)
    raw = t.pages.select("page_id", body.otherwise(F.encode("html", "UTF-8")).alias("body"), charset.alias("charset"))
    return decode_pages(raw).select(
        "page_id", "entities", "rejected", F.md5("html").alias("html_md5"), F.length("html").alias("n_chars")
    )


RESULT_SQL = """
    SELECT scraper, _hash, modality, number, agency, "openDate", CAST(NULL AS TIMESTAMP) AS "publishDate",
      CASE WHEN modality = 3 THEN 0 ELSE amount END AS amount, approved, false AS ignored, false AS exclusive,
      true AS no_download
    FROM {source}
"""


def _stored(df: DataFrame) -> DataFrame:
    return df.select(
        "scraper", "_hash", "modality", "number", "agency", "openDate", "publishDate", "amount", "approved",
        "ignored", "exclusive", F.col("download.uri").isNull().alias("no_download"),
    )


def _partial_results(t: Tables) -> DataFrame:
    return t.results().withColumn("amount", F.when(F.col("modality") != 3, F.col("amount")))


@query(RESULT_SQL.format(source="v_result"))
def results_defaults(t: Tables) -> DataFrame:
    return _stored(with_defaults(_partial_results(t)))


@query(RESULT_SQL.format(source="v_result"))
def results_append(t: Tables) -> DataFrame:
    """Three appends, of which the last repeats all rows: nothing is stored twice."""
    path = scratch_path(t.spark, "results")
    rows = with_defaults(_partial_results(t))
    append_new(rows.filter("modality < 4"), path)
    append_new(rows.filter("modality >= 4"), path)
    append_new(rows, path)
    return _stored(table(t.spark, path, rows.schema).read())


@query()
def file_listing(t: Tables) -> DataFrame:
    """No SQL: the folder's name is not known to it."""
    listed = list_files(t.spark, t.folder, "*.parquet")
    return listed.select(F.substring_index("path", "/", -1).alias("file"), "length")


@query("SELECT page_id, url, scraper, pos, link, _hash FROM v_hashed")
def list_items(t: Tables) -> DataFrame:
    items = extract_items(t.site_pages(), [SITE_RECIPE])
    return items.select("page_id", "url", "scraper", "pos", "link", "_hash")


@query(
    r"""
    SELECT page_id, coalesce(l[6], l[5], l[4], l[3], '') AS number, '' AS agency,
      array_to_string(l, '') AS description, regexp_extract(l[1], '^.', 0) AS modality
    FROM (SELECT page_id, list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
            '(?s)<li>(.*?)</li>', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS l FROM pages)
    """
)
def field_text_fallback(t: Tables) -> DataFrame:
    fields = {
        "container": "nav",
        "listItem": "ul",
        "link": "a",
        "number": [f"li:nth-child({n})" for n in (6, 5, 4, 3)],
        "agency": ["b", "span.none"],
        "description": "li",
        "modality": ["em", "li:nth-child(1)"],
    }
    recipe = Recipe("fields", "utf-8", False, (task("GET_LINKS", fields, {"modality": "^."}),))
    items = extract_items(t.site_pages(), [recipe])
    return items.select("page_id", "number", "agency", "description", "modality")


@query(
    rf"""
    SELECT doc_id, CASE
        WHEN doc_id % 4 = 0 AND regexp_matches(n, '[A-Z][a-z]+ [a-z]+') THEN regexp_extract(n, '[A-Z][a-z]+ [a-z]+', 0)
        WHEN doc_id % 4 = 1 AND regexp_matches(n, '([a-z]+), (?:[a-z]+) ([a-z]+)')
          THEN regexp_extract(n, '([a-z]+), (?:[a-z]+) ([a-z]+)', 2)
        ELSE tx END AS reduced
    FROM (SELECT doc_id, tx, regexp_replace(regexp_replace(tx, '(\r\n|\n|\r|{JS_CLASS}+)', ' ', 'g'),
              '{JS_CLASS}{{2,}}', chr(10), 'g') AS n
          FROM (SELECT doc_id, regexp_replace("text", '^{JS_CLASS}+|{JS_CLASS}+$', '', 'g') AS tx FROM documents))
    """
)
def pattern_reduce(t: Tables) -> DataFrame:
    """Whole match, last of two groups, a miss, and no pattern."""
    turn = F.col("doc_id") % 4
    pattern = (
        F.when(turn == 0, "[A-Z][a-z]+ [a-z]+")
        .when(turn == 1, "([a-z]+), (?:[a-z]+) ([a-z]+)")
        .when(turn == 2, "no such (text)")
    )
    group = F.when(turn == 0, 0).when(turn == 1, 2).otherwise(1)
    return t.documents.select("doc_id", reduce_pattern(F.col("text"), pattern, group).alias("reduced"))


@query(
    """
    SELECT page_id, pos, CASE WHEN pos % 3 = 0 THEN link WHEN pos % 3 = 1 THEN substr(link, 2) ELSE '' END AS target
    FROM v_items
    """,
    name="link_target",
)
def link_targets(t: Tables) -> DataFrame:
    """Plain links, postback calls, and calls that quote nothing."""
    name = F.expr("substr(link, 2)")
    href = (
        F.when(F.col("pos") % 3 == 0, F.col("link"))
        .when(F.col("pos") % 3 == 1, F.concat(F.lit("javascript:__doPostBack('"), name, F.lit("','')")))
        .otherwise(F.concat(F.lit("javascript:__doPostBack("), name, F.lit(")")))
    )
    return t.items().select("page_id", "pos", link_target(href).alias("target"))


@query(
    """
    SELECT page_id, pos, link, "text" AS description, CAST(NULL AS VARCHAR) AS number FROM v_items
    UNION ALL SELECT page_id, pos, NULL, NULL, NULL FROM v_items
    """
)
def item_projection(t: Tables) -> DataFrame:
    """With a link selector the configured fields, without one nothing."""
    recipe = Recipe("menu", "utf-8", False, (task("GET_LINKS", {**MENU, "description": "a", "number": "a"}),))
    items = extract_items(t.site_pages(), [recipe])
    linked = item_fields(items, ["link", "description"])
    bare = item_fields(items, ["description", "number"])
    # A field that the recipe has and the projection does not name is no column: of ``number`` only the second has one.
    both = linked.unionByName(bare, allowMissingColumns=True)
    return both.select("page_id", "pos", "link", "description", "number")


@query(
    rf"""
    SELECT page_id, h1 AS description, h1 AS number,
      CASE WHEN regexp_matches(n, '([a-z]+)\. ([A-Z][a-z]+)') THEN regexp_extract(n, '([a-z]+)\. ([A-Z][a-z]+)', 2)
        ELSE tx END AS agency,
      CAST(NULL AS INT) AS modality, CAST(NULL AS TIMESTAMP) AS "openDate", CAST(NULL AS TIMESTAMP) AS "publishDate",
      link AS relative_uri, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), link) AS uri
    FROM (SELECT page_id, url, h1, link, tx, regexp_replace(regexp_replace(tx, '(\r\n|\n|\r|{JS_CLASS}+)', ' ', 'g'),
            '{JS_CLASS}{{2,}}', chr(10), 'g') AS n
          FROM (SELECT page_id, url, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS h1,
                  regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1) AS link,
                  trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g')) AS tx
                FROM pages))
    """
)
def notice_records(t: Tables) -> DataFrame:
    fields = {"container": "article", "number": "h1", "description": ["h2", "h1"], "link": "nav a"}
    patterns = {"agency": r"([a-z]+)\. ([A-Z][a-z]+)"}
    recipe = Recipe("site", "utf-8", False, (task("GET_DETAILS", fields, patterns),))
    notices = extract_notices(t.site_pages(), [recipe])
    return notices.select(
        "page_id", "description", "number", "agency", "modality", "openDate", "publishDate",
        F.col("download.relativeUri").alias("relative_uri"), F.col("download.uri").alias("uri"),
    )


@query(
    """
    SELECT page_id, pos, h AS relative_uri, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), h) AS uri,
      CASE pos WHEN 0 THEN regexp_extract(h, '([^/]*)$', 1) WHEN 1 THEN regexp_extract(h, '([^/]*)$', 1)
        WHEN 2 THEN 'Edital.7Z' END AS file_name,
      CASE pos WHEN 0 THEN 'pdf' WHEN 1 THEN 'DOCX' WHEN 2 THEN '7Z' END AS file_format
    FROM (SELECT page_id, url, pos, concat(link, CASE pos WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '?a=1&b=2'
            WHEN 3 THEN '.zip?v=1' ELSE '' END) AS h FROM v_items)
    """,
    name="download_info",
)
def download_infos(t: Tables) -> DataFrame:
    pos = F.col("pos")
    ending = (
        F.when(pos == 0, ".pdf").when(pos == 1, ".DOCX").when(pos == 2, "?a=1&amp;b=2").when(pos == 3, ".zip?v=1")
    ).otherwise("")
    text = F.when(pos == 2, " Edital.7Z ").otherwise(F.col("text"))
    info = download_info(text, F.concat("link", ending), F.col("url"))
    return t.items().select("page_id", "pos", info.alias("d")).select(
        "page_id", "pos", F.col("d.relativeUri").alias("relative_uri"), F.col("d.uri").alias("uri"),
        F.col("d.fileName").alias("file_name"), F.col("d.fileFormat").alias("file_format"),
    )


@query(
    """
    SELECT page_id, pos, CASE pos % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('open', page_id) WHEN 2 THEN 'ab'
      ELSE '' END AS function_name FROM v_items
    """,
    name="js_function_name",
)
def js_function_names(t: Tables) -> DataFrame:
    turn = F.col("pos") % 4
    href = (
        F.when(turn == 0, F.col("link"))
        .when(turn == 1, F.concat(F.lit("javascript:open"), "page_id", F.lit("('x');")))
        .when(turn == 2, "JavaScript:a;b(1)")
        .otherwise("javascript(a):b(1)")
    )
    return t.items().select("page_id", "pos", js_function_name(href).alias("function_name"))


HIDDEN = (
    '<input type="hidden" id="__VIEWSTATE" value="v{0}"><input id="__EVENTVALIDATION" value="e{0}">'
)


@query(
    """
    SELECT page_id, '__EVENTARGUMENT' AS key, '' AS value FROM pages
    UNION ALL SELECT page_id, '__VIEWSTATE', concat('v', page_id) FROM pages
    UNION ALL SELECT page_id, '__EVENTVALIDATION', concat('e', page_id) FROM pages
    UNION ALL SELECT page_id, '__VIEWSTATEGENERATOR', NULL FROM pages
    UNION ALL SELECT page_id, '__EVENTTARGET', concat('t', page_id) FROM pages WHERE page_id % 2 = 0
    """,
    name="form_state",
)
def form_states(t: Tables) -> DataFrame:
    head, middle, tail = HIDDEN.split("{0}")
    html = F.concat("html", F.lit(head), "page_id", F.lit(middle), "page_id", F.lit(tail))
    target = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("t"), "page_id"))
    forms = form_state(t.site_pages().withColumn("html", html), [SITE_RECIPE], target)
    return forms.select("page_id", F.explode("form").alias("key", "value"))


def _paged(t: Tables) -> DataFrame:
    """Pages with paging links added: plain, as postback, or none."""
    turn = F.col("page_id") % 3
    following = (
        F.when(turn == 0, F.concat(F.lit('<a id="next" href="/p/'), F.col("page_id") + 1, F.lit('">+</a>')))
        .when(turn == 1, "<a id=\"next\" href=\"javascript:__doPostBack('n','')\">+</a>")
        .otherwise("")
    )
    earlier = F.when(F.col("page_id") % 2 == 0, '<a id="prev" href="/p/0">-</a>').otherwise("")
    return t.site_pages().withColumn("html", F.concat("html", following, earlier))


PAGED_RECIPE = Recipe(
    "paged",
    "utf-8",
    False,
    (
        task("GET_LINKS", {**MENU, "nextPage": "#next", "prevPage": "a#prev"}),
        task(
            "GET_DETAILS",
            {"container": "article", "number": "h1", "description": ["h2", "h1"], "agency": "h3"},
            {"openDate": r"\d{2}/\d{2}/\d{4}"},
        ),
    ),
)


@query(
    """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('/p/', page_id + 1) WHEN 1 THEN 'n' END AS next_target,
      CASE WHEN page_id % 2 = 0 THEN '/p/0' END AS prev_target, page_id % 3 <> 2 AS has_next,
      page_id % 2 = 0 AS has_prev FROM pages
    """,
    name="page_links",
)
def paging_links(t: Tables) -> DataFrame:
    found = page_links(_paged(t), [PAGED_RECIPE])
    return found.select("page_id", "next_target", "prev_target", "has_next", "has_prev")


@query(
    r"""
    SELECT r.recipe_id, page_id, CASE WHEN r.recipe_id = 'paged' THEN n ELSE 0 END AS n_items,
      CASE WHEN r.recipe_id = 'paged' THEN n ELSE 0 END AS n_links,
      CASE WHEN r.recipe_id = 'paged' THEN 3 ELSE 1 END AS n_fields,
      r.recipe_id = 'paged' AND page_id % 3 <> 2 AS has_next, r.recipe_id = 'paged' AND page_id % 2 = 0 AS has_prev
    FROM (SELECT page_id, CAST(count(*) AS INT) AS n FROM v_items GROUP BY page_id),
      (VALUES ('paged'), ('title')) r(recipe_id)
    """,
    name="recipe_coverage",
)
def recipe_dry_run(t: Tables) -> DataFrame:
    title = Recipe("title", "utf-8", False, (task("GET_DETAILS", {"container": "head", "description": "title"}),))
    found = recipe_coverage(_paged(t), [PAGED_RECIPE, title])
    return found.select("recipe_id", "page_id", "n_items", "n_links", "n_fields", "has_next", "has_prev")
