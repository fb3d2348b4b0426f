"""The page tree, selectors, and extraction from hand-written pages."""

import pytest

from tenderlake.operators.dom import Page, Selector
from tenderlake.operators.extract import extract_items, extract_notices, page_links
from tenderlake.plans.catalog import QUERIES
from tenderlake.plans.catalog.extraction import task
from tenderlake.sources.pages import decode_pages
from tenderlake.sources.recipes import Recipe, load_recipes, parse_recipes, read_recipes

HTML = """<!DOCTYPE html><html><body class="a b"><!-- <p>no</p> --><script>var t="</p><p>x";</script>
<table id="t"><tr><td>1<td>A &amp; B<td>pp<tr><td>2</td><td>C</td><td>pe</td></table>
<div class="box c1"><p>one<br>two<p>three <b>bold</div><div class="box"><a href='/x?a=1&amp;b=2' target="_blank">go</a></div>
<ul><li><a>no href</a><li><a href="javascript:__doPostBack('t$1','')">post</a></ul>"""


def texts(selector, entities=False):
    page = Page(HTML, entities)
    return [page.text(n).strip() for n in page.find(Selector(selector))]


@pytest.mark.parametrize(
    "selector,want",
    [
        ("td:nth-child(1)", ["1", "2"]),
        ("#t td:nth-child(2)", ["A &amp; B", "C"]),
        ("div.box.c1 > p", ["onetwo", "three bold"]),
        ("div.box p b", ["bold"]),
        ("body.b > div:nth-child(4) a[target='_blank']", ["go"]),
        ("a[href]", ["go", "post"]),
        ("ul > li", ["no href", "post"]),
        ("table > td", []),
        ("*.box", ["onetwothree bold", "go"]),
    ],
)
def test_selectors(selector, want):
    assert texts(selector) == want


def test_entities_stay_or_go():
    assert texts("#t td:nth-child(2)")[0] == "A &amp; B"
    assert texts("#t td:nth-child(2)", True)[0] == "A & B"
    page = Page(HTML)
    assert page.attr(page.find(Selector("div.box a"))[0], "href") == "/x?a=1&amp;b=2"


@pytest.mark.parametrize("source", ["a, b", "a + b", "a:hover", "a[href^='x']", "", ":nth-child(2n)"])
def test_other_selectors_are_refused(source):
    with pytest.raises(ValueError):
        Selector(source)


def test_broken_markup_ends():
    page = Page("<p>a <b>b <p>c <i class='x y'>d < e <q")
    assert "".join(page.text(n) for n in page.find(Selector("i.y"))) == "d < e <q"
    assert Page("").find(Selector("p")) == []


def test_hostile_markup_stays_fast():
    n = 40000
    for body in ("<b>" * n + "</i>" * n, "<a<" * n, '<a "' * n, "<div>" * n + "<p>x", "<!--" * n, "<p>" * n):
        page = Page(body)
        page.find(Selector("div div p"))
    assert Page("<p>a<!-- b <p>c").find(Selector("p")) == [0]


def pages(spark, *bodies):
    rows = [(i, f"http://h.example/l/{i}", "s", body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id bigint, url string, scraper string, html string")


FIELDS = {"number": "td:nth-child(1)", "agency": "td:nth-child(2)", "modality": "td:nth-child(3)", "link": "a"}


def test_items_of_a_table(spark):
    recipe = Recipe("r", "utf-8", False, (task("GET_LINKS", {"container": "#t", "listItem": "tr", **FIELDS}),))
    found = extract_items(pages(spark, HTML, "<p>nothing</p>"), [recipe]).orderBy("pos").collect()
    assert [(r.pos, r.number, r.agency, r.modality, r.link) for r in found] == [
        (0, "1", "A &amp; B", "pp", ""), (1, "2", "C", "pe", "")
    ]
    assert all(len(r._hash) == 32 for r in found) and found[0].openDate is None


def test_item_is_the_anchor(spark):
    recipe = Recipe("r", "utf-8", False, (task("GET_LINKS", {"container": "ul", "link": "a"}),))
    found = extract_items(pages(spark, HTML), [recipe]).orderBy("pos").collect()
    assert [(r.link, r._hash != "") for r in found] == [("", False), ("t$1", True)]


def test_no_link_selector_gives_nothing(spark):
    selectors = {"container": "#t", "listItem": "tr", "number": "td"}
    recipe = Recipe("r", "utf-8", False, (task("GET_LINKS", selectors),))
    found = extract_items(pages(spark, HTML), [recipe]).collect()
    assert [(r.number, r.link, r._hash) for r in found] == [(None, None, "")] * 2


def test_recipe_of_the_page(spark):
    one = Recipe("one", "utf-8", False, (task("GET_LINKS", {"container": "ul", "listItem": "li", "link": "a"}),))
    two = Recipe("two", None, False, (task("GET_LINKS", {"container": "body", "listItem": "div.box", "link": "a"}),))
    rows = [(1, "u", "one", HTML), (2, "u", "two", HTML), (3, "u", "gone", HTML)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, recipe_id string, html string")
    found = extract_items(df, [one, two]).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.recipe_id, r.link) for r in found] == [
        (1, "one", ""), (1, "one", "t$1"), (2, "two", ""), (2, "two", "/x?a=1&b=2")
    ]


def test_notice_of_a_page(spark):
    body = """<body><h1>Edital</h1><div class="c">Notice No. 7-2017
        opens  03/03/2017  kind <i>PP</i></div><a class="d" href="e.PDF">baixar</a></body>"""
    details = task(
        "GET_DETAILS",
        {"container": "div.c", "modality": ["u", "i"], "link": "a.d", "publishDate": "u"},
        {"number": r"No\. (?:de )?([0-9]+-[0-9]+)", "openDate": r"(?:opens|from) *([0-9/]{10})"},
    )
    row = extract_notices(pages(spark, body), [Recipe("r", "utf-8", False, (details,))]).first()
    assert (row.number, row.modality, str(row.openDate), row.publishDate) == ("7-2017", 0, "2017-03-03 03:00:00", None)
    assert (row.description, row.agency) == ("", "")
    assert tuple(row.download) == ("e.PDF", "http://h.example/l/e.PDF", "e.PDF", "PDF")


def test_notice_without_link(spark):
    details = task("GET_DETAILS", {"number": "h1", "link": "a.none"})
    row = extract_notices(pages(spark, "<body><h1>1</h1></body>"), [Recipe("r", "utf-8", False, (details,))]).first()
    assert (row.number, row.download) == ("1", None)


def test_paging(spark):
    listing = task("GET_LINKS", {"nextPage": "li:nth-child(2) a", "prevPage": "#gone"})
    row = page_links(pages(spark, HTML), [Recipe("r", "utf-8", False, (listing,))]).first()
    assert (row.next_target, row.has_next, row.prev_target, row.has_prev) == ("t$1", True, None, False)


def test_read_recipes(spark):
    tasks, rejects = read_recipes(spark, "tests/fixtures/recipes")
    assert {r.recipe_id: r.reason for r in rejects.collect()} == {"broken": "unparsable", "empty": "empty"}
    recipes = {r.recipe_id: r for r in load_recipes(tasks)}
    site = recipes["site"]
    assert [t.id for t in site.tasks] == ["GET_SESSION", "GET_LINKS", "GET_DETAILS"]
    assert [s.source for s in site.task("GET_DETAILS").selectors["description"]] == ["h2", "p:nth-child(2)", "h1"]
    forms = [r.request.form for r in tasks.orderBy("task_idx").collect() if r.request and r.request.form]
    assert forms == [{"area": "10", "__EVENTTARGET": "", "from": "$today"}]


@pytest.mark.parametrize("task", ['"selectors":{"link":"a, b"}', '"patterns":{"number":"[^]"}'])
def test_foreign_selectors_and_patterns_are_refused(spark, task):
    bodies = spark.createDataFrame([("x", '{"routine":[{"id":"GET_LINKS",%s}]}' % task)], "recipe_id string, body string")
    with pytest.raises(ValueError):
        load_recipes(parse_recipes(bodies)[0])


def test_decode(spark):
    rows = [
        (1, "São".encode("latin-1"), "ISO-8859-1"), (2, "São".encode(), "utf-8"), (3, "São".encode(), None),
        (4, b"x", "koi8-r"), (5, "“São” €".encode("cp1252"), "windows-1252"), (6, "São".encode(), "UTF8"),
        (7, b"\xef\xbb\xbfa\xffb", "utf-8"), (8, b"a\xe3", "us-ascii"), (9, b"\xd8\x00", "utf-16"),
    ]
    df = spark.createDataFrame(rows, "page_id int, body binary, charset string")
    got = [(r.html, r.entities, r.rejected) for r in decode_pages(df).orderBy("page_id").collect()]
    assert got == [("São", False, False), ("São", False, False), ("São", True, False), (None, False, True), ("“São” €", False, False), ("São", False, False),
        ("a\ufffdb", False, False), ("a\ufffd", False, False), ("Ø", False, False)]


def test_decode_of_wide_characters(spark):
    text = "<p>Edital nº 7 \U0001f600 + 50%</p>"
    rows = [
        ("utf-16le", text.encode("utf-16-le"), text), ("UTF-16", text.encode("utf-16"), text), ("utf-16", text.encode("utf-16-le"), text),
        ("utf-16", b"\xfe\xff" + text.encode("utf-16-be"), text), ("utf-16be", text.encode("utf-16-be"), text),
        ("utf-32", text.encode("utf-32"), text), ("utf-32le", text.encode("utf-32-le"), text), ("UTF-32", text.encode("utf-32-be"), text),
        ("utf-16le", "ab".encode("utf-16-le") + b"\x00", "ab\ufffd"), ("utf-16", b"", ""), ("utf-16", None, None),
    ]
    df = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(rows)], "n int, charset string, body binary")
    got = decode_pages(df).orderBy("n").collect()
    assert [r.html for r in got] == [want for *_, want in rows] and not any(r.rejected for r in got)


def test_projection_names_fields_without_a_link(spark):
    """The number is a column of its own: NULL where the projection does not have it, and without a link."""
    rows = QUERIES["item_projection"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["page_id", "pos", "link", "description", "number"]
    assert rows.filter("number IS NOT NULL").isEmpty()
    assert rows.filter("link IS NULL").count() * 2 == rows.count()


def test_notices_of_one_recipe_are_not_shuffled(spark):
    """Patterns meet the texts where these are read: no exchange by recipe, which would be one task's work."""
    fields = {"container": "body", "number": "h1", "description": "h1"}
    recipes = [
        Recipe(f"r{i}", "utf-8", False, (task("GET_DETAILS", fields, {"agency": rf"{i}([a-z]+)"}),)) for i in range(2)
    ]
    pages = spark.createDataFrame([(1, "http://a/1", "<body><h1>7</h1>0ab 1cd</body>")], "page_id long, url string, html string")
    notices = extract_notices(pages, recipes)
    rows = notices.orderBy("recipe_id").collect()
    assert [(r.recipe_id, r.number, r.agency) for r in rows] == [("r0", "7", "ab"), ("r1", "7", "cd")]
    plan = notices._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
