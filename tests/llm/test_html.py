"""Main text of pages."""

import html as entities
import random
import re
import time

from tenderlake.llm import html

PAGE = (
    "<body><nav><ul><li><a href=/x>Home page</a></li></ul></nav><div class='sidebar'><p>links here</p></div>"
    "<main><h1>Title &amp; x</h1><p>Some  good\ntext</p><ul><li>one two three</li></ul>"
    "<script>var p = '</p>';</script><aside>ignore me</aside><form><p>your name</p></form><!-- no <p>no</p> -->"
    "<p>More of the article's<br>words follow here</p></main><div id=comments><p>nice post dude</p></div><footer>&copy; all</footer>"
)


def test_one_page():
    assert html.extract(PAGE, html.Weights()) == "Title & x\nSome good text\none two three\nMore of the article's words follow here"


def test_broken_pages():
    w = html.Weights()
    assert html.extract(None, w) == html.extract("", w) == html.extract("<nav>a b c</nav>", w) == ""
    assert html.extract("<p>a < b &lt;c</p><p", w) == "a < b <c"
    assert html.extract("<div>" * 30_000 + "hi there you", w) == "hi there you"
    assert html.extract("<p>word word <a b='", w) == "word word"
    assert html.extract("<script>" * 2000 + "x", w) == ""
    assert html.extract("<p>" + "long " * 200_000 + "</p>", w) == ("long " * 200_000).strip()


def test_tags_of_any_length_are_read():
    w, long = html.Weights(), "a > b " * 50_000
    assert html.extract(f"<p>one two</p><script data-x='{long}'>var code = here;</script><p>three</p>", w) == "one two\nthree"
    page = f"<div class=sidebar><div data-page='{long}'>menu words</div>more menu</div><p>one two three</p>"
    assert html.extract(page, w) == "one two three"
    assert list(html.tokens(f'<DIV a="{long}" b>'))[0] == ("open", "div", f' a="{long}" b')


PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")


def test_scan_equals_the_pattern():
    draw = random.Random(5)
    for _ in range(20_000):
        page = "<" + "".join(draw.choice("ab\"'> /<") for _ in range(draw.randint(1, 14)))
        ends = html.TagEnds(page)
        for start in range(len(page)):  # in order, as pages are read: what is remembered must not mislead
            want = PLAIN.match(page, start)
            assert ends.tag(start) == (want and (*want.groups(), want.end()))


def test_broken_tags_take_linear_time():
    begun = time.process_time()
    for part, end in (("<a '>'", '"'), ("<a '>\"'", ""), ("<a ", "'>"), ("<a\"'", ">"), ("<a'>\"", "'"), ("<a b=\"'\">", "'")):
        list(html.tokens(part * 100_000 + end))
    list(html.tokens("<" + "a" * 600_000))
    assert time.process_time() - begun < 60


def test_table_with_odd_rows(spark):
    rows = [(1, "u", PAGE, "old"), (2, None, None, None), (1, "u", PAGE, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(html.main_text(df).collect(), key=lambda r: r["page_id"])
    assert [r["n_chars"] for r in out] == [len(out[0]["text"])] * 2 + [0]
    assert out[2]["text"] == ""
    assert html.main_text(df.limit(0)).collect() == []


def marked_article(page):
    inner = page[page.index("<article>") + 9 :].split("</article>")[0]
    blocks = [re.sub("</?b>", "", re.sub("<br>", " ", b)) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", entities.unescape(b)).strip()))


def test_query_equals_the_marked_articles(spark):
    from tenderlake.llm.queries import op8_html

    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op8_html(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == marked_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_comments_inside_an_article_stay_out(spark):
    draw = random.Random(8)
    say = lambda n: " ".join(draw.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(n))
    pages, want = [], []
    for i in range(60):
        body, extra = say(draw.randint(30, 60)), say(draw.randint(60, 120))
        pages.append((i, f"<nav>{say(5)}</nav><article><p>{body}</p><div class='comments'><p>{extra}</p></div></article><footer>x</footer>"))
        want.append(body)
    df = spark.createDataFrame(pages, "page_id long, html string")
    rows = sorted(html.main_text(df).collect(), key=lambda r: r["page_id"])
    assert [r["text"] for r in rows] == want


def test_pages_that_do_not_mark_their_article(spark):
    """Weights learned from marked pages serve others whose article is a plain element, and that fit never saw."""
    folder = "/root/testdata/sf0.01"
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    marked = spark.createDataFrame([p for p in pages if p[0] % 2], "page_id long, html string")
    weights = html.fit(marked)
    others = [h for i, h in pages if i % 2 == 0]
    right = sum(html.extract(re.sub("(</?)article>", r"\1div>", h), weights) == marked_article(h) for h in others)
    assert right >= 0.95 * len(others)
