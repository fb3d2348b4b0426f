"""Literal input to literal output, one table per rule."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from tenderlake.functions import cron, notice, text
from tenderlake.operators import requests, schedules


def apply(spark, function, inputs, schema="a string"):
    width = len(schema.split(","))
    rows = [(i, *(v if width > 1 else (v,))) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(function(*[F.col(c) for c in df.columns[1:]])).collect()]


def check(spark, function, cases, schema="a string"):
    got = apply(spark, function, [c for c, _ in cases], schema)
    assert dict(zip(map(str, (c for c, _ in cases)), got)) == {str(c): e for c, e in cases}


def test_js_trim(spark):
    check(spark, text.js_trim, [("\u00a0 a b\ufeff\n", "a b"), ("\u2003", ""), ("x", "x"), (None, None)])


# Literal reading of the rule: each line end or run is one blank, then doubled ones are a line end.
_WS = "[" + re.escape(text.JS_SPACES) + "]"


def _two_steps(value):
    return re.sub(f"{_WS}{{2,}}", "\n", re.sub(rf"\r\n|\n|\r|{_WS}+", " ", value))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\t\u00a0\u3000é", max_size=12), min_size=300, max_size=300))
def test_squeeze_equals_two_steps(spark, values):
    assert apply(spark, text.squeeze, values) == [_two_steps(v) for v in values]


def test_reduce_pattern(spark):
    cases = [
        (("file no. 12-b, room 4", r"(?:no\.|nr) ?([0-9]+-[a-z])", 1), "12-b"),
        (("buyer city: ROME and more", r"(?:buyer|owner) (?:city|town): ([A-Z]+)", 1), "ROME"),
        (("abertura 03/03/2017 10h", r"\d{2}/\d{2}/\d{4}", 0), "03/03/2017"),
        ((" a\n   b ", "a\nb", 0), "a\nb"),
        ((" a \n b ", "a b", 0), "a b"),
        ((" no\n\n match ", "xyz", 0), "no\n\n match"),
        (("ab", "a(x)?", 1), ""),
        (("  kept ", None, None), "kept"),
    ]
    check(spark, text.reduce_pattern, cases, "a string, p string, g int")


def test_link_target(spark):
    cases = [
        ("/a/b", "/a/b"),
        ("javascript:__doPostBack('ctl00$x','')", "ctl00$x"),
        ("javascript:__doPostBack('open", ""),
        ("__doPostBack()", ""),
        (None, None),
    ]
    check(spark, text.link_target, cases)


def test_js_function_name(spark):
    cases = [
        ("javascript:baixar('1')", "baixar"),
        ("JAVASCRIPT:a;b:c(1)", "abc"),
        ("javascript(x):b", ""),
        ("javascript:plain;", "plain"),
        ("/a.pdf", None),
    ]
    check(spark, text.js_function_name, cases)


def test_is_uri(spark):
    cases = [
        ("/a", True), ("../a", True), ("?a", True), ("a.html", False), ("#a", False), ("http://a.b/c", True),
        ("://a.b", True), ("http://localhost", False), ("x https://a-b.c", True), ("./a", False), (None, False),
    ]
    check(spark, text.is_uri, cases)


def test_resolve_url(spark):
    base = "http://A.example/b/c/d.html?q=1#f"
    links = [
        ("https://Other.example/x", "https://other.example/x"),
        ("https://other.example", "https://other.example/"),
        ("//cdn.example/x", "http://cdn.example/x"),
        ("/root/./x/../y?z=/../1", "http://a.example/root/y?z=/../1"),
        ("?p=2", "http://a.example/b/c/d.html?p=2"),
        ("#top", "http://a.example/b/c/d.html?q=1#top"),
        ("e.html", "http://a.example/b/c/e.html"),
        ("../e.html", "http://a.example/b/e.html"),
        ("../../../../e", "http://a.example/e"),
        ("..", "http://a.example/b/"),
        (".", "http://a.example/b/c/"),
        ("", "http://a.example/b/c/d.html?q=1"),
        ("my file's.pdf", "http://a.example/b/c/my%20file%27s.pdf"),
        ("javascript:f('a b')", "javascript:f('a b')"),
        (" \n/x ", "http://a.example/x"),
        ("docs\\a.pdf?f=\\b", "http://a.example/b/c/docs/a.pdf?f=%5Cb"),
        ("/a?b=1\n2#c", "http://a.example/a?b=1%0A2#c"),
        (None, None),
    ]
    check(spark, text.resolve_url, [((base, link), want) for link, want in links], "b string, l string")
    check(spark, text.resolve_url, [(("http://h.example", "x"), "http://h.example/x")], "b string, l string")


def test_path_name(spark):
    check(spark, lambda c: text.path_name(c, True), [("a/b.c.d", "b.c.d"), ("a", ""), ("a/", ""), ("/x", "x")])
    check(spark, lambda c: text.path_name(c, False), [("a/b.c.d", "b.c"), ("a.b", ""), ("a.b/c", ""), ("/x.y", "x")])


def test_download_info(spark):
    def name(t, h):
        d = text.download_info(t, h, F.lit("http://h.example/p/"))
        return F.concat_ws("|", d.relativeUri, d.uri, d.fileName, d.fileFormat)

    site = "http://h.example"
    cases = [((" Edital.PDF\n", "/x?a=1&amp;b"), f"/x?a=1&b|{site}/x?a=1&b|Edital.PDF|PDF")]
    for ending in text.FILE_ENDINGS:
        cases.append((("abrir", f"/d/e.{ending}"), f"/d/e.{ending}|{site}/d/e.{ending}|e.{ending}|{ending}"))
    cases.append((("abrir", "/d/e.odp"), f"/d/e.odp|{site}/d/e.odp"))
    cases.append((("a.pdf x", "f.zip"), f"f.zip|{site}/p/f.zip|f.zip|zip"))
    cases.append((("a.pdf", None), ""))
    check(spark, name, cases, "t string, h string")


def test_modality_code(spark):
    cases = [(k.upper(), v) for k, v in notice.MODALITIES.items()]
    check(spark, notice.modality_code, cases + [("pregao presencial", None), ("", None), (None, None)])


def test_notice_date(spark):
    def day(c):
        return F.date_format(notice.notice_date(c), "yyyy-MM-dd HH:mm")

    cases = [
        ("03/02/2017", "2017-02-03 03:00"), ("3-2-2017", "2017-02-03 03:00"), ("32/01/2016", None),
        ("31/02/2016", None), ("01/13/2016", None), ("01/02", None), ("1/2/17", None), ("1/2/2017/3", None),
        ("2017", None), ("", None), ("1-2/3-4", None), ("29/02/2016", "2016-02-29 03:00"), ("a/b/2017", None),
    ]
    check(spark, day, cases)


def test_item_hash(spark):
    def md5(value):
        import hashlib

        return hashlib.md5(value.encode()).hexdigest()

    cases = [
        (("1", "23", "pp", "/l"), md5("123pp")),
        (("12", "3", "pp", None), md5("123pp")),
        (("1", "", "pp", "/l"), md5("/l")),
        ((None, None, None, "/ção"), md5("/ção")),
        (("1", "2", None, ""), ""),
    ]
    check(spark, notice.item_hash, cases, "n string, a string, m string, l string")


SPECIALS = [
    ("seconds", "*", True), ("minutes", ",", True), ("hours", "-", True), ("dom", "?", True), ("dom", "L", True),
    ("dom", "W", True), ("dow", "#", True), ("dow", "L", True), ("seconds", "?", False), ("minutes", "L", False),
    ("hours", "W", False), ("dom", "#", False), ("dom", "LW", False),
]


@pytest.mark.parametrize("field,char,allowed", SPECIALS)
def test_cron_specials(spark, field, char, allowed):
    assert apply(spark, lambda c: cron.special_allowed(field, c), [char]) == [allowed]


def test_cron_valid(spark):
    cases = [
        ("* 30 11 * * 1-5", True), ("0 10,44 14 ? 3 WED", True), ("0 15 10 ? * MON-FRI", True), ("", False),
        (None, False), ("one two", True), ("1 2 3 4 5 6 7 8", True), ("60 5 * * 1", False), ("59 5 * * 1", True),
        ("5 24 * * 1", False), ("5 5 0 * *", False), ("5 5 32 * *", False), ("*/5 0 * XYZ 1", False),
        ("*/5 0 * xyz/2 1", True), ("/ 0 * * *", False), ("5 5 * JAN-mar sun", True), ("5 5 * sun *", False),
        ("5  * * 1", True), ("5 5  * 1", False), ("5-99 5 * * *", False), ("99-5 5 * * *", True), ("-5 5 * * *", True),
        ("5 5 - * *", True), ("5 5 1,,2 * *", False), ("1,,2 5 * * *", True), ("0 5 5 * * * 1969", False),
        ("0 5 5 * * * 2099", True), ("0 5 5 * * * 1969-2099", False), ("0 5 5 * * * 2000-2100", False),
        ("007 5 * * *", True), ("5 5 * * 1-2-x", True), ("5 5 * * x-2", False), ("a 5 * * *", False),
    ]
    check(spark, cron.cron_valid, cases)


def test_cron_fields(spark):
    def fields(c):
        return F.array(*cron.cron_fields(c).values())

    cases = [
        ("* 30 11 * * 1-5", ["*", "*", "30", "11", "*", "*", "1-5"]),
        ("5 6 7 8 1", ["0", "5", "6", "7", "8", "1", None]),
        ("1 2 3 4 5 6 2000", ["1", "2", "3", "4", "5", "6", "2000"]),
        ("1 2 3 4 5 6 7 8", ["1", "0", "0", "0", "0", "0", "0"]),
        ("99 6 7 8 1", ["0"] * 7),
        ("not cron", ["0"] * 7),
    ]
    check(spark, fields, cases)


def test_make_schedules(spark):
    rows = [("s1", "5 6 * * 1", "weekly"), ("s2", "* 6 * * MON", "daily"), ("s3", "99 6 * * 1", "daily"), ("s4", "5 6 * * 1", None)]
    made, refused = schedules.make_schedules(spark.createDataFrame(rows, "scraper string, cron string, frequency string"))
    assert sorted(map(tuple, made.select("scraper", "weekday", "hours", "minutes", "minute_of_day").collect())) == [
        ("s1", 1, 6, 5, 365), ("s2", None, 6, None, None),
    ]
    assert {r.scraper for r in refused.collect()} == {"s3", "s4"}


def test_expand_value(spark):
    def fill(v, last):
        return requests.expand_value(v, last.cast("timestamp_ntz"), F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))

    cases = [
        (("$today", None), "01/01/2024"), (("$nextYear", None), "31/12/2024"), (("$lastRunDate", "2023-05-06"), "06/05/2023"),
        (("$lastRunDate", None), "01/01/2024"), (("$other", None), "$other"), (("today", None), "today"), ((None, None), None),
    ]
    check(spark, fill, cases, "v string, l string")


def test_request_delay(spark):
    def delay(d, r):
        return requests.request_delay(d, r, F.lit(0.5))

    cases = [
        (("2000", True), 1500), (("5000", False), 1000), (("soon", True), 1000), ((None, True), 1000), (("999", True), None),
        (("0", True), 1000),
    ]
    check(spark, delay, cases, "d string, r boolean")
