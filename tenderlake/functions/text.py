"""Column functions over extracted text and links. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript counts as white space or line end.
_WIDE_SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
JS_SPACES = "\t\n\x0b\x0c\r " + _WIDE_SPACES
# The ASCII ones as a class. A class with wide characters is several times slower on every character.
_SPACE = r"[\t-\r ]"

# Characters a link may not hold as such, with their escapes.
LINK_ESCAPES = {
    " ": "%20", '"': "%22", "'": "%27", "<": "%3C", ">": "%3E", "\\": "%5C", "^": "%5E",
    "`": "%60", "{": "%7B", "|": "%7C", "}": "%7D", "\t": "%09", "\n": "%0A", "\r": "%0D",
}

# Endings that mark a link or its text as a file.
FILE_ENDINGS = "pdf doc docx zip rar odt 7z".split()


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(JS_SPACES))


def present(col: Column) -> Column:
    """True where a text counts as given: neither NULL nor empty."""
    return F.coalesce(col != "", F.lit(False))


def once(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a costly column that it names several times, evaluated once per row."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


# A run of white space that stands for one blank and is not one already: it is led by no line end, or is
# a line end alone. Single blanks, by far the most, are passed over.
_BLANK_RUN = (
    rf"(?={_SPACE})(?<!{_SPACE})(?:[\t\x0B\f]{_SPACE}*+| {_SPACE}++|(?>\r\n|[\r\n])(?!{_SPACE}))"
)


def squeeze(col: Column) -> Column:
    """White space reduced: a run led by a line end becomes a line end, any other run one blank."""
    narrow = F.translate(col, _WIDE_SPACES, " " * len(_WIDE_SPACES))
    narrow = F.when(F.length(col) == F.octet_length(col), col).otherwise(narrow)
    return F.regexp_replace(F.regexp_replace(narrow, _BLANK_RUN, " "), rf"{_SPACE}{{2,}}", "\n")


def reduce_pattern(col: Column, pattern: Column, group: Column) -> Column:
    """The last capture group of ``pattern`` in the squeezed text; a miss keeps the trimmed input.

    ``pattern`` and ``group`` may vary by row. A NULL pattern keeps the trimmed input as well.
    """
    text = js_trim(col)

    def reduced(flat: Column) -> Column:
        hit = F.call_function("rlike", flat, pattern)
        return F.when(hit, js_trim(F.call_function("regexp_extract", flat, pattern, group))).otherwise(text)

    return F.when(pattern.isNotNull(), once(squeeze(text), reduced)).otherwise(text)


def link_target(href: Column) -> Column:
    """The href itself, or the event target inside a postback call."""
    target = F.regexp_extract(href, "'([^']*)'", 1)
    return F.when(F.instr(href, "__doPostBack") > 0, target).otherwise(href)


def js_function_name(href: Column) -> Column:
    """Name of the function a ``javascript:`` link calls; NULL for other links."""
    name = F.translate(F.regexp_extract(href, r"^[^:(]*:([^(]*)", 1), ");:", "")
    return F.when(F.lower(href).startswith("javascript"), name)


def is_uri(col: Column) -> Column:
    # Whatever may follow the host is optional, so the test ends there.
    absolute = col.rlike(r"://[\w-]+\.[\w-]")
    local = col.startswith("../") | col.startswith("/") | col.startswith("?")
    return F.coalesce(absolute | local, F.lit(False))


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` steps. The array work runs only where the path holds one."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        F.slice(steps, F.lit(2), F.size(steps)),
        F.lit([]).cast("array<string>"),
        lambda acc, step: F.when(
            step == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).when(step == ".", acc).otherwise(F.concat(acc, F.array(step))),
    )
    ends_in_dots = F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_in_dots, "/").otherwise(""))
    return F.when(path.contains("/."), joined).otherwise(path)


def _escaped(url: Column, link: Column) -> Column:
    """Escape what an address may not hold; links of schemes without ``//`` stay as they are."""
    escaped = url
    for char, escape in LINK_ESCAPES.items():
        escaped = F.replace(escaped, F.lit(char), F.lit(escape))
    unsafe = url.rlike(r"""[\s"'<>\\^`{|}]""")
    return F.when(unsafe & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)"), escaped).otherwise(url)


def _cleaned(link: Column) -> Column:
    """A link without white space around it, with backslashes before the query read as slashes."""
    link = js_trim(link)
    path = F.replace(F.regexp_extract(link, r"(?s)^([^?]*)", 1), F.lit("\\"), F.lit("/"))
    slashed = F.concat(path, F.regexp_extract(link, r"(?s)^[^?]*(.*)", 1))
    return F.when(link.contains("\\"), slashed).otherwise(link)


def _absolute(url: Column) -> Column:
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, r"(?s)^[^?#]*(.*)", 1)
    rest = F.when(rest == "", "/").otherwise(rest)
    return F.concat(F.lower(head), _without_dots(rest), tail)


def _site(base: Column) -> Column:
    return F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def _joined(base: Column, link: Column) -> Column:
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1))
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    site = _site(base)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    link_path = F.regexp_extract(link, r"^([^?#]*)", 1)
    link_tail = F.regexp_extract(link, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), _absolute(link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), _absolute(F.concat(scheme, link)))
        .when(link.startswith("/"), F.concat(site, _without_dots(link_path), link_tail))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(link.startswith("#"), F.concat(site, path, query, link))
        .when(link == "", F.concat(site, path, query))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, link_path)), link_tail))
    )


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` seen from the page at ``base``.

    Most links are paths from the root that need no work; the full rules run for the others only.
    """
    plain = link.rlike(r"^/(?!/)[!#-&(-;=?-\[\]_a-z~\u00A1-\u167F]*\z") & ~link.contains("/.")
    worked = once(_cleaned(link), lambda clean: once(_joined(base, clean), lambda url: _escaped(url, clean)))
    return F.when(plain, F.concat(_site(base), link)).otherwise(worked)


def path_name(col: Column, include_ext: bool) -> Column:
    """File name of a path; without a slash (or, lacking the extension, without a dot) empty."""
    if include_ext:
        return F.regexp_extract(col, r"(?s)^.*/(.*)\z", 1)
    return F.regexp_extract(col, r"(?s)^.*/([^/]*)\.[^./]*\z", 1)


def download_info(text: Column, href: Column, page_url: Column) -> Column:
    """Struct of relative address, absolute address, file name and format; NULL without a href."""
    text = js_trim(text)
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    ending = r"(?i)\.(" + "|".join(FILE_ENDINGS) + r")\z"
    by_text, by_href = text.rlike(ending), href.rlike(ending)
    name = F.when(by_text, text).when(by_href, F.substring_index(href, "/", -1))
    file_format = F.when(by_text, F.substring_index(text, ".", -1)).when(
        by_href, F.substring_index(href, ".", -1)
    )
    return F.when(
        href.isNotNull(),
        F.struct(
            href.alias("relativeUri"),
            resolve_url(page_url, href).alias("uri"),
            name.alias("fileName"),
            file_format.alias("fileFormat"),
        ),
    )
