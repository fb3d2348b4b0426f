"""Pages and recipes to rows. One pass parses each page once and emits small raw rows; all
pattern, trim, hash and type work follows as column expressions.

Pages are ``(page_id, url, html)`` and may carry ``scraper`` (else the recipe is the scraper), and ``recipe_id`` or
``recipe_ids`` (then only that recipe or those apply, else every recipe does). ``html`` is read in the scan's own
partitions, never shuffled; rows leave as they are made, so a batch of large pages is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.notice import item_hash, modality_code, notice_date
from tenderlake.functions.text import (
    JS_SPACES,
    download_info,
    js_trim,
    link_target,
    present,
    reduce_pattern,
)
from tenderlake.operators.dom import Page, Selector
from tenderlake.schemas import ITEM_FIELDS
from tenderlake.sources.recipes import Recipe, Task, pattern_groups

LIST_TASK, DETAIL_TASK = "GET_LINKS", "GET_DETAILS"
ROWS_AT_ONCE = 2_000
PAGE_KEYS = "page_id bigint, url string, scraper string, recipe_id string"

Emit = Callable[[Page, Recipe], Iterator[tuple]]


def _scan(pages: DataFrame, recipes: list[Recipe], emit: Emit, columns: str) -> DataFrame:
    """Run ``emit`` on every page and each recipe that applies to it."""
    names = [c.split()[0] for c in columns.split(",")]
    kinds = [pa.int32() if "int" in c else pa.bool_() if "boolean" in c else pa.string() for c in columns.split(",")]
    keys = ["page_id", "url", "scraper", "recipe_id"]
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("scraper", pa.string()), ("recipe_id", pa.string())]
        + list(zip(names, kinds))
    )
    known = {r.recipe_id: r for r in recipes}  # small and checked when loaded; part of the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns_ = zip(*rows) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns_, schema)], schema=schema
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, scraper, recipe_id, several, html = (batch.column(c)[i].as_py() for c in range(6))
                if several is not None:
                    chosen = filter(None, map(known.get, several))
                else:
                    chosen = known.values() if recipe_id is None else filter(None, [known.get(recipe_id)])
                parsed: dict[bool, Page] = {}
                for recipe in chosen:
                    entities = recipe.charset is None
                    if entities not in parsed:
                        parsed[entities] = Page(html or "", entities)
                    head = (page_id, url, recipe.recipe_id if scraper is None else scraper, recipe.recipe_id)
                    rows.extend(head + row for row in emit(parsed[entities], recipe))
                if len(rows) >= ROWS_AT_ONCE:
                    yield packed()
                    rows.clear()
        yield packed()

    kinds_of = {"scraper": "string", "recipe_id": "string", "recipe_ids": "array<string>"}
    optional = [
        F.col(c) if c in pages.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds_of.items()
    ]
    return pages.select("page_id", "url", *optional, "html").mapInArrow(run, f"{PAGE_KEYS}, {columns}")


def _text(page: Page, roots: list[int], task: Task, name: str) -> str | None:
    """Raw text of a field: the first selector with visible text. NULL when not configured."""
    selectors = task.selectors.get(name, ())
    for selector in selectors:
        text = "".join(page.text(n) for n in page.find(selector, roots))
        if text.strip(JS_SPACES):
            return text
    if selectors:
        return ""
    if name in task.patterns:
        return "".join(page.text(n) for n in roots)
    return None


def _first_href(page: Page, selectors, roots: list[int] | None) -> str | None:
    for selector in selectors:
        found = page.find(selector, roots)
        if found:
            return page.attr(found[0], "href") or None
    return None


def _items(page: Page, task: Task) -> list[int]:
    lists = task.selectors.get("listItem") or task.selectors.get("link")
    if not (task.is_list and lists and "container" in task.selectors):
        return []
    roots = page.find(task.selectors["container"][0])
    return page.find(lists[0], roots)


def _emit_items(page: Page, recipe: Recipe) -> Iterator[tuple]:
    task = recipe.task(LIST_TASK)
    if task is None:
        return
    links = task.selectors.get("link")
    own_link = "listItem" not in task.selectors
    for position, node in enumerate(_items(page, task)):
        if not links:  # nothing identifies the item
            yield (position, None, *(None for _ in ITEM_FIELDS))
            continue
        href = page.attr(node, "href") if own_link else _first_href(page, links, [node])
        # Unlike a page, an item gives no text for a pattern that has no selector.
        texts = (_text(page, [node], task, f) if f in task.selectors else None for f in ITEM_FIELDS)
        yield (position, href or "", *texts)


def _emit_listing(page: Page, recipe: Recipe) -> Iterator[tuple]:
    """The page itself, at position -1 with its link to the next page, and its items."""
    task = recipe.task(LIST_TASK)
    if task is not None:
        target = _first_href(page, task.selectors.get("nextPage", ()), None)
        yield (-1, target, *(None for _ in ITEM_FIELDS))
        yield from _emit_items(page, recipe)


def _emit_notice(page: Page, recipe: Recipe) -> Iterator[tuple]:
    task = recipe.task(DETAIL_TASK)
    if task is None:
        return
    container = task.selectors.get("container")
    roots = page.find(container[0] if container else _BODY)
    texts = [_text(page, roots, task, f) for f in ITEM_FIELDS]
    link_text = href = None
    for selector in task.selectors.get("link", ())[:1]:
        found = page.find(selector)
        link_text = "".join(page.text(n) for n in found)
        href = page.attr(found[0], "href") if found else None
    yield (*texts, link_text, href)


def _emit_page_links(page: Page, recipe: Recipe) -> Iterator[tuple]:
    task = recipe.task(LIST_TASK)
    if task is not None:
        yield tuple(_first_href(page, task.selectors.get(k, ()), None) for k in ("nextPage", "prevPage"))


def _emit_coverage(page: Page, recipe: Recipe) -> Iterator[tuple]:
    """Dry run of both tasks over one page, counted on the spot."""
    listing, detail = recipe.task(LIST_TASK), recipe.task(DETAIL_TASK)
    items = links = fields = 0
    has_next = has_prev = False
    if listing:
        rows = list(_emit_items(page, recipe))
        items, links = len(rows), sum(1 for r in rows if r[1])
        has_next, has_prev = (
            any(page.find(s) for s in listing.selectors.get(k, ())) for k in ("nextPage", "prevPage")
        )
    if detail:
        texts = next(_emit_notice(page, recipe))[: len(ITEM_FIELDS)]
        fields = sum(1 for t in texts if t and t.strip(JS_SPACES))
    yield items, links, fields, has_next, has_prev


def _emit_form(page: Page, recipe: Recipe) -> Iterator[tuple]:
    values = []
    for selector in _FORM_INPUTS:
        found = page.find(selector)
        values.append(page.attr(found[0], "value") if found else None)
    yield tuple(values)


_BODY = Selector("body")
FORM_KEYS = ("__EVENTVALIDATION", "__VIEWSTATEGENERATOR", "__VIEWSTATE")
_FORM_INPUTS = [Selector(f"#{k}") for k in FORM_KEYS]


def _patterned(df: DataFrame, recipes: list[Recipe], task_id: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """Attach each recipe's patterns and give the reduced text of a field.

    The pattern table has one row per recipe, and the scan's tasks hold all recipes, so it is broadcast: texts are not
    shuffled, and the rows of one recipe are not one task's work.
    """
    tasks = {r.recipe_id: r.task(task_id) for r in recipes}
    used = [f for f in ITEM_FIELDS if any(t and f in t.patterns for t in tasks.values())]
    if not used:
        return df, lambda f: js_trim(F.col(f))
    rows = []
    for recipe_id, task in tasks.items():
        given = [task.patterns.get(f) if task else None for f in used]
        rows.append((recipe_id, *given, *(p and pattern_groups(df.sparkSession, p) for p in given)))
    columns = ", ".join([f"_p_{f} string" for f in used] + [f"_g_{f} int" for f in used])
    table = df.sparkSession.createDataFrame(rows, f"recipe_id string, {columns}")
    joined = df.join(F.broadcast(table), "recipe_id", "left")

    def text(name: str) -> Column:
        if name not in used:
            return js_trim(F.col(name))
        return reduce_pattern(F.col(name), F.col(f"_p_{name}"), F.col(f"_g_{name}"))

    return joined, text


def extract_items(pages: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """List items with position, link (postbacks unwrapped), field texts and identity hash."""
    return _listed(pages, recipes, _emit_items)


def extract_listing(pages: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Items as ``extract_items`` gives them, and a row for each listing page at position -1: its link leads to the
    next page. Each page is parsed once for both; a page without items has its own row alone."""
    return _listed(pages, recipes, _emit_listing)


def _listed(pages: DataFrame, recipes: list[Recipe], emit: Emit) -> DataFrame:
    columns = ", ".join(["pos int", "link string"] + [f"{f} string" for f in ITEM_FIELDS])
    raw, text = _patterned(_scan(pages, recipes, emit, columns), recipes, LIST_TASK)
    texts = [text(f).alias(f) for f in ITEM_FIELDS]
    items = raw.select(
        "page_id", "url", "scraper", "recipe_id", "pos", link_target(F.col("link")).alias("link"), *texts
    )
    return items.withColumn("_hash", item_hash(*(F.col(c) for c in ("number", "agency", "modality", "link"))))


def item_fields(items: DataFrame, configured: list[str]) -> DataFrame:
    """Minimum content: only configured fields; without a link selector everything is NULL."""
    keys = [c for c in ("page_id", "url", "scraper", "recipe_id", "pos") if c in items.columns]
    linked = "link" in configured
    kept = [
        (F.col(c) if linked else F.lit(None).cast("string").alias(c))
        for c in (*ITEM_FIELDS, "link")
        if c in configured or c == "link"
    ]
    return items.select(*keys, *kept)


def extract_notices(pages: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Typed notice fields of detail pages."""
    columns = ", ".join(f"{f} string" for f in (*ITEM_FIELDS, "link_text", "link_href"))
    raw, text = _patterned(_scan(pages, recipes, _emit_notice, columns), recipes, DETAIL_TASK)

    def given(name: str) -> Column:
        return F.nullif(text(name), F.lit(""))

    return raw.select(
        "page_id",
        "url",
        "scraper",
        "recipe_id",
        F.coalesce(text("description"), F.lit("")).alias("description"),
        modality_code(given("modality")).alias("modality"),
        F.coalesce(text("agency"), F.lit("")).alias("agency"),
        F.coalesce(text("number"), F.lit("")).alias("number"),
        notice_date(given("openDate")).alias("openDate"),
        notice_date(given("publishDate")).alias("publishDate"),
        download_info(F.col("link_text"), F.col("link_href"), F.col("url")).alias("download"),
    )


def page_links(pages: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Next and previous page target of each listing page; NULL where there is none."""
    raw = _scan(pages, recipes, _emit_page_links, "next_target string, prev_target string")
    for name in ("next", "prev"):
        raw = raw.withColumn(f"{name}_target", link_target(F.col(f"{name}_target")))
        raw = raw.withColumn(f"has_{name}", F.col(f"{name}_target").isNotNull())
    return raw


def recipe_coverage(pages: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Per recipe and page: items, links, non-empty notice fields, and paging links found."""
    return _scan(
        pages,
        recipes,
        _emit_coverage,
        "n_items int, n_links int, n_fields int, has_next boolean, has_prev boolean",
    )


def form_state(pages: DataFrame, recipes: list[Recipe], event_target: Column | None = None) -> DataFrame:
    """Hidden form state of each page as a map; the event target is a key only when given."""
    raw = _scan(pages, recipes, _emit_form, ", ".join(f"{k} string" for k in FORM_KEYS))
    base = F.create_map(
        F.lit("__EVENTARGUMENT"), F.lit(""), *(x for k in FORM_KEYS for x in (F.lit(k), F.col(k)))
    )
    form = base
    if event_target is not None:
        full = F.map_concat(base, F.create_map(F.lit("__EVENTTARGET"), event_target))
        form = F.when(present(event_target), full).otherwise(base)
    return raw.select("page_id", "url", "scraper", "recipe_id", form.alias("form"))
