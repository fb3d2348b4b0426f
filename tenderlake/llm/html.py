"""Main text of web pages: the contiguous region whose words outweigh its tags.

A page is read as a line of words and tags. A word scores by where it stands: the lowest weight among the
elements around it (by name, class, id and role), which is positive for article text and negative for menus,
footers or adverts. A tag costs a little. The region of the highest sum, found by one linear scan, is the
main text; runs of negative words inside it (an advert within the article) are left out.

Weights are log-odds learned from labelled pages: those that mark their article themselves with an
``article`` or ``main`` element. A word outside the article counts against the structural elements around it
if there are any, and only otherwise against plain ones such as lists and links, so that a list is not
blamed for standing in a menu. Prior counts for common names stand in for what the pages do not show, and
serve alone where no page is labelled. Fitting takes about ``SAMPLE`` labelled pages; extraction reads
every page whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from tenderlake.llm.common import add_columns, sampled, slices

SAMPLE = 2000
FEATURES = 5000
# Tags up to this length are read by one pattern, longer ones by a scan that gives the same.
SHORT_TAG = 512
CLIP = 3.0
TAG_COST = 0.05
UNKNOWN = 0.5
LABEL = ("article", "main")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code del em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr br img".split())  # noqa: E501
RAW = frozenset("script style noscript template textarea title iframe svg head select object".split())
GOOD = frozenset("article main p h1 h2 h3 blockquote pre article-body post-content entry-content".split())
BAD = frozenset(
    "nav footer header aside form menu button dialog navigation banner contentinfo complementary search "
    "ad ads advert advertisement sponsor sponsored promo sidebar comment comments reply replies notice notices "
    "cookie cookies consent banner breadcrumb breadcrumbs share social related newsletter subscribe popup modal "
    "pagination pager toolbar widget".split()
)
STRUCTURAL = frozenset("nav footer header aside form menu button dialog".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
SPECIAL = re.compile("[\"'>]")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


class TagEnds:
    """Where tags of a page end, of any length: the first ``>`` outside quotes.

    Quotes from which no end is reached are remembered, so each is passed once however many tags fail.
    """

    def __init__(self, page: str):
        self.page = page
        self.last: dict[str, int] = {}
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes start at ``at``; -1 if none does."""
        page, passed = self.page, []
        while found := SPECIAL.search(page, at):
            here, sign = found.start(), found[0]
            if sign == ">":
                return here
            if sign not in self.last:
                self.last[sign] = page.rfind(sign)
            passed.append(here)
            if here in self.dead or here == self.last[sign]:
                break
            at = page.find(sign, here + 1) + 1
        self.dead.update(passed)
        return -1

    def tag(self, start: int) -> tuple[str, str, str, int] | None:
        """("/" or "", name, attributes, end) of the tag at ``start``. The name is the longest that leaves an
        end: one with quotes in it may have to stop before a quote."""
        found = TAG_NAME.match(self.page, start)
        if not found:
            return None
        first = found.start(2)
        stops = [m.start() for m in SPECIAL.finditer(self.page, first + 1, found.end())]
        for stop in [found.end(), *reversed(stops)]:
            if (end := self.end(stop)) >= 0:
                return found[1], self.page[first:stop], self.page[stop:end], end + 1
        return None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """The page's pieces in order: ("text", raw, ""), ("open", name, attributes) or ("close", name, "").

    Comments, declarations and the contents of scripts, styles and the like are left out. A sign that opens
    no tag is text. Runs in linear time, however broken the page.
    """
    at, size = 0, len(page)
    ends = TagEnds(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        found = TAG.match(page, start, start + SHORT_TAG)
        tag = (*found.groups(), found.end()) if found else ends.tag(start)
        if not tag:
            end = page.find(">", start) if re.match(r"</?[a-zA-Z]", page[start : start + 3]) else start
            if end < 0:  # a tag cut off at the end of the page
                return
            if end == start:
                yield "text", "<", ""
            at = end + 1
            continue
        slash, name, attributes, at = tag
        name = name.lower()
        if slash:
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in RAW and name != "head" and not attributes.endswith("/"):
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = end.start() if end else size


class Place:
    """Open elements around the current point: name, features, and the weight of a word inside."""

    def __init__(self, weights: Weights | None = None):
        self.weights = weights
        self.stack: list[tuple[str, frozenset[str], float]] = []
        self.open: dict[str, int] = defaultdict(int)

    def push(self, name: str, attributes: str) -> None:
        if name in VOID:
            return
        if name not in INLINE and self.stack and self.stack[-1][0] == "p":
            self.pop("p")
        if name in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1][0] == name:
            self.pop(name)
        features = {name}
        for values in NAMES.findall(attributes) if attributes else ():
            for word in re.split(r"[\s_]+", " ".join(values).lower()):
                if word:
                    features |= {f".{word}"} | {f".{part}" for part in word.split("-") if part in BAD}
        weight = self.weights.inside(features, self.weight) if self.weights else 0.0
        self.stack.append((name, frozenset(features), weight))
        self.open[name] += 1

    def pop(self, name: str) -> None:
        if not self.open[name]:
            return
        while self.stack:
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == name:
                return

    def foreign(self) -> list[str]:
        """Features of the elements inside the article whose name or class tells that they are no part of it."""
        out, within = [], False
        for name, own, _ in self.stack:
            if within and any(f in STRUCTURAL or f.lstrip(".") in BAD for f in own):
                out += [f for f in own if f in STRUCTURAL or f[0] == "."]
            within = within or name in LABEL
        return out

    @property
    def weight(self) -> float:
        return self.stack[-1][2] if self.stack else 0.0


class Weights:
    """Log-odds of features, from counts of words (inside, outside) the article plus prior counts."""

    def __init__(self, counts: dict[str, tuple[float, float]] | None = None):
        self.counts = counts or {}
        self.known: dict[str, float] = {}

    def of(self, feature: str) -> float:
        if feature not in self.known:
            inside, outside = self.counts.get(feature, (0, 0))
            bare = feature.lstrip(".")
            inside += 20 if bare in GOOD else 1
            outside += 200 if bare in BAD else 1
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[feature] = max(-CLIP, min(CLIP, math.log(inside / outside)))
        return self.known[feature]

    def inside(self, features: set[str], around: float) -> float:
        """Weight of a word in an element: the lowest of its features and of what is around it, if that is
        negative. Features that no page has shown say nothing."""
        told = [w for f in features if (w := self.of(f))]
        if not told:
            return around
        return min(told) if around >= 0 else min(around, *told)


def extract(page: str | None, weights: Weights) -> str:
    """Blocks of the best region of a page, one per line."""
    place = Place(weights)
    blocks: list[tuple[int, str, float]] = []
    number = start = 0
    total = best = 0.0
    region = (0, 0)
    for kind, value, attributes in tokens(page or ""):
        if kind == "text":
            blocks.append((number, value, place.weight))
            total += len(value.split()) * (place.weight or UNKNOWN)
        else:
            (place.push if kind == "open" else place.pop)(value, *([attributes] if kind == "open" else []))
            if value == "br":
                blocks.append((number, " ", place.weight))
            elif value not in INLINE:
                number += 1
            total -= TAG_COST
        if total > best:
            best, region = total, (start, len(blocks))
        elif total <= 0:
            total, start = 0.0, len(blocks)
    lines: dict[int, list[str]] = {}
    for block, raw, weight in blocks[region[0] : region[1]]:
        if weight >= 0:
            lines.setdefault(block, []).append(raw)
    texts = (SPACE.sub(" ", entities.unescape("".join(parts))).strip() for parts in lines.values())
    return "\n".join(text for text in texts if text)


def fit(pages: DataFrame, *, html: str = "html", sample: int = SAMPLE) -> Weights:
    """Learn weights from about ``sample`` pages that mark their own article, taken by hash of the page."""
    marked = pages.where(F.col(html).rlike(r"(?i)<(?:article|main)[\s>]")).select(F.col(html).alias("html"))
    chosen = sampled(marked, F.col("html"), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in slices(batches, 0):
            for page in batch.column(0).to_pylist():
                place = Place()
                for kind, value, attributes in tokens(page):
                    if kind == "open":
                        place.push(value, attributes)
                    elif kind == "close":
                        place.pop(value)
                    elif words := len(value.split()):
                        inside = any(place.open[name] for name in LABEL)
                        features = [f for _, own, _ in place.stack for f in own]
                        # What is no main text by its name stays that within an article: comments, adverts, notices.
                        foreign = place.foreign() if inside else []
                        if foreign:
                            inside, features = False, foreign
                        elif not inside:
                            told = [f for f in features if f in STRUCTURAL or f[0] == "."]
                            features = told or [f for f in features if f not in ("html", "body")]
                        for f in set(features):
                            sums[f][not inside] += words
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string())] + [pa.array([sums[n][i] for n in names], pa.int64()) for i in (0, 1)],
            names=["feature", "inside", "outside"],
        )

    rows = (
        chosen.mapInArrow(count, "feature string, inside long, outside long")
        .groupBy("feature")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "feature")
        .limit(FEATURES)
        .collect()
    )
    return Weights({r["feature"]: (r["inside"], r["outside"]) for r in rows})


def main_text(
    pages: DataFrame, weights: Weights | None = None, *, html: str = "html", text: str = "text"
) -> DataFrame:
    """Add ``text``, the main text of each page, and ``n_chars``, its code points.

    NULL and empty pages, and pages without any word that scores, give the empty text. Repeated rows give
    equal texts; an empty table stays empty; existing columns of the new names are replaced.
    """
    weights = weights or fit(pages, html=html)

    def prepare():
        def work(rows: list) -> list[list]:
            texts = [extract(page, weights) for page in rows]
            return [texts, [len(t) for t in texts]]

        return work

    return add_columns(pages, html, [StructField(text, StringType()), StructField("n_chars", LongType())], prepare)
