"""The per-page helper of the scan: a forgiving element tree and the selector subset recipes use.

Selectors: tag, ``#id``, ``.class``, ``[attr]``, ``[attr='v']``, ``:nth-child(n)``, descendant and
``>``. Anything else is refused when the recipe is loaded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

# Elements without content, and open elements a new sibling closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": {"p"},
    "li": {"li"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"tr", "td", "th"},
    "option": {"option"},
}
RAW_TEXT = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Page:
    """Elements in document order, each with its text span and the end of its subtree.

    Building and finding stay near linear in the page, however deep or broken its markup.
    """

    def __init__(self, html: str, entities: bool = False):
        self.entities = entities
        self.tags, self.parents, self.nth, self.ends = [], [], [], []
        self._raw_attrs, self._attrs = [], {}
        self._spans, self._texts = [], []
        self._by_tag: dict[str, list[int]] = {}
        self._found: dict[str, list[int]] = {}
        self._build(html)

    def _build(self, html: str) -> None:
        stack, open_tags, children = [], {}, [0]  # children[0] counts the roots

        def close() -> str:
            node = stack.pop()
            self.ends[node] = len(self.tags)
            self._spans[node][1] = len(self._texts)
            open_tags[self.tags[node]] -= 1
            return self.tags[node]

        position, last = 0, html.rfind(">") + 1
        while True:
            token = _TOKEN.search(html, position, last)
            end = token.start() if token else len(html)
            if end > position:
                self._texts.append(html[position:end])
            if not token:
                break
            position = token.end()
            tag = token["tag"]
            if tag is None:
                if token[0].startswith("<!--") and not token[0].endswith("-->"):
                    break  # a comment without an end hides the rest
                continue
            tag = tag.lower()
            if token["close"]:
                if open_tags.get(tag):
                    while close() != tag:
                        pass
                continue
            implied = CLOSES.get(tag, ())
            while stack and self.tags[stack[-1]] in implied:
                close()
            parent = stack[-1] if stack else -1
            node = len(self.tags)
            children[parent + 1] += 1
            children.append(0)
            self.tags.append(tag)
            self.parents.append(parent)
            self.nth.append(children[parent + 1])
            self.ends.append(node + 1)
            self._raw_attrs.append(token["attrs"])
            self._spans.append([len(self._texts), len(self._texts)])
            self._by_tag.setdefault(tag, []).append(node)
            if tag in RAW_TEXT:  # its content is no text of the page
                stop = RAW_TEXT[tag].search(html, position)
                position = stop.end() if stop else len(html)
            elif tag not in VOID:
                stack.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        while stack:
            close()

    def attr(self, node: int, name: str) -> str | None:
        attrs = self._attrs.get(node)
        if attrs is None:
            attrs = {}
            for key, double, single, bare in _ATTR.findall(self._raw_attrs[node]):
                attrs.setdefault(key.lower(), double or single or bare)
            self._attrs[node] = attrs
        value = attrs.get(name)
        return unescape(value) if value and self.entities else value

    def text(self, node: int) -> str:
        start, end = self._spans[node]
        text = "".join(self._texts[start:end])
        return unescape(text) if self.entities else text

    def find(self, selector: Selector, within: list[int] | None = None) -> list[int]:
        """Matches in document order; ``within`` keeps proper descendants of those nodes."""
        found = self._found.get(selector.source)
        if found is None:
            found = self._found[selector.source] = self._match(selector)
        if within is None:
            return found
        kept, reached = [], -1
        for root in within:
            if root >= reached:  # else inside the root before, already taken
                reached = self.ends[root]
                kept += found[bisect_left(found, root + 1) : bisect_left(found, reached)]
        return kept

    def _match(self, selector: Selector) -> list[int]:
        found: list[int] = []
        for step, (combinator, compound) in enumerate(selector.steps):
            pool = self._by_tag.get(compound.tag, []) if compound.tag else range(len(self.tags))
            hits = [n for n in pool if compound.holds(self, n)]
            if step and combinator == ">":
                parents = set(found)
                hits = [n for n in hits if self.parents[n] in parents]
            elif step:
                hits = self._below(hits, found)
            found = hits
        return found

    def _below(self, nodes: list[int], roots: list[int]) -> list[int]:
        """The nodes inside any of the roots; both are in document order."""
        kept, reached, at = [], -1, 0
        for node in nodes:
            while at < len(roots) and roots[at] < node:
                reached = max(reached, self.ends[roots[at]])
                at += 1
            if node < reached:
                kept.append(node)
        return kept


class _Compound:
    __slots__ = ("tag", "tests", "nth")

    def __init__(self, tag, tests, nth):
        self.tag, self.tests, self.nth = tag, tests, nth

    def holds(self, page: Page, node: int) -> bool:
        if self.tag and page.tags[node] != self.tag:
            return False
        if self.nth and page.nth[node] != self.nth:
            return False
        for name, value in self.tests:
            have = page.attr(node, name)
            if have is None:
                return False
            if name == "class" and value is not None and isinstance(value, frozenset):
                if not value <= set(have.split()):
                    return False
            elif value is not None and have != value:
                return False
        return True


_PART = re.compile(
    r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w-]+)\s*(?:=\s*(?:'(?P<sq>[^']*)'|\"(?P<dq>[^\"]*)\"|(?P<bare>[\w-]+))\s*)?\]"
    r"|:nth-child\(\s*(?P<nth>[1-9][0-9]*)\s*\)"
)


class Selector:
    """A chain of compounds, each with the combinator that ties it to the one before."""

    def __init__(self, source: str):
        self.source = source
        self.steps: list[tuple[str, _Compound]] = []
        position, combinator = 0, " "
        text = source.strip()
        while position < len(text):
            gap = re.compile(r"\s*>\s*|\s+").match(text, position)
            if gap:
                combinator = ">" if ">" in gap[0] else " "
                position = gap.end()
            compound, position = self._compound(text, position)
            self.steps.append((combinator, compound))
        if not self.steps:
            raise ValueError("empty selector")

    def _compound(self, text: str, start: int) -> tuple[_Compound, int]:
        name = re.compile(r"[A-Za-z][\w-]*|\*").match(text, start)
        position = name.end() if name else start
        tag = name[0].lower() if name and name[0] != "*" else None
        tests, classes, nth = [], set(), None
        while part := _PART.match(text, position):
            position = part.end()
            if part["id"]:
                tests.append(("id", part["id"]))
            elif part["cls"]:
                classes.add(part["cls"])
            elif part["attr"]:
                values = [v for v in (part["sq"], part["dq"], part["bare"]) if v is not None]
                tests.append((part["attr"].lower(), values[0] if values else None))
            else:
                nth = int(part["nth"])
        if classes:
            tests.append(("class", frozenset(classes)))
        if position == start or (position < len(text) and text[position] not in " \t\n>"):
            raise ValueError(f"selector not supported: {self.source!r}")
        return _Compound(tag, tests, nth), position
