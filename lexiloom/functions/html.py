"""A tolerant one-pass HTML scanner; the only Python in the extraction of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom import schemas

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text as it stands, up to their end tag.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}


class Page:
    """Elements in document order as parallel lists. An end tag closes the nearest open element of its name and what is open inside; a stray one does nothing."""

    __slots__ = ("tags", "attrs", "last", "text", "first_text", "last_text")

    def __init__(self, html: str) -> None:
        self.tags: list[str] = []
        self.attrs: list[str] = []
        self.last: list[int] = []
        self.text: list[str] = []
        self.first_text: list[int] = []
        self.last_text: list[int] = []
        pending: list[int] = []
        at = 0
        while m := _TAG.search(html, at):
            name = (m[2] or "").lower()
            if m.start() > at:
                self.text.append(unescape(html[at : m.start()]))
            at = m.end()
            if not name:
                continue
            if m[1]:
                k = next((i for i in range(len(pending) - 1, -1, -1) if self.tags[pending[i]] == name), None)
                if k is not None:
                    self._close(pending[k:])
                    del pending[k:]
                continue
            self.tags.append(name)
            self.attrs.append(m[3])
            self.first_text.append(len(self.text))
            self.last.append(0)
            self.last_text.append(0)
            k = len(self.tags) - 1
            if name in _VOID or m[3].endswith("/"):
                self._close([k])
            else:
                pending.append(k)
                if name in _RAW:
                    end = _RAW[name].search(html, at)
                    stop = end.start() if end else len(html)
                    self.text.append(html[at:stop])
                    at = stop
        if at < len(html):
            self.text.append(unescape(html[at:]))
        self._close(pending)

    def _close(self, nodes: list[int]) -> None:
        for i in nodes:
            self.last[i], self.last_text[i] = len(self.tags), len(self.text)

    def all(self, name: str, inside: int | None = None) -> Iterator[int]:
        start, end = (0, len(self.tags)) if inside is None else (inside + 1, self.last[inside])
        return (i for i in range(start, end) if self.tags[i] == name)

    def first(self, name: str, inside: int | None = None) -> int:
        """Raises LookupError if there is none."""
        for i in self.all(name, inside):
            return i
        raise LookupError(name)

    def content(self, node: int) -> str:
        return "".join(self.text[self.first_text[node] : self.last_text[node]])

    def attr(self, node: int, name: str) -> str | None:
        for m in _ATTR.finditer(self.attrs[node]):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def classes(self, node: int) -> str | None:
        found = self.attr(node, "class")
        return None if found is None else " ".join(found.split())


def _path(page: Page, *steps: str, inside: int | None = None) -> int:
    for s in steps:
        inside = page.first(s, inside)
    assert inside is not None
    return inside


def parse(html: str | None) -> dict:
    """The parts of a page that the extractors read; a part that isn't there is None."""
    out: dict = {"title": None, "metas": None, "spans": None, "cell": None, "images": None, "failed": True}
    if html is None:
        return out
    page = Page(html)
    try:
        out["title"] = page.content(page.first("title"))
    except LookupError:
        pass
    out["metas"] = [page.attr(i, "content") for i in page.all("meta")]
    try:
        root = _path(page, "body", "div", "table")
        out["spans"] = [page.content(i) for i in page.all("span", root)]
        row = list(page.all("tr", root))[6]
        cell = page.first("td", list(page.all("tr", _path(page, "td", "table", inside=row)))[2])
    except LookupError:
        return out
    out["failed"] = False
    out["cell"] = [{"cls": page.classes(i), "text": page.content(i)} for i in page.all("span", cell)]
    try:
        out["images"] = [{"urlimage": page.attr(page.first("img", i), "src"), "legendeimage": page.content(page.first("span", i))} for i in page.all("div", cell)]
    except LookupError:
        pass
    return out


def parsed(html: Column | str) -> Column:
    """`parse` as a column of schema PARSED."""

    @F.pandas_udf(schemas.PARSED)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(h) for h in x], columns=schemas.PARSED.names)

    return run(html)
