"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. Each line weighs as much as it has text: nothing where it is
hidden, part of a menu, notice, advert, comment or the like, all links, or a copyright line; much more where the
page marks its article. Weights are summed over sliding windows of lines. Where the sum surges over the threshold
content begins, and where it dives below a fraction of it content ends; what has weight between such points is
kept. The threshold is the usual one or, on a page that never reaches it, the page's own highest sum, so that a
short article is found like a long one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import tidy

WINDOW = 3
THRESHOLD = 86

#: Element names of HTML by what they mean for the main text.
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math".split())
_DROPPED = frozenset("nav footer aside form menu dialog button select datalist object canvas audio video map fieldset head".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend optgroup option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent gdpr disqus discussion footer form login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply replies respond responses share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_ARTICLE_WORDS = frozenset("article articlebody content entry maintext post postbody story".split())

#: Elements whose end tag may be left out: a start tag of the second kind ends an open one of the first.
_CELLS = frozenset("td th".split())
_ENDED_BY = {"li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr"]), "td": _CELLS | {"tr"}, "th": _CELLS | {"tr"}, "option": frozenset(["option"])}
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_TO_QUOTE = re.compile(r"[^>\"']*+")
_COPYRIGHT = re.compile(r"\s*(?:\u00a9|\(c\)|copyright\b)|\ball rights reserved\b", re.I)


class Line(NamedTuple):
    text: str
    side: bool  # hidden or part of something that is no article
    mark: int  # 2 inside an article or main element, 1 inside one whose class says so, else 0
    heading: int  # its level, 0 for none
    linked: int  # characters inside links


_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")


def _kind(name: str, attrs: str) -> str:
    """What an element holds: ``side``, ``article`` or nothing special."""
    if name in _DROPPED:
        return "side"
    kind = "article" if name in ("article", "main") else ""
    if attrs and name not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            what, value = m[1].lower(), (m[2] or "").strip("\"'")
            if what == "hidden" or (what == "aria-hidden" and value.lower() == "true" and name not in _HEADINGS) or (what == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return "side"
            if what == "role":
                if value.lower() in _ROLES:
                    return "side"
                if value.lower() in ("main", "article"):
                    kind = "article"
            if what in ("class", "id"):
                words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
                if words & _SIDE_WORDS:
                    return "side"
                if not kind and name in ("div", "section", "td") and words & _ARTICLE_WORDS:
                    kind = "marked"
    return kind


class _Page:
    """A page read from left to right. Every search that fails is never repeated, so the time is linear in the page."""

    def __init__(self, html: str):
        self.html, self.end = html, len(html)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, str]] = []
        self.open: Counter[str] = Counter()  # names on the stack
        self.kinds: Counter[str] = Counter()  # kinds on the stack
        self.parts: list[str] = []
        self.linked, self.in_link, self.heading = 0, False, 0
        self._ahead: dict[str, int] = {}  # end tag -> where the next one is

    def find(self, what: str, at: int) -> int:
        """Where ``what`` is at or after ``at``, or the page's end; looked for at most once per place."""
        known = self._ahead.get(what, -1)
        if known < at:
            known = self.html.find(what, at)
            self._ahead[what] = known = self.end if known < 0 else known
        return known

    def tag_end(self, at: int) -> int:
        """Position of the > that ends a tag; one inside a quoted value, which follows a =, doesn't count."""
        while True:
            at = _TO_QUOTE.match(self.html, at).end()
            if at >= self.end or self.html[at] == ">":
                return at
            quote = self.html[at]
            if self.html[max(0, at - 8) : at].rstrip().endswith("="):
                stop = self.find(quote, at + 1)
                if stop < self.end:
                    at = stop
            at += 1

    def closing(self, name: str, at: int) -> int:
        """Where the next end tag of ``name`` begins."""
        key = "/" + name
        known = self._ahead.get(key, -1)
        if known < at:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.html, at)
            self._ahead[key] = known = m.start() if m else self.end
        return known

    def say(self, text: str) -> None:
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            line = " ".join(unescape("".join(self.parts)).split())
            self.parts.clear()
            if line:
                k = self.kinds
                side = bool(k["side"] or (k["header"] and not (k["heading"] and k["article"])))
                self.lines.append(Line(line, side, 2 if k["article"] else 1 if k["marked"] else 0, self.heading if k["heading"] else 0, self.linked))
        self.linked = 0

    def push(self, name: str, kind: str) -> None:
        self.stack.append((name, kind))
        self.open[name] += 1
        self.kinds[kind] += 1

    def pop(self) -> str:
        name, kind = self.stack.pop()
        self.open[name] -= 1
        self.kinds[kind] -= 1
        return name

    def close(self, name: str) -> None:
        if self.open[name]:
            while self.pop() != name:
                pass

    def start(self, name: str, attrs: str, at: int) -> None:
        if name in _BLOCKS:
            self.in_link = False
            if self.stack and (self.stack[-1][0] == "p" or name in _ENDED_BY.get(self.stack[-1][0], ())):
                self.pop()
            if name == "tr" and self.stack and self.stack[-1][0] == "tr":
                self.pop()
        if name == "body":  # what a page's head left open ends here
            while self.stack and self.stack[-1][0] == "head":
                self.pop()
        if name == "a":
            self.in_link = "href" in attrs.lower()
        kind = "header" if name == "header" else "heading" if name in _HEADINGS else _kind(name, attrs)
        if kind == "heading":
            self.heading = int(name[1])
        if name in _BLOCKS or (kind and self.closing(name, at) < self.end):  # what is never closed inside a line marks nothing
            self.push(name, kind)

    def read(self) -> list[Line]:
        html, at = self.html, 0
        while at < self.end:
            tag = html.find("<", at)
            if tag < 0:
                self.say(html[at:])
                break
            if tag > at:
                self.say(html[at:tag])
            if html.startswith("<!--", tag):
                stop = self.find("-->", tag + 4)
                at = min(self.end, stop + 3)
                continue
            if html.startswith("<![CDATA[", tag):
                stop = self.find("]]>", tag + 9)
                self.say(html[tag + 9 : stop].replace("&", "&amp;").replace("<", "&lt;"))
                at = min(self.end, stop + 3)
                continue
            if html.startswith(("<!", "<?"), tag):
                at = min(self.end, self.find(">", tag) + 1)
                continue
            m = _NAME.match(html, tag + 1)
            if not m:  # a < of the text
                self.say("&lt;")
                at = tag + 1
                continue
            stop = self.tag_end(m.end())
            name, attrs, closes = m[1].lower(), html[m.end() : stop], html[tag + 1] == "/"
            at = stop + 1
            if name in _RAW and not closes:
                if name == "title":
                    self.flush()
                stop = self.closing(name, at)
                if stop < self.end or name in ("script", "style", "textarea", "title"):
                    at = stop
                continue
            if name in _BLOCKS:
                self.flush()
            elif name == "br":
                self.say(" ")
            if name in _RAW or name in _VOID or (attrs.endswith("/") and name not in _BLOCKS):
                continue
            if closes:
                if name == "a" or name in _BLOCKS:
                    self.in_link = False
                self.close(name)
            else:
                self.start(name, attrs, at)
        self.flush()
        return self.lines


def lines_of(html: str | None) -> list[Line]:
    """The page's lines, one for each block with text, in page order."""
    return _Page(html or "").read()


def weights_of(lines: list[Line], threshold: int = THRESHOLD) -> list[int]:
    """Weight of each line: its characters; none on the side, for links and copyright lines; more by the article's marks.

    Where the page marks its article (or an element by class), lines in it weigh a threshold more, and others a
    4096th of their characters.
    """
    best = max((x.mark for x in lines if not x.side), default=0)
    out = []
    for x in lines:
        n = len(x.text)
        if x.side:
            n = 0
        elif best and x.mark == best:
            n += threshold
        elif 2 * x.linked > n or _COPYRIGHT.search(x.text):
            n = 0
        elif best:
            n >>= 12
        out.append(n)
    return out


def main_blocks(html: str | None, window: int = WINDOW, threshold: int = THRESHOLD, dive: float = 0.125) -> list[str]:
    """Blocks between surge and dive points; none for null, empty and textless pages.

    Sums are of the ``window`` lines from each. Content is a run of windows whose sums are at least ``dive`` of the
    threshold, and one of which surges to it (or to the page's highest sum, where that is less); every line with
    weight in it is kept. Where no mark says more, short lines before a first-level heading in the run lead up to it
    and are left out. Very long pages and broken markup take time linear in the page: unclosed quotes, comments and
    elements end with the page.
    """
    lines = lines_of(html)
    weights = weights_of(lines, threshold)
    n = len(lines)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    least = min(threshold, max(sums, default=0))
    if not least:
        return []
    kept: list[str] = []
    at = 0
    while at < n:
        stop = at
        while stop < n and sums[stop] >= max(1.0, dive * least):  # until the dive
            stop += 1
        if stop > at and max(sums[at:stop]) >= least:  # a surge
            last = min(n, stop + window - 1)
            first = next((k for k in range(at, last) if lines[k].heading == 1 and weights[k]), at)
            if sum(weights[at:first]) >= least or any(x.mark for x in lines[at:first]):
                first = at
            kept += [lines[k].text for k in range(first, last) if weights[k]]
            at = last
        else:
            at = stop + 1
    return kept


def main_text(html: str | None) -> str:
    """The page's main text, its blocks joined by an empty line."""
    return "\n\n".join(main_blocks(html))


def extracted(html: str = "html") -> Column:
    """Column of the main text of each whole page (null: the empty text)."""

    @F.pandas_udf("string")
    def of(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for block in blocks:
            yield pd.Series([main_text(x) for x in block], dtype=object)
        tidy()

    return of.asNondeterministic()(F.col(html))
