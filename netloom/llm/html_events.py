"""HTML as a flat list of events: elements that open and close, and the texts between them.

A small tolerant reader: comments, declarations, raw-text elements, void elements, elements that close by themselves, stray end
tags and a missing end are taken as browsers take them. An element's path is a hash of the names and classes down to it.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import xxhash

# Element names and the words that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head script style noscript template title textarea select option button iframe object svg canvas audio video xmp noembed noframes".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
REMARKS = frozenset("comment comments commentlist reply replies respond disqus".split())
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header "
    "masthead share sharing social related recommended widget login signup search toolbar skip".split()
)
#: An element of the key closes open ones of the set, up to the nearest of the fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PARAGRAPH_ENDS = BLOCK - {"br", "caption", "head", "html", "legend", "option", "select", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "body"}
FENCE = frozenset("html body div article section main aside header footer nav form td th li dd table blockquote button object figure".split())

OPEN, CLOSE, TEXT = 0, 1, 2

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*+(?:"[^"]*"|'[^']*')|[="'])*+)>""",
    re.DOTALL,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_WORD = re.compile(r"[a-z]+")


class Event(NamedTuple):
    kind: int
    path: int
    depth: int
    rank: int  #: 2 an article, 1 a main element, 0 anything else
    left_out: int  #: 0 main text, 1 marked otherwise, 2 readers' remarks, 3 never text
    link: bool
    block: bool
    text: str


class _Element(NamedTuple):
    name: str
    path: int
    rank: int
    left_out: int
    link: bool


@functools.lru_cache(maxsize=100_000)
def _element(name: str, attributes: str, parent: _Element) -> _Element:
    named = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _NAMED.findall(attributes)}
    words = set(_WORD.findall(named.get("class", "") + " " + named.get("id", "")))
    role = named.get("role", "")
    rank = 2 if name == "article" else 1 if name == "main" or role == "main" or named.get("itemprop") == "articlebody" else 0
    if name in NEVER:
        own = 3
    elif words & REMARKS and name not in ("html", "body", "main"):
        own = 2
    elif name in ASIDE or role in ROLES:
        own = 1
    else:
        own = 1 if rank == 0 and name not in ("html", "body") and name not in HEADINGS and words & MARKS else 0
    left_out = max(own, parent.left_out)
    if rank and own == 0 and parent.left_out == 1:  # an element left open, or a form around the whole page, does not hide the article
        left_out = 0
    label = name + "." + re.sub(r"\d+", "", named.get("class", ""))
    return _Element(name, xxhash.xxh64_intdigest(label, parent.path), rank, left_out, parent.link or name == "a")


def read(html: str | None) -> list[Event]:
    """Events of a page in order; every element that opens also closes."""
    html = html or ""
    out: list[Event] = []
    make = Event._make
    stack = [_Element("", 1, 0, 0, False)]

    def close(size: int) -> None:
        while len(stack) > size:
            e = stack.pop()
            out.append(make((CLOSE, e.path, len(stack), e.rank, e.left_out, e.link, e.name in BLOCK, "")))

    def text(start: int, stop: int) -> None:
        if stop > start:
            top = stack[-1]
            out.append(make((TEXT, top.path, len(stack), 0, top.left_out, top.link, False, html[start:stop])))

    def close_up(names, fence) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].name in names:
                close(at)
                return
            if stack[at].name in fence:
                return

    position = 0
    while True:
        found = _TOKEN.search(html, position)
        if not found:
            text(position, len(html))
            break
        text(position, found.start())
        position = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name != "br":  # a stray </br> counts as <br>
                close_up({name}, frozenset() if name in FENCE else FENCE)
                continue
        if name == "body":
            close(2 if len(stack) > 1 and stack[1].name == "html" else 1)
        elif name in PARAGRAPH_ENDS:
            close_up({"p"}, FENCE)
        if name in CLOSES:
            close_up(*CLOSES[name])
        attributes = found[3]
        element = _element(name, attributes if _NAMED.search(attributes) else "", stack[-1])
        out.append(make((OPEN, element.path, len(stack), element.rank, element.left_out, element.link, name in BLOCK, "")))
        stack.append(element)
        if name in VOID:
            close(len(stack) - 1)
        elif name in RAW:
            end = _ENDS[name].search(html, position)
            text(position, end.start() if end else len(html))
            position = end.end() if end else len(html)
            close(len(stack) - 1)
    close(1)
    return out
