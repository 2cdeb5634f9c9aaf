"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one for each block element, each with the number of
its characters that may be content: none inside menus, headers, footers, side
bars, forms, scripts, notices, adverts and comments, and none of a link's words.
Sums of these lengths over sliding windows of lines show where a page's text
surges and where it dives: a region runs from the first line of a surge to the
last before the dive. A page that marks its article is measured inside the mark
alone, where a list of links as long as a window is a dive too. A region is kept whatever its size, with the links in it; one of nothing
but links is no content, and neither is a lone word without a sentence's end that
windows without text part from the rest of an unmarked page. Lines that are no content
are left out wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import table

#: Lines of a window.
WINDOW = 5

# HTML element names by their part in a page.
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation".split()
)
_APART = frozenset("nav header footer aside form menu dialog button fieldset head".split())
_ARTICLE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no class, id or role makes a part without content.
_NEVER = frozenset("html body main article".split())
#: Classes, ids and roles that name a part that is no content: whole tokens, never parts of one.
_WORDS = frozenset(
    "ad ads advert adverts advertisement adverts sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget footer header masthead cookie cookies consent notice notices alert popup modal "
    "newsletter subscribe social share sharing related recommended comment comments respond disqus complementary "
    "contentinfo search login signup pagination pager copyright disclaimer "
    "site-header site-footer page-footer site-nav site-navigation main-nav main-navigation main-menu nav-bar nav-menu "
    "side-bar sidebar-left sidebar-right widget-area ad-banner ad-container ad-slot ad-unit cookie-banner cookie-bar "
    "cookie-consent cookie-notice newsletter-signup social-links social-media share-buttons social-share related-posts "
    "related-articles comment-list comments-area comment-form post-navigation skip-link".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(_RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


@dataclass
class Line:
    """One block's text; ``content`` counts its characters that may be content.

    None of them are a link's. A line without words beside its links has none;
    ``links`` counts the links that stand in it.
    """

    text: str
    content: int
    links: int
    paragraph: bool
    apart: bool
    article: int
    heading: bool
    inner: bool


class Element(NamedTuple):
    """An open element; ``named`` if it is apart by its class, id or role alone."""

    name: str
    place: int
    apart: bool
    named: bool
    article: bool
    link: bool


def _attributes(source: str) -> dict[str, str]:
    """Names in lower case and values; of a name that repeats, the first counts."""
    out: dict[str, str] = {}
    if source and not source.isspace():
        for name, *values in _ATTRIBUTE.findall(source):
            out.setdefault(name.lower(), unescape("".join(values)))
    return out


def _is_apart(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is no content by its name, or is hidden."""
    if name in _APART or "hidden" in attributes:
        return True
    if attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    return _NO_DISPLAY.search(attributes.get("style", "")) is not None


def _is_named(name: str, attributes: dict[str, str]) -> bool:
    """Whether its class, id or role says that an element is no content."""
    if name in _NEVER:
        return False
    return any(w in _WORDS for k in ("class", "id", "role") if k in attributes for w in attributes[k].lower().split())


def lines_of(html: str) -> list[Line]:
    """The page as lines, with what each is part of.

    A name does not make what holds the article's mark a part without content:
    never what holds ``main``, and what holds an ``article`` only if the marks
    have no text of their own outside.
    """
    lines, over = _walk(html, frozenset())
    spared = frozenset(over["main"])
    if spared:
        lines, over = _walk(html, spared)
    if over["article"] and not any(line.article and not line.apart and not line.heading for line in lines):
        lines, _ = _walk(html, spared | over["article"])
    return lines


def _walk(html: str, spared: frozenset[int]) -> tuple[list[Line], dict[str, set[int]]]:
    """Lines, and the elements around main and around article that are apart by their names.

    Elements are told by the place of their tag; the names of spared ones say nothing.
    """
    out: list[Line] = []
    open_: list[Element] = []
    over: dict[str, set[int]] = {"main": set(), "article": set()}
    words: list[str] = []
    own: list[str] = []  # the words outside links
    links = 0
    articles = 0
    number = 0
    apart = 0

    def close() -> None:
        nonlocal words, own, links
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                rest = " ".join(unescape("".join(own)).split()) if links else text
                content = len(rest) if not apart and (not links or any(c.isalnum() for c in rest)) else 0
                names = {e.name for e in open_}
                out.append(Line(text, content, links, "p" in names and "li" not in names, apart > 0, number if articles else 0, not names.isdisjoint(_HEADINGS), "article" in names and articles > 0))
            words, own, links = [], [], int(in_link > 0)

    place = 0
    in_link = 0
    for m in _TAG.finditer(html):
        if m.start() > place:
            part = html[place : m.start()]
            words.append(part)
            own.append(" " if in_link else part)
        place = m.end()
        name = m.group("name")
        if name is None:
            if m.group("raw"):
                close()
            continue
        name = name.lower()
        if name == "br":
            words.append(" ")
            own.append(" ")
            continue
        if name not in _INLINE:
            close()
        if m.group("end"):
            if any(e.name == name for e in open_):
                while True:
                    gone = open_.pop()
                    apart -= gone.apart
                    articles -= gone.article
                    in_link -= gone.link
                    if gone.name == name:
                        break
        elif name not in _VOID and not m.group("attributes").endswith("/"):
            if name == "p" or name == "li":
                _end_implied(open_, name)
            attributes = _attributes(m.group("attributes"))
            is_apart, named = _is_apart(name, attributes), m.start() not in spared and _is_named(name, attributes)
            if name in _ARTICLE and apart and not is_apart and all(e.named for e in open_ if e.apart):
                over[name].update(e.place for e in open_ if e.named)
            is_article = name in _ARTICLE and not apart
            is_link = name == "a" and "href" in attributes
            open_.append(Element(name, m.start(), is_apart or named, named and not is_apart, is_article, is_link))
            apart += is_apart or named
            number += is_article and not articles
            articles += is_article
            in_link += is_link
            links += is_link
    if place < len(html):
        words.append(html[place:])
        own.append(" " if in_link else html[place:])
    close()
    return out, over


def _end_implied(open_: list[Element], name: str) -> None:
    """An open paragraph or list item of plain inline elements ends at the next one."""
    for k in range(len(open_) - 1, -1, -1):
        if open_[k].name == name:
            if not any(e.apart or e.article or e.name == "a" for e in open_[k:]):
                del open_[k:]
            return
        if open_[k].name not in _INLINE:
            return


def regions(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Surge and dive lines, [first, last], of the sums over sliding windows."""
    n = len(weights)
    if not n:
        return []
    sums = np.convolve(weights, np.ones(window), "valid") if n >= window else np.array([weights.sum()])
    rise = np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(rise == 1), np.flatnonzero(rise == -1)):
        inside = np.flatnonzero(weights[a : min(b - 1 + window, n)]) + a
        out.append((int(inside[0]), int(inside[-1])))
    return out


def _weights(lines: list[Line], inside: list[bool], window: int) -> np.ndarray:
    """Each line's characters of content, of those that are inside.

    A line that is one link weighs in full if it is a paragraph, or no other such
    line is next to it: a run of them is a list of links. Within an article a list
    may be part of the text, and weighs in full if it is shorter than a window.
    """
    weights = np.array([line.content if ok else 0 for line, ok in zip(lines, inside)], float)
    linked = np.array([ok and line.links > 0 and not line.content for line, ok in zip(lines, inside)], bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        for i in range(a, b):
            line = lines[i]
            if line.links == 1 and (line.paragraph or b - a == 1) or line.inner and b - a < window:
                weights[i] = len(line.text)
    return weights


def _is_text(region: list[Line]) -> bool:
    """Whether a region of an unmarked page is more than links, and more than a lone label."""
    own = [line for line in region if line.content]
    if len(own) != 1 or own[0].heading:
        return len(own) > 0
    # Letters without case may be a sentence in one run.
    return not (own[0].text.isalpha() and own[0].text.lower() != own[0].text.upper())


def main_text(html: str | None, window: int = WINDOW) -> str:
    """The page's main text, its blocks apart by an empty line."""
    lines = lines_of(html or "")
    marked = any(line.article for line in lines)
    inside = [not line.apart and (not marked or line.article > 0) for line in lines]
    weights = _weights(lines, inside, window)
    if marked and not weights.any():
        # Nothing but links inside the mark: they are what the page is about.
        weights = np.array([len(line.text) if ok else 0 for line, ok in zip(lines, inside)], float)
    found = [[lines[i] for i in range(a, b + 1) if inside[i]] for a, b in regions(weights, window)]
    return "\n\n".join(line.text for region in found if marked or _is_text(region) for line in region)


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", window: int = WINDOW
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null and empty pages, and those without content, have an empty text. Rows
    that repeat an id give a row each; nothing is cut, however long.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([main_text(h, window) if isinstance(h, str) else "" for h in part], dtype=object)

    rows = pages.select(
        F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").alias("html")
    )
    text = F.pandas_udf(run, "string")("html")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
