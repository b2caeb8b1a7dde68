"""Main text of web pages, by the density of text between tags."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title head svg math iframe object canvas audio video select option datalist textarea button".split())
APART = frozenset("nav footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
WITHIN = INLINE | {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
# What can stand in a head; anything else ends one that is open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
# Elements that hold parts of a page. Words in their class or id mark a part as none of the article's, and roles do so in any element.
CONTAINERS = frozenset("aside center details div dl fieldset figure footer form header nav ol section table ul".split())
FOREIGN = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer discussion disqus footer "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay paywall popup promo promoted promotion reactions "
    "related recommended replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OWN = frozenset("article body content entry main page post root site story text wrapper".split())

SIGMA = 2.0


class _Block:
    __slots__ = ("parts", "tags", "foreign", "main", "heading", "linked")

    def __init__(self, tags: int, foreign: bool, main: int, heading: bool) -> None:
        self.parts: list[str] = []
        self.tags, self.foreign, self.main, self.heading, self.linked = tags, foreign, main, heading, 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Lines(HTMLParser):
    """The page as lines: runs of text between block elements, with the tags met and where they stand."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, silent, foreign
        # Open elements by name: block elements of the page, and what is open within each block element.
        self.boxed: Counter[str] = Counter()
        self.within: list[Counter[str]] = [Counter()]
        self.silent = self.foreign = self.main = self.links = self.boxes = 0
        self.blocks: list[_Block] = []
        self.tags = 0
        self.heading = False
        self.broken = True

    def _foreign(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "main", "article"):
            return False
        if tag in APART or tag == "header" and not self.main:
            return True
        names = {k: v or "" for k, v in attrs}
        if names.get("role", "").lower() in ROLES or "hidden" in names or names.get("aria-hidden") == "true" or re.search(r"display:\s*none", names.get("style", "")):
            return True
        if tag not in CONTAINERS:
            return False
        named = names.get("class", "") + ("" if self.main and tag == "section" else " " + names.get("id", ""))
        found = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))
        return bool(found & FOREIGN) and not (found & OWN and not found & {"ad", "ads", "comment", "comments", "related", "sidebar"})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.broken = True
        self._end_head(tag)
        if tag in VOID or tag == "head" and len(self.open) != self.boxed["html"]:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", *HEADINGS) and self.open and self.open[-1][0] == tag:
            self._close(tag)
        silent, foreign = tag in SILENT, self._foreign(tag, attrs)
        self.open.append((tag, silent, foreign))
        if tag in WITHIN:
            self.within[-1][tag] += 1
        else:
            self.boxed[tag] += 1
            self.within.append(Counter())
        self.silent += silent
        self.foreign += foreign
        self.boxes += tag in MAIN and not self.main
        self.main += tag in MAIN
        self.links += tag == "a"
        if tag in HEADINGS:
            self.heading = True

    def _end_head(self, tag: str | None) -> None:
        """A body ends an open head, and so does what stands right in it and cannot."""
        if self.open and (tag == "body" or self.open[-1][0] == "head" and tag not in IN_HEAD):
            self._close("head")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in SILENT | APART:
            self.tags += 1
            self.broken |= tag not in INLINE

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.broken = True
        self._close(tag)

    def _close(self, tag: str) -> None:
        """Close up to the latest element of this name; inline elements don't reach over block ones. A tag that closes nothing costs nothing."""
        if not (self.within[-1] if tag in WITHIN else self.boxed)[tag]:
            return
        closed = None
        while closed != tag:
            closed, silent, foreign = self.open.pop()
            if closed in WITHIN:
                self.within[-1][closed] -= 1
            else:
                self.within.pop()
                self.boxed[closed] -= 1
            self.silent -= silent
            self.foreign -= foreign
            self.main -= closed in MAIN
            self.links -= closed == "a"
            self.heading = self.heading and closed not in HEADINGS

    def handle_data(self, data: str) -> None:
        if self.silent and data.strip():
            self._end_head(None)
        if self.silent:
            return
        if self.broken or not self.blocks:
            if not data.strip():
                return
            self.blocks.append(_Block(self.tags, bool(self.foreign), self.boxes if self.main else 0, self.heading))
            self.tags, self.broken = 0, False
        block = self.blocks[-1]
        block.parts.append(data)
        block.tags += self.tags
        self.tags = 0
        block.linked += len(data.strip()) if self.links else 0


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over the lines around each line."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(values, weights)[reach : reach + len(values)]
    return padded / np.convolve(np.ones(len(values)), weights)[reach : reach + len(values)]


def _cluster(ratios: np.ndarray) -> np.ndarray:
    """Which smoothed ratios belong to the upper of two clusters: the threshold settles between the two means, or lies at the deviation where that is less."""
    cut = ratios.mean()
    for _ in range(30):
        upper = ratios > cut
        if upper.all() or not upper.any():
            break
        new = (ratios[upper].mean() + ratios[~upper].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return ratios >= min(cut, ratios.std(), ratios.max())


def _region(lines: list[tuple[_Block, str]]) -> np.ndarray:
    """Which lines are the content: the dense region, or the marked articles where one of them holds as much text as is dense outside."""
    plain = np.array([max(0, len(t) - 2 * b.linked) for b, t in lines], float)
    ratios = plain / np.array([max(1, b.tags) for b, _ in lines])
    dense = _cluster(smoothed(ratios)) & (ratios.max() > 0)
    boxes = np.array([b.main for b, _ in lines])
    inside = np.bincount(boxes, weights=plain)
    if len(inside) > 1 and inside[1:].max() >= plain[dense & (boxes == 0)].sum():
        return boxes > 0
    keep = np.zeros(len(lines), bool)
    at = np.flatnonzero(dense)
    if len(at):
        first, last = int(at[0]), int(at[-1])
        while first and lines[first - 1][0].heading:
            first -= 1
        # Links at the ends are none of the content; those between dense lines are.
        links = [b.linked * 2 > len(t) and not b.heading for b, t in lines]
        while first < last and links[first]:
            first += 1
        while first < last and links[last]:
            last -= 1
        keep[first : last + 1] = not links[first]
    # A marked article that is dense somewhere stays whole, and so does the only one of a page.
    marked = set(boxes[boxes > 0].tolist())
    return keep | np.isin(boxes, [k for k in marked if len(marked) == 1 or dense[boxes == k].any()])


def main_text(html: str) -> str:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = [(b, b.text()) for b in parser.blocks]
    lines = [(b, t) for b, t in lines if t and not b.foreign]
    return " ".join(t for (_, t), k in zip(lines, _region(lines)) if k) if lines else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` with the main text of ``html`` as ``text``, in place of an earlier column of that name.

    Each page goes through the streaming parser once. It is cut at block elements into lines, each with its characters and the tags before it.
    Parts that are no article by their element, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    comments) are left out. On every page the ratio of text (less links) to tags is smoothed by a Gaussian and split into two clusters by a
    threshold. If an element that marks an article holds as much text as the dense lines outside of all such elements, the marked ones are the
    content region. Otherwise (no article, or teasers alone) the region from the first to the last dense line, with the heading before it, is taken,
    with the whole of each marked article that is dense somewhere or the only one. Links are left out at the ends of the region, and kept
    within. Words of a class or id are looked at in containers alone, and not the ids of sections in an article. Character references are decoded, white space in a line becomes one space, and lines are joined by one space.

    Null or empty html gives an empty text. A head without an end tag ends at the body or at the first thing that no head can hold. Broken markup is read as far as it goes. Repeated rows are treated alike; no rows give no
    rows; other columns stay. There is no shuffle; a batch of pages is held at a time, and the work on a page grows with its length.
    """
    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h) if h else "")

    return pages.withColumn("text", texts("html"))
