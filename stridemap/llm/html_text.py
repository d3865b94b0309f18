"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page as events. They are gathered into lines (block elements), each with its text and its tags.

1.  A line's ratio is its characters for each tag. Its place weighs it: nothing in menus, footers, sidebars, forms and headers of pages, an eighth
    under a class, id or role that names adverts, notices or comments, four times in an article or main element.
2.  The ratios are smoothed with a Gaussian over neighbouring lines. Lines from a threshold on (the standard deviation, and never above the greatest
    smoothed ratio) are the core of clusters.
3.  The core selects the region. If articles and main elements hold two thirds of its smoothed ratios, they are the region; otherwise it is the
    smallest element of several core lines that does. Of the region all lines stay whose ratio is not nothing, so that short paragraphs and headings do; what a class or
    role names stays only if even an eighth of its ratio reaches the threshold. Outside articles, lines that are links for the greater part stay only in the
    core, and in a page without any such element so does what lies outside the clusters.

Defined results: a null or empty page has the empty text. White space (as ``str.split`` has it) inside a line becomes one
space, lines are trimmed, empty ones left out, the rest joined by one line feed. Unclosed and stray tags are
taken as browsers do in the common cases: a block start closes an open paragraph, a block's end tag closes up to its start, another end tag
closes within its block, a stray end tag is skipped, an open head ends at the first text or tag that no head holds. Every event takes
constant time on average, however many elements are open. Nothing is cut off. Repeated rows and null ids get a row each. An empty table
gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, slices

#: Gaussian kernel: lines on either side, and its standard deviation in lines.
RADIUS, SIGMA = 2, 1.0
#: Weights of lines in articles and of those that a class, id or role names; share of the core that a region holds.
IN_ARTICLE, NAMED, SHARE = 4.0, 0.125, 2 / 3

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that leave a head open; elements across which no paragraph is closed.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
SCOPES = frozenset("html table caption td th button object template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template iframe object svg math canvas audio video select datalist button textarea option".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
ROOTS = frozenset(("article", "main"))
#: Words that name what is no article, and words that may stand beside them in one class or id.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar share sharing social related recommended newsletter "
    "subscribe subscription signup login popup modal overlay comment comments commentlist respond replies reply disqus pagination pager skip "
    "widget toolbar copyright".split()
)
BESIDE = frozenset("area bar block body bottom box container content group header inner item items left link links list main outer page right row section site top wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_SPLIT = re.compile(r"[^a-z]+")


@dataclass(frozen=True)
class Open:
    """An open element and what holds inside it: no text, no ratio, named as no article, article (0: none), link, paragraph open, block element."""

    tag: str
    silent: bool = False
    aside: bool = False
    named: bool = False
    root: int = 0
    link: bool = False
    paragraph: bool = False
    element: int = 0


@dataclass(frozen=True)
class Line:
    text: str
    tags: int
    link: int
    where: Open


class Lines(HTMLParser):
    """Lines of a page, and parent and tag of each block element (0 is the page)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.tags_of = [0], [""]
        self.open = [Open("")]
        self.blocks: Counter[str] = Counter()  # open block elements by tag
        self.inline: list[Counter[str]] = [Counter()]  # other open elements by tag, for each open block
        self.text: list[str] = []
        self.tags = self.link = self.roots = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.tags, self.link, self.open[-1]))
            self.tags = self.link = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open[-1].tag == "head" and (tag == "body" or tag not in HEAD):
            self.close_to("head")
        block = tag in BLOCKS
        if block:
            self.flush()
            if self.open[-1].paragraph and tag not in ("html", "body"):
                self.close_to("p")
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        at = self.open[-1]
        named = at.named or (tag not in ("html", "body") and not (tag in ROOTS and not at.root) and names_no_article(attrs))
        root = at.root
        if tag in ROOTS and not (root or at.aside or named):
            self.roots += 1
            root = self.roots
        element = at.element
        if block:
            element = len(self.parents)
            self.parents.append(at.element)
            self.tags_of.append(tag)
            self.blocks[tag] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        aside = at.aside or tag in ASIDE or (tag == "header" and not root)
        paragraph = tag == "p" or (at.paragraph and tag not in SCOPES)
        self.open.append(Open(tag, at.silent or tag in SILENT, aside, named, root, at.link or tag == "a", paragraph, element))

    def close_to(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all inside it; other than a block's end, no end tag closes a block."""
        if not (self.blocks[tag] if tag in BLOCKS else self.inline[-1][tag]):
            return
        while True:
            gone = self.open.pop().tag
            if gone in BLOCKS:
                self.blocks[gone] -= 1
                self.inline.pop()
            else:
                self.inline[-1][gone] -= 1
            if gone == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.close_to("head")
        at = self.open[-1]
        if not at.silent:
            self.text.append(data)
            if at.link:
                self.link += len(data.strip())


def names_no_article(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class or id as a whole, or the role, names what is no article: ``cookie-notice`` does, ``related-work`` does not."""
    for name, value in attrs:
        if value and name in ("class", "id"):
            for token in value.lower().split():
                parts = {p for p in _SPLIT.split(token) if p}
                if parts and not WORDS.isdisjoint(parts) and parts <= WORDS | BESIDE:
                    return True
        elif value and name == "role" and value.lower() in ROLES:
            return True
    return False


def line_ratios(lines: list[Line]) -> np.ndarray:
    """Characters for each tag, weighed by the line's place."""
    weights = [0.0 if x.where.aside else NAMED if x.where.named else IN_ARTICLE if x.where.root else 1.0 for x in lines]
    return np.array([len(x.text) / (1 + x.tags) for x in lines]) * weights


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """``ratios`` under a Gaussian of RADIUS lines, renormalised at the ends."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    full = np.convolve(ratios, kernel)[RADIUS : RADIUS + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[RADIUS : RADIUS + len(ratios)]


def threshold(ratios: np.ndarray) -> float:
    """Least smoothed ratio of the core."""
    return float(min(ratios.std(), ratios.max()))


def between_firm(core: np.ndarray, firm: np.ndarray) -> np.ndarray:
    """Of each run of ``core`` what lies between its first and last firm line; a run without any stays whole."""
    out = core.copy()
    begins = np.flatnonzero(core & ~np.r_[False, core[:-1]])
    ends = np.flatnonzero(core & ~np.r_[core[1:], False]) + 1
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        own = np.flatnonzero(firm[a:b])
        if len(own):
            out[a : a + own[0]] = False
            out[a + own[-1] + 1 : b] = False
    return out


def chosen_lines(lines: list[Line], parents: list[int], tags: list[str]) -> list[int]:
    """Which lines are the page's main text."""
    ratios = line_ratios(lines)
    if not (ratios > 0).any():
        return []
    score = smoothed(ratios)
    least = threshold(score)
    core = (score >= least) & (ratios > 0)
    if not core.any():  # the peak lies on lines without a ratio
        core = ratios > 0
    core = between_firm(core, ratios >= least)
    credit = np.where(core, np.minimum(score, ratios), 0.0)
    named, rooted, element = (np.array([getattr(x.where, c) for x in lines]) for c in ("named", "root", "element"))
    stays = (ratios > 0) & (~named | (ratios >= least))
    if credit[rooted > 0].sum() >= SHARE * credit.sum():
        return np.flatnonzero(stays & (rooted > 0)).tolist()
    held, count = np.zeros(len(parents)), np.zeros(len(parents))
    np.add.at(held, element, credit)
    np.add.at(count, element, core)
    for k in range(len(parents) - 1, 0, -1):
        held[parents[k]] += held[k]
        count[parents[k]] += count[k]
    region, inside = 0, np.zeros(len(parents), bool)
    for k in range(1, len(parents)):
        if parents[k] == region and held[k] >= SHARE * held[0] and count[k] > 1:
            region = k
    inside[region] = True
    for k in range(region + 1, len(parents)):
        inside[k] = inside[parents[k]]
    prose = np.array([2 * x.link < len(x.text) for x in lines])
    at = np.flatnonzero(core & (ratios >= least))  # clusters begin and end with lines that reach the threshold by themselves
    at = at if len(at) else np.flatnonzero(core)
    flat = tags[region] in ("", "html", "body")  # no element of the page holds the text
    between = (np.arange(len(lines)) >= at[0]) & (np.arange(len(lines)) <= at[-1]) if flat else np.ones(len(lines), bool)
    return np.flatnonzero(stays & inside[element] & (core | (prose & between))).tolist()


def main_text(html: str | None) -> str:
    """The article of a page, a line per block."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(parser.lines[k].text for k in chosen_lines(parser.lines, parser.parents, parser.tags_of)) if parser.lines else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = [main_text(h) for h in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = bounded(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
