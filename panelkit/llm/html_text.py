"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming parser gives start, end and data events.  Text
between block-level tags is a block, the page's "line"; its ratio is its characters
per tag inside it.  Ratios are smoothed with a Gaussian along the page, and the
threshold is their standard deviation.  Blocks cluster by the element that holds
them (an ``article``, else a ``main`` without articles, else the nearest division); a
cluster is content if one of its blocks reaches the threshold, smoothed and by itself.
All clusters compete: the ratio of one in ``article`` or ``main`` counts ``BONUS``
times, no more.  Content clusters keep all their blocks, so short paragraphs between
long ones stay; so do headings of a ``main`` before content.  If no cluster reaches the
threshold, the best one is taken.  Elements that say what they are (navigation, headers, footers, sidebars,
forms, scripts, and those whose class, id or role names such a part) never count as
content, but their ratios take part in the smoothing.  A class or id is a weaker word:
where its element holds an article or main, or most of the text of a page without
these, it only lowers ratios to ``PENALTY`` times, and where it holds both it counts for
nothing.  Headings and inline elements have no such names.  Inside an article or main a class or id
counts fully only if it says nothing else or names comments; any other name counts if half of
its element's text or more stands in links.  What a name says
after ``has``, ``no``, ``with`` or ``without`` is about something else.  On pages without article and
main, whole sentences without links in divisions of their own go with the content they touch.

Defined cases: null, empty and textless pages give an empty text; unclosed and cut-off
markup is read as far as it goes; null ids and repeated rows are carried; extra columns
are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import DataFrame

from panelkit.llm.arrow import map_slices

#: Width of the Gaussian, in blocks, and how far it reaches.
SIGMA, REACH = 1.0, 3
#: How much more a ratio counts in an article or main element.
BONUS = 1.5
#: What is left of a ratio under a name that holds an article or main.
PENALTY = 0.5
_SKIPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog menu".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end when the next block starts; those that hold clusters of blocks.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OPEN_ENDED = frozenset("p h1 h2 h3 h4 h5 h6 dt dd".split())
_HOLDERS = frozenset("article main section div td body".split())
#: Elements that a class or id may name as a part; headings and inline elements are what they say, whatever their name.
_NAMEABLE = _BLOCK - _HEADINGS - frozenset("body html main li dt dd".split())
_NAMED = frozenset(
    "ad adbox ads adsbygoogle adslot advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu "
    "modal nav navbar navigation newsletter notice popup promo promoted related replies share sharing sidebar sidenav signup social sponsor sponsored subnav subscribe toolbar topnav widget".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Names of reader comments, and words that say no more about a part than that it is one.
_COMMENTS = frozenset("comment comments disqus replies".split())
_PLAIN_WORDS = frozenset("area bar block box button buttons container content global group inner item items links list main outer page panel post posts section site slot unit wrap wrapper".split())
#: Names of comments outside articles; inside one they may head its own part.
_OUTSIDE = frozenset("discussion responses feedback".split())
_MODIFIERS = frozenset("has no with without".split())
_CUT_TAG = re.compile(r"<[A-Za-z/!?]").match
_TOKENS = re.compile(r"[a-z0-9]+")
_GAUSS = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(REACH + 1)]


NO_NAME, SOFT, HARD = range(3)


def _named(attributes: list[tuple[str, str | None]], inside: bool) -> int:
    """Whether a class or id names a part that is no content.

    ``inside`` an article or main a name is hard only if it says nothing else (as ``related-posts``,
    not ``related-work``) or names comments; another name is soft, and a question of links.
    """
    found = NO_NAME
    for name, value in attributes:
        if name in ("class", "id"):
            for words in re.sub(r"([a-z])([A-Z])", r"\1-\2", value or "").lower().split():
                tokens = _TOKENS.findall(words)
                own = tokens[: next((i for i, t in enumerate(tokens) if t in _MODIFIERS), len(tokens))]
                if not inside and not _OUTSIDE.isdisjoint(own):
                    return HARD
                if not _NAMED.isdisjoint(own):
                    if not inside or not _COMMENTS.isdisjoint(own) or _NAMED.union(_PLAIN_WORDS).issuperset(own):
                        return HARD
                    found = SOFT
    return found


def _shut(attributes: list[tuple[str, str | None]]) -> bool:
    """A role that is no content, or hidden."""
    return any(n == "role" and (v or "").lower() in _ROLES or n == "hidden" or n == "aria-hidden" and v == "true" for n, v in attributes)


class Block(NamedTuple):
    """Text of a block, the tags before its end, its cluster (None for what can't be content), and what stands around it."""

    text: str
    tags: int
    cluster: tuple | None
    heading: bool
    name: int  # the innermost named element, 0 if none
    linked: int  # characters in links


class Blocks(HTMLParser):
    """Blocks of a page.  Each open element carries what it and those around it say, so no step walks the open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.split: set[int] = set()  # main elements that hold articles
        self.mains: list[int] = []  # open main elements that held none so far
        self.holding: set[int] = set()  # named elements that hold articles or main
        self.around: dict[int, int] = {}  # named element -> the one around it
        self.soft: set[int] = set()  # named elements that only links condemn
        self.parted = False  # there is an article or main
        self.open: list[tuple[str, bool, int, tuple, int]] = []  # tag, skipped, number, cluster, innermost name
        self.opened: Counter[str] = Counter()
        self.number = self.skipped = self.tags = self.linked = 0
        self.in_link = False
        self.parts: list[str] = []

    def _top(self) -> tuple[tuple, int]:
        return (self.open[-1][3], self.open[-1][4]) if self.open else ((0, 0, 0), 0)

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                heading = bool(self.open) and self.open[-1][0] in _HEADINGS
                cluster, name = self._top()
                self.blocks.append(Block(text, self.tags, None if self.skipped else cluster, heading, name, min(self.linked, len(text))))
        self.parts, self.tags, self.linked, self.in_link = [], 0, 0, False

    @staticmethod
    def _cluster(tag: str, number: int, around: tuple) -> tuple:
        """Level (2 article, 1 main, 0 neither), element and nearest division."""
        level, holder, nearest = around
        if level == 2 or tag not in _HOLDERS:
            return around  # the outermost article counts
        if tag == "article":
            return (2, number, number)
        if tag == "main":
            return (1, number, number)
        return (level, number if level == 0 else holder, number)

    def _pop(self, at: int) -> None:
        for tag, skipped, number, _, _ in self.open[at:]:
            self.skipped -= skipped
            self.opened[tag] -= 1
            if tag == "main" and self.mains and self.mains[-1] == number:
                self.mains.pop()
        del self.open[at:]

    def handle_starttag(self, tag: str, attributes: list) -> None:
        block = tag in _BLOCK
        whole = tag in ("html", "body", "main")
        skip = tag in _SKIPPED
        named = NO_NAME
        if attributes and not whole and not skip:
            skip = _shut(attributes) if tag != "article" else any(name == "hidden" for name, _ in attributes)
            if not skip and tag in _NAMEABLE:
                named = _named(attributes, self._top()[0][0] > 0)
        if block or skip or named:
            self._end_block()
        if block and self.open and self.open[-1][0] in _OPEN_ENDED:
            self._pop(len(self.open) - 1)
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self._pop(len(self.open) - 1)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.in_link = True
        if tag not in _VOID and (block or skip or named):
            self.number += 1
            around, name = self._top()
            self.skipped += skip
            if tag in ("article", "main") and not self.skipped and not named:
                self.holding.add(name)
                self.parted = True
            if named:
                self.around[self.number] = name
                name = self.number
                if named == SOFT:
                    self.soft.add(name)
            self.open.append((tag, skip, self.number, self._cluster(tag, self.number, around), name))
            self.opened[tag] += 1
            if tag == "article" and not self.skipped:
                self.split.update(self.mains)
                self.mains.clear()
            elif tag == "main":
                self.mains.append(self.number)

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if self.opened[tag]:
            at = len(self.open) - 1
            while self.open[at][0] != tag:  # all it passes are closed
                at -= 1
            self._end_block()
            self._pop(at)
        elif tag in _BLOCK:
            self._end_block()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data)

    def close(self) -> None:
        if self.cdata_elem is None and _CUT_TAG(self.rawdata):  # the page ends inside a tag
            self.rawdata = ""
        super().close()
        self._end_block()


def smoothed(ratios: list[float]) -> list[float]:
    """A Gaussian mean over neighbours; at the ends over those that exist."""
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - REACH), min(len(ratios), i + REACH + 1)
        weights = [_GAUSS[abs(j - i)] for j in range(low, high)]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high], strict=True)) / sum(weights))
    return out


def _against(parser: Blocks) -> tuple[dict[int, bool], dict[int, bool]]:
    """For each named element: whether a name around or at it counts against its text, and whether it may be content at all."""
    size: Counter[int] = Counter()
    links: Counter[int] = Counter()
    for b in parser.blocks:
        if b.cluster is not None:
            size[b.name] += len(b.text)
            links[b.name] += b.linked
    holding = set(parser.holding)
    for number in sorted(parser.around, reverse=True):  # from the inside out
        around = parser.around[number]
        size[around] += size[number]
        links[around] += links[number]
        if number in holding:
            holding.add(around)
    most = {n for n in parser.around if 2 * size[n] > size[0]}
    held = holding if parser.parted else most
    counts, able = {0: False}, {0: True}
    for number in sorted(parser.around):
        around = parser.around[number]
        # a name that holds both most text and an article says nothing; a soft one needs links
        idle = number in most and number in holding or number in parser.soft and 2 * links[number] < size[number]
        counts[number] = counts[around] or not idle
        able[number] = able[around] and (idle or number in held)
    return counts, able


_ENDS = (".", "!", "?", "…", '"', "”", "’", ")", "»")
_NOTICE = re.compile(r"©|\(c\)|all rights reserved|cookie", re.IGNORECASE).search


def _reads_on(b: Block) -> bool:
    """A whole sentence without links and names, as a paragraph in a division of its own is."""
    return b.cluster is not None and b.name == 0 and b.linked == 0 and b.text.endswith(_ENDS) and " " in b.text and not _NOTICE(b.text)


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by blank lines."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    blocks = parser.blocks
    own = [len(b.text) / (1 + b.tags) for b in blocks]
    ratios = smoothed(own)
    counts, able = _against(parser)
    clusters, weights = [], []
    for b in blocks:
        c = b.cluster
        if c is None or not able[b.name]:
            clusters.append(None)
        else:
            clusters.append((c[0], c[2] if c[0] == 1 and c[1] in parser.split else c[1]))
        weights.append(PENALTY if counts[b.name] else BONUS if c and c[0] else 1.0)
    best: dict[tuple, float] = {}
    for cluster, weight, *both in zip(clusters, weights, ratios, own, strict=True):
        if cluster is not None:  # a short block beside long ones is none of their kind by itself
            best[cluster] = max(best.get(cluster, 0.0), min(both) * weight)
    if not best:
        return ""
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    chosen = {c for c, r in best.items() if r >= threshold} or {max(best, key=lambda c: (best[c], c[0], -c[1]))}
    kept = [c in chosen for c in clusters]
    if not parser.parted:  # sentences in divisions of their own go with the text they touch
        for i in range(1, len(blocks)):
            kept[i] = kept[i] or kept[i - 1] and _reads_on(blocks[i])
        for i in range(len(blocks) - 2, -1, -1):
            kept[i] = kept[i] or kept[i + 1] and _reads_on(blocks[i])
    texts, follows = [], False
    for i in range(len(blocks) - 1, -1, -1):
        if kept[i] or follows and blocks[i].heading and clusters[i] is not None and clusters[i][0] == 1:
            texts.append(blocks[i].text)
            follows = True
    return "\n\n".join(reversed(texts))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every page."""

    def work(page_ids: list, urls: list, htmls: list) -> list:
        texts = [main_text(h) for h in htmls]
        return [page_ids, urls, texts, [len(t) for t in texts]]

    out = {"page_id": "long", "url": "string", "text": "string", "n_chars": "long"}
    return map_slices(pages.select("page_id", "url", "html"), "html", out, work)
