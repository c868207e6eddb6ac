"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams its events into lines: one line for each run of text between block-level tags,
with the number of tags it holds and the section it lies in. The ratio of text to tags of each line is smoothed over its
neighbours; lines above a threshold of the page's own spread form clusters, and clustered text decides:

* A form, a page's header, or an element whose class, id or role names a part beside the article (comments, advert,
  cookie bar) is left out, unless most of the clustered text lies in it; for comments, adverts and notices all but a
  tenth must.
* Article and main elements are the content region where they hold at least as much clustered text as the rest of the
  page, those without clustered text of their own left out; else it is the innermost section around the headings and
  dense lines of all clusters.
* In that region a block is a menu, and left out, if all its lines, two or more, are links and none of them is dense.

All other lines of the region are kept, short ones too. Scripts, controls, navigation, footers and what is hidden never
count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .batches import pieces, texts

BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never content.
DROPPED = frozenset("script style noscript template nav footer aside menu button select textarea label legend datalist iframe svg math object head title dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an open one of the same kind ends, and the ends that HTML lets authors leave out.
CLOSED_BY = {"p": BLOCKS - {"body", "html", "head"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
#: Words that name a part of the page beside the article, and those among them that are hardly ever the article itself.
BESIDE = frozenset(
    "sponsor sponsored promo promotion popup modal overlay nav navigation navbar menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social "
    "subscribe newsletter signup discussion login search form paywall toolbar pagination pager copyright complementary contentinfo".split()
)
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices alert comment comments comentarios kommentare commentaires disqus reply replies respond".split()
)
#: Words beside these in a class, id or role that say no more than where or how large it is: ad-slot, user-comments.
NEUTRAL = frozenset("area articles bar block blog body bottom box button buttons card cards container entry footer group holder inner item items left links list main outer page panel popular post posts reader region right row section site slot stories thread top unit user users wrap wrapper".split())
#: With one of these, a header is the article's own.
OWN_HEADER = frozenset("article blog content entry page post story title".split())
#: Elements that no class, id or role makes a part beside the article.
KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Elements that name the content themselves.
NAMED = frozenset({"article", "main"})
SIGMA = 2.0
#: Characters a tag from which on a line is running text on any page.
DENSE = 40.0
NAME_PARTS = re.compile(r"[-_0-9]+|(?<=[a-z])(?=[A-Z])")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line(NamedTuple):
    """A line of a page: its text, the tags in it, whether most of it is links or it is a heading, and the numbers of the
    section, the outermost article or main, the part beside the article and the block it lies in (0: none)."""

    text: str
    tags: int
    linked: bool
    heading: bool
    section: int
    named: int
    aside: int
    block: int


class _Nested:
    """Open elements of one kind, numbered in the order they begin: each knows the one around it."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int]] = []  # depth in the page, number
        self.outer = [0]

    @property
    def now(self) -> int:
        return self.open[-1][1] if self.open else 0

    def begin(self, depth: int) -> int:
        self.outer.append(self.now)
        self.open.append((depth, len(self.outer) - 1))
        return self.now

    def end(self, depth: int) -> bool:
        if self.open and self.open[-1][0] == depth:
            self.open.pop()
            return True
        return False

    def summed(self, values: list[int]) -> list[int]:
        """For each element what it and the elements in it have; inner ones have larger numbers."""
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            out[self.outer[i]] += out[i]
        return out


class _Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[str] = []
        self.drops: list[int] = []  # depths at which a dropped element began
        self.sections, self.named, self.asides, self.blocks = (_Nested() for _ in range(4))
        self.never = [False]  # for each part beside the article whether it is hardly ever the article
        self.aside_named = [0]  # and the outermost article or main it lies in
        self.links = 0  # open <a> elements
        self.linked = 0  # characters in them
        self.parts: list[str] = []
        self.tags = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # "<![" of any kind is no text, and never an error

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, 2 * self.linked > len(text), any(x in HEADINGS for x in self.open[-3:]), self.sections.now, self._outermost(), self.asides.now, self.blocks.now))
            self.parts = []
        self.tags = self.linked = 0

    def _outermost(self) -> int:
        return self.named.open[0][1] if self.named.open else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            self.tags += 1
            return
        if tag in BLOCKS:
            self.flush()
            if self.open:
                for kind in ("p", self.open[-1]):
                    if tag in CLOSED_BY.get(kind, ()) and kind in self.open and not (kind == "p" and self._fenced("p")):
                        self._pop_to(kind)
                        break
        self.tags += 1
        self.open.append(tag)
        depth = len(self.open)
        self.links += tag == "a"
        if tag in DROPPED or attrs and self._hidden(tag, attrs):
            self.drops.append(depth)
            return
        beside, never = self._beside(attrs) if attrs and tag not in KEPT else (False, False)
        if beside or tag == "form" or tag == "header" and not self.named.open:
            self.flush()
            self.asides.begin(depth)
            self.never.append(never)
            self.aside_named.append(self._outermost())
        if tag in NAMED:
            self.named.begin(depth)
        if tag in NAMED or tag in ("div", "section", "body"):
            self.sections.begin(depth)
        if tag in ("div", "section", "ul", "ol", "table", "header"):
            self.blocks.begin(depth)

    def _fenced(self, tag: str) -> bool:
        """A table cell or the like lies between the innermost open element and the last open ``tag``."""
        for x in reversed(self.open):
            if x == tag:
                return False
            if x in ("td", "th", "table", "button", "object"):
                return True
        return True

    @staticmethod
    def _beside(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether a class, id or role names a part beside the article, and one that is hardly ever the article."""
        names = [one for name, value in attrs if name in ("class", "id", "role") and value for one in value.split()]
        beside = never = False
        for one in names:
            parts = {part.lower() for part in NAME_PARTS.split(one) if part}
            if parts <= BESIDE | NEVER | NEUTRAL and parts & (BESIDE | NEVER) and not ("header" in parts and parts & OWN_HEADER):
                beside, never = True, never or bool(parts & NEVER)
        return beside, never

    @staticmethod
    def _hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        return tag not in ("html", "body") and any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and INVISIBLE.search(value) for name, value in attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in self.open:
            self._pop_to(tag)

    def _pop_to(self, tag: str) -> None:
        while self.open:
            depth, last = len(self.open), self.open.pop()
            self.links -= last == "a"
            if self.drops and self.drops[-1] == depth:
                self.parts, self.tags, self.linked = [], 0, 0
                self.drops.pop()
            if any(x.open and x.open[-1][0] == depth for x in (self.asides, self.named, self.sections, self.blocks)):
                self.flush()
                for x in (self.asides, self.named, self.sections, self.blocks):
                    x.end(depth)
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.drops:
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; at the ends the line's own side counts more."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[inside] / np.convolve(np.ones(len(ratio)), kernel)[inside]


def _around(sections: Iterable[int], outer: list[int]) -> int:
    """The innermost section that holds all of ``sections``."""
    found, *rest = set(sections)
    for x in rest:
        while x != found:
            if x > found:
                x = outer[x]
            else:
                found = outer[found]
    return found


def _clustered(lines: list[Line]) -> tuple[list[bool], list[bool]]:
    """For each line whether its smoothed ratio of text to tags reaches the page's own spread, and whether it is dense:
    its own ratio stands out too (by the spread of the unsmoothed ratios, or DENSE where that is more), so it is in a
    cluster not by its neighbours alone."""
    own = np.array([len(x.text) / max(1, x.tags) for x in lines])
    ratio = smoothed(own)
    least = min(ratio.max(), max(ratio.std(), 1e-9))
    return (ratio >= least).tolist(), ((ratio >= least) & (own >= max(least, min(own.std(), DENSE)))).tolist()


def _without_asides(parser: _Lines) -> list[Line]:
    """The lines that neither a form nor a header nor a name puts beside the article. An element that holds most of the
    page's clustered text is no such part, unless it lies outside of an article or main that holds clustered text."""
    lines = parser.lines
    if len(parser.never) == 1 or not lines:
        return lines
    clustered, _ = _clustered(lines)
    own, named_text = [0] * len(parser.never), False
    for x, inside in zip(lines, clustered, strict=True):
        own[x.aside] += len(x.text) * inside
        named_text |= inside and x.named > 0 and not x.aside
    mass = parser.asides.summed(own)
    dropped = [False] * len(mass)
    for i in range(1, len(dropped)):
        share = 0.9 if parser.never[i] else 0.5
        content = mass[i] > share * mass[0] and (parser.aside_named[i] or not named_text)
        dropped[i] = dropped[parser.asides.outer[i]] or not content
    return [x for x in lines if not dropped[x.aside]]


def _within(root: int, outer: list[int]) -> list[bool]:
    out = [False] * len(outer)
    for i, around in enumerate(outer):
        out[i] = i == root or i > 0 and out[around]
    return out


def _region(lines: list[Line], clustered: list[bool], dense: list[bool], parser: _Lines) -> list[bool]:
    """For each line whether it lies in the content region."""
    mass = {True: 0, False: 0}
    for x, inside in zip(lines, clustered, strict=True):
        mass[x.named > 0] += len(x.text) * inside
    if mass[True] >= mass[False] and any(x.named for x in lines):
        good = {x.named for x, inside in zip(lines, clustered, strict=True) if inside and not x.linked} - {0} or {x.named for x in lines} - {0}
        return [x.named in good for x in lines]
    # lines of links and short lines that only lie near the text don't widen the section
    wide = [x.section for x, inside, own in zip(lines, clustered, dense, strict=True) if inside and not x.linked and (own or x.heading)]
    root = _around(wide or [x.section for x, inside in zip(lines, clustered, strict=True) if inside], parser.sections.outer)
    within = _within(root, parser.sections.outer)
    return [within[x.section] for x in lines]


def _menus(lines: list[Line], dense: list[bool], parser: _Lines) -> list[bool]:
    """For each block whether it, or one around it, holds links only, two or more and none of them dense."""
    every, links = [0] * len(parser.blocks.outer), [0] * len(parser.blocks.outer)
    for x, own in zip(lines, dense, strict=True):
        every[x.block] += 1
        links[x.block] += x.linked and not own
    every, links = parser.blocks.summed(every), parser.blocks.summed(links)
    out = [False] * len(every)
    for i in range(1, len(out)):
        out[i] = out[parser.blocks.outer[i]] or every[i] == links[i] >= 2
    return out


def extract(html: str) -> str:
    """Main text of one page, blocks in page order joined by a newline; empty if there is none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = _without_asides(parser)
    if not lines:
        return ""
    clustered, dense = _clustered(lines)
    kept = _region(lines, clustered, dense, parser)
    menus = _menus(lines, dense, parser)
    found = [x.text for x, keep in zip(lines, kept, strict=True) if keep and not menus[x.block]]
    return "\n".join(found or [x.text for x, keep in zip(lines, kept, strict=True) if keep])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text, n_chars) for each row of pages; n_chars counts code points.

    Null and empty html give the empty text and 0; null ids and kept columns stay null; repeated rows give repeated
    rows; other columns are not read; an empty table gives an empty table.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), *keep, F.col(html_col).alias("html"))
    names = [c for c in rows.columns if c != "html"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            out = [extract(x) for x in texts(b.column("html"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
