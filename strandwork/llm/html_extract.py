"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines: the text of one block element between two block
boundaries, with the tags met in it and how much of the text stands in links. A line's ratio is log(1 + characters
outside links per tag); page furniture (navigation, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles, readers' comments), told by element, role or class and id words, has ratio 0 and is never text. Ratios are
smoothed with a Gaussian over neighbouring lines and compared with a fraction of their standard deviation:

- a line below the threshold is rejected; lines in a row that are all link text are one cluster with their mean ratio, so
  a list of links goes and a link between paragraphs stays;
- the lines of one innermost article, main or body are a region, and a region's weight is the text of its lines above
  the threshold, doubled in article and main; regions clearly lighter than the heaviest (teasers, loose text around an
  article) are rejected.

Class and id words that also occur on an article's own text (warning, notice, side, share ...) count only on
containers outside article and main, or on sections inside. A header inside article or main is the article's own.

Defined cases: null and empty pages, and pages without content, give the empty string; unclosed elements end where
the enclosing block ends; text before any element counts as body; unknown declarations and marked sections are
comments; repeated rows give equal texts; page_id and url pass through, other columns are left behind.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
FRACTION = 0.25
SHARE = 0.3
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_LANDMARK = frozenset(("article", "main"))
_FURNITURE = frozenset("aside button canvas datalist dialog footer form head iframe input label map menu meter nav noscript object option output progress script search select style svg template textarea title video audio".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "paywall popup promo promotion promoted sidebar signup sponsor sponsored subscribe subscription".split()
)
_CONTAINER_WORDS = frozenset("foot header notice notices related recommended reply replies respond share sharing side skip social toolbar warning widget".split())
_CONTAINERS = frozenset("aside details dialog div dl fieldset ol section table ul".split())
_SECTIONS = frozenset("notice notices related recommended reply replies respond share sharing social toolbar widget".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_P_ENDS = _BLOCK - frozenset(("html", "head", "body", "td", "th", "li", "dd", "dt"))
_SPACE = re.compile(r"\s+")


def _furniture(tag: str, attrs: list, inside: bool) -> bool:
    """Whether an element is page furniture; inside: within an article or main."""
    if tag in _FURNITURE or (tag == "header" and not inside):
        return True
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and _HIDDEN.search(value):
            return True
        if name == "role" and value and value.strip().lower() in _ROLES:
            return True
        if name in ("class", "id") and value and tag not in ("html", "body", "article", "main"):
            words = set(_SPLIT.split(_CAMEL.sub("-", value).lower()))
            if not words.isdisjoint(_WORDS):
                return True
            if tag in _CONTAINERS and not words.isdisjoint(_SECTIONS if inside else _CONTAINER_WORDS):
                return True
            if tag == "p" and not inside and not words.isdisjoint(("notice", "notices")):
                return True
    return False


class Line:
    """Text of a block between two boundaries; linked: characters in links; region: number of its article, main or body."""

    __slots__ = ("bad", "linked", "region", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, bad: bool, region: int):
        self.text, self.tags, self.linked, self.bad, self.region = text, tags, linked, bad, region

    def plain(self) -> int:
        return 0 if self.bad else max(0, len(self.text) - self.linked)


class _Lines(HTMLParser):
    """Lines of a page; landmark[r] tells whether region r is an article or main."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Open elements: tag, furniture from here on, whether that began at a block, region, in a link, in a heading.
        self.stack: list[tuple[str, bool, bool, int, bool, bool]] = []
        self.open: dict[str, list[int]] = {}  # places of each tag in the stack
        self.containers: list[int] = []
        self.landmark, self.parts, self.tags, self.linked = [False], [], 0, 0
        self.bad = self.at_block = self.link = self.heading = False
        self.region = 0

    def _end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(Line(text, self.tags, self.linked, self.bad, self.region))
            self.parts = []
        self.tags = self.linked = 0

    def _state(self) -> None:
        _, self.bad, self.at_block, self.region, self.link, self.heading = self.stack[-1] if self.stack else ("", False, False, 0, False, False)

    def _pop_to(self, i: int) -> None:
        if any(x[0] in _BLOCK for x in self.stack[i:]):
            self._end_line()
        while len(self.stack) > i:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if self.containers and self.containers[-1] == len(self.stack):
                self.containers.pop()
        self._state()

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._end_line()
            if tag in _P_ENDS or tag in ("li", "dd", "dt"):
                for i in range(len(self.stack) - 1, -1, -1):
                    t = self.stack[i][0]
                    if t == "p" or (t == tag and tag in ("li", "dd", "dt")):
                        self._pop_to(i)
                        break
                    if t in _BLOCK:
                        break
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        region = self.region
        inside = self.landmark[region]
        if tag in _LANDMARK:
            self.landmark.append(True)
            region = len(self.landmark) - 1
        here = not self.bad and _furniture(tag, attrs, inside)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in ("article", "main", "body", "table"):
            self.containers.append(len(self.stack))
        self.stack.append((tag, self.bad or here, tag in _BLOCK if here else self.at_block, region, self.link or tag == "a", self.heading or tag in _HEADING))
        self._state()

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
        places = self.open.get(tag)
        # An inline end tag does not close a container.
        if places and (tag in _BLOCK or not self.containers or places[-1] > self.containers[-1]):
            self._pop_to(places[-1])
        self.tags += 1

    def handle_data(self, data):
        if self.bad and not self.at_block:
            return  # furniture inside a line
        self.parts.append(data)
        if self.link and not self.heading:
            self.linked += len(data.strip())

    def parse_html_declaration(self, i):
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def updatepos(self, i, j):
        """Line numbers are not used."""
        return j

    def finish(self) -> None:
        self.close()
        self._end_line()


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """x under a normalised Gaussian of two standard deviations each way, with zeros beyond the ends."""
    half = max(1, math.ceil(2 * sigma))
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, half), k / k.sum(), "valid")


def _clusters(lines: list[Line], level: np.ndarray) -> np.ndarray:
    """level, where lines in a row that are all link text share their mean."""
    out, i = level.copy(), 0
    while i < len(lines):
        j = i
        while j < len(lines) and not lines[j].bad and lines[j].plain() == 0 and lines[j].region == lines[i].region:
            j += 1
        if j > i:
            out[i:j] = level[i:j].mean()
        i = max(j, i + 1)
    return out


def parsed(html: str) -> tuple[list[Line], list[bool]]:
    """The lines of a page and which regions are an article or main."""
    p = _Lines()
    p.feed(html)
    p.finish()
    return p.lines, p.landmark


def selected(lines: list[Line], landmark: list[bool], sigma: float = SIGMA, fraction: float = FRACTION, share: float = SHARE) -> list[bool]:
    """Which lines are main text."""
    if not lines:
        return []
    level = smooth(np.array([math.log1p(x.plain() / max(1, x.tags)) for x in lines]), sigma)
    clustered = _clusters(lines, level)
    passed = (clustered >= fraction * level.std()) & (clustered > 0)
    weight = [0.0] * len(landmark)
    for x, ok in zip(lines, passed):
        if ok:
            weight[x.region] += x.plain() * (2 if landmark[x.region] else 1)
    least = share * max(weight)
    return [bool(ok) and not x.bad and weight[x.region] > 0 and weight[x.region] >= least for x, ok in zip(lines, passed)]


def extract(html: str | None, sigma: float = SIGMA, fraction: float = FRACTION, share: float = SHARE) -> str:
    """The main text: its blocks joined by one newline."""
    if not html:
        return ""
    lines, landmark = parsed(html)
    return "\n".join(x.text for x, ok in zip(lines, selected(lines, landmark, sigma, fraction, share)) if ok)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text per page."""
    names = ["page_id", "url", "text"]

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=names)

    picked = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string")
