"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's parser streams events; block elements cut the page into lines. Each line has
a ratio of its characters (those in links don't count) to its tags. Ratios are smoothed with a
Gaussian kernel along the page and split in two clusters at a threshold that moves to the middle of
the clusters' means until it rests. The upper cluster marks the content; elements that are
boilerplate by their meaning (navigation, headers, footers, asides, forms) never count. Names only
break ties: a line in a wrapper whose class or id sounds like a menu or comments counts when hardly
anything else is left. An article or main element that holds most of the marked text is
the content region; otherwise it is the marked lines, those between them, and those next to them in
the same parent. In the region, lines that are lists of links and in the lower cluster are left out,
whatever they are named. Names of generic wrappers around article and main elements don't count as
such; those in more named wrappers than others are boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Characters that a title alone doesn't have; links that make a list of links.
TITLE, LIST = 100, 3
#: Elements that begin a line; that hold no prose; that are boilerplate; that are void.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("head title script style noscript template iframe object svg math audio video canvas select option textarea button".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = re.compile(r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bno[_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|respond|replies|cookies?|consent|gdpr|disclaimer|notice|footer|header|masthead|menu|nav\w*|newsletter|subscribe|popup|modal|promo\w*|related|recommend\w*|share|sharing|social|sidebar|sponsor\w*|widget|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
CLOSES_P = BLOCKS - {"html", "body"}
IN_HEAD = frozenset("base basefont bgsound head html link meta title noscript noframes style script template".split())


class Lines(HTMLParser):
    """Collects the lines of one page: text, characters outside links, links, tags, boilerplate, region.

    Every event takes constant time on average: elements by name and open blocks are counted, never
    searched for.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, bool, int, int, int]] = []
        self.stack: list[tuple[str, bool, bool, int, int, bool, int, int]] = []  # tag, silent, boilerplate, region, named wrappers around it, boilerplate by more than a name, named wrappers, number
        self.open: Counter[str] = Counter()
        self.blocks: list[int] = []  # where blocks lie on the stack
        self.head = -1  # where the outermost open head lies
        self.parts: list[str] = []
        self.plain = self.tags = self.linked = self.regions = self.elements = 0

    def parse_html_declaration(self, i: int) -> int:
        """Comments as ever; every other declaration or marked section is a bogus comment up to the next ">"."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        if self.rawdata.startswith("<!") and self.cdata_elem is None:  # never ended: a comment up to the page's end
            self.rawdata = ""
        super().close()
        self.cut()

    def _top(self) -> tuple[bool, bool, int, int, bool, int]:
        return self.stack[-1][1:7] if self.stack else (False, False, 0, 0, False, 0)

    def _pop_to(self, at: int) -> None:
        for x in self.stack[at:]:
            self.open[x[0]] -= 1
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        if self.head >= at:
            self.head = -1

    def _leave_head(self, tag: str | None) -> None:
        """Closes a head whose end tag is left out, before an element or text that it can't hold."""
        if tag in IN_HEAD or self.head < 0:
            return
        if len(self.stack) == self.head + 1 or (tag in BLOCKS and not self.open["template"]):
            self.parts, self.plain = [], 0
            self._pop_to(self.head)

    def cut(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            _, boilerplate, region, level, firm, _ = self._top()
            parent = self.stack[self.blocks[-2]][7] if len(self.blocks) > 1 else 0  # what holds the innermost line-making element
            self.lines.append((text, self.plain, self.linked, self.tags, boilerplate, firm, region, level, parent))
            self.tags = 0
        self.parts, self.plain, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        self._leave_head(tag)
        if tag in BLOCKS:
            self.cut()
            if tag in CLOSES_P and self.blocks and self.stack[self.blocks[-1]][0] == "p":
                self._pop_to(self.blocks[-1])
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        silent, boilerplate, region, level, firm, named = self._top()
        names = " ".join(v for k, v in attrs if v and k in ("class", "id"))
        role = next((v for k, v in attrs if k == "role"), None)
        if tag in ("article", "main"):
            if not region or (boilerplate and not firm):  # inside a wrapper of another region it is a region of its own
                self.regions += 1
                region = self.regions
                level = named
            boilerplate = firm
        elif tag not in ("html", "body"):
            firm |= tag in BOILERPLATE or role in ROLES
            marked = bool(names and MARKED.search(names))
            boilerplate |= firm or marked
            named += marked
        self.linked += tag == "a"
        self.elements += 1
        self.open[tag] += 1
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        if tag == "head" and self.head < 0:
            self.head = len(self.stack)
        self.stack.append((tag, silent or tag in SILENT or any(k == "hidden" for k, _ in attrs), boilerplate, region, level, firm, named, self.elements))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._leave_head(None)
        if not self._top()[0]:
            self.parts.append(data)
            self.plain += 0 if self.open["a"] else len(data)


def _threshold(x: np.ndarray) -> float:
    """The value midway between the means of those below and above it."""
    t = float(x.mean())
    for _ in range(50):
        low, high = x[x < t], x[x >= t]
        if not len(low) or not len(high):
            return t
        nearer = (low.mean() + high.mean()) / 2
        if abs(nearer - t) < 1e-6:
            break
        t = float(nearer)
    return t


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """x under a Gaussian kernel, renormalised at the ends."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(x, kernel)[reach : reach + len(x)]
    return whole / np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]


def _link_lists(sizes: np.ndarray, plain: np.ndarray, linked: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Lines that are mostly links and, with such neighbours in the same parent, have LIST links or more."""
    only = (linked > 0) & (2 * plain < sizes)
    run = np.cumsum(np.append(True, (parent[1:] != parent[:-1]) | (only[1:] != only[:-1]))) - 1
    return only & (np.bincount(run, weights=linked * only)[run] >= LIST)


def main_text(html: str | None) -> str:
    """The main text of one page; empty if it has none."""
    page = Lines()
    page.feed(html or "")
    page.close()
    if not page.lines:
        return ""
    texts, *features = zip(*page.lines, strict=True)
    plain, linked, tags, boilerplate, firm, region, level, parent = map(np.array, features)
    sizes = np.array([len(t) for t in texts])
    own = np.log1p(plain / np.maximum(tags, 1))
    ratio = smoothed(own)
    dense = np.maximum(ratio, own) >= _threshold(ratio)  # a dense line at a region's edge counts by its own ratio
    own_region = (region > 0) & ~boilerplate
    if own_region.any():
        size = np.bincount(level, weights=sizes * own_region)  # more than a title counts
        least = np.flatnonzero((size >= TITLE) | (np.bincount(level, weights=own_region & dense) > 0))
        boilerplate |= (region > 0) & (level > (least.min() if len(least) else level[own_region].min()))
    if firm.all():
        return ""
    if (sizes * ~boilerplate).sum() < TITLE and (dense & ~firm & (own >= _threshold(own)) & (sizes >= TITLE)).any():
        boilerplate = firm  # all that is dense has a suspicious name, and hardly anything else is there: the clusters have the say
    if boilerplate.all():
        return ""
    lists = _link_lists(sizes, plain, linked, parent) & (own < _threshold(own))
    marked = dense & ~boilerplate & ~lists
    if not marked.any():
        marked = ~boilerplate
    inside = np.bincount(region, weights=sizes * marked)
    best = int(inside[1:].argmax()) + 1 if len(inside) > 1 else 0
    if best and inside[best] * 2 >= (sizes * marked).sum():
        keep = region == best
    else:
        at = np.flatnonzero(marked)
        keep = np.zeros(len(texts), bool)
        first, last = int(at[0]), int(at[-1])
        while first and parent[first - 1] == parent[first] and not (boilerplate | lists)[first - 1]:
            first -= 1
        while last + 1 < len(texts) and parent[last + 1] == parent[last] and not (boilerplate | lists)[last + 1]:
            last += 1
        keep[first : last + 1] = True
    keep &= ~boilerplate & (~lists | (marked & lists).any())
    return " ".join(t for t, k in zip(texts, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text, so does a page with nothing but boilerplate. Malformed
    html never fails. Repeated rows each give a row; an empty table gives an empty result; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
