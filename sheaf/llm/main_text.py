"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing and threshold clustering.

The standard library's streaming parser yields events; block elements and line breaks end a line. Each line has its
characters of text over the tags that came with it. Ratios are smoothed along the page with a Gaussian kernel, lines
above a share of the mean form clusters. A cluster in an article or main element selects all of that element's lines,
however short. On pages without such a cluster the lines of clusters are selected, and those between two of them with no
boilerplate in between. Links in succession with nothing else are a link list: they do not count in the mean, and outside
articles those below its share are never selected, even beside a cluster. Text in elements that are boilerplate by their
name, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms, comments, teasers) has ratio 0 and is never
selected. A class token with a word for a layout ("with-sidebar", "no-sidebar") says nothing. An article or main element inside an
element that is shut for a name alone is text again, unless the name is for adverts, teasers or comments. Names inside a sentence
are ignored. Scripts, styles and the like are no text.

Defined results: null and empty pages, and pages without text, give an empty text. Unclosed elements end with the
element around them or the page. White space inside a line becomes one space. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
SIGMA = 1.5
RADIUS = 4
#: A line belongs to a cluster with this share of the geometric mean of smoothed ratios of lines that have any and are no link list.
SHARE = 0.5

# HTML element names by what they mean here.
KEPT, LAYOUT, SHUT, UNREAD = range(4)  # text, boilerplate unless an article opens in it, boilerplate, no text at all
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var del".split())
NO_TEXT = frozenset("head script style noscript template svg math canvas iframe object audio video select option datalist button textarea".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
ROOTS = frozenset("article main".split())
CLOSED_BY_BLOCK = frozenset("p li dt dd tr td th option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
# Of class and id names: words for boilerplate, those of them that rule even an article out, and words that say something of a
# layout and nothing of what the element itself is.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies respond disqus "
    "skip pagination pager toolbar copyright disclaimer teaser teasers".split()
)
NEVER = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion related recommended comment comments reply replies respond disqus teaser teasers".split())
LAYOUTS = frozenset("with without has no not hide show layout".split())


Line = tuple[str, int, bool, int, int]


def _named(attrs: list[tuple[str, str | None]], in_root: bool) -> int:
    """What an element is by its attributes: KEPT, LAYOUT or SHUT. Class tokens are taken whole."""
    found = KEPT
    for name, value in attrs:
        if name in ("class", "id") and value:
            for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                words = set(re.findall(r"[a-z]+", token))
                if LAYOUTS & words or in_root and words & {"header", "masthead"}:
                    continue
                found = max(found, SHUT if NEVER & words else LAYOUT if NAMES & words else KEPT)
        if name == "role" and (value or "").strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return SHUT
    return found


class Lines(HTMLParser):
    """Collects (text, tags, excluded, root, links if it has no other words) of each line as events arrive."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # structural elements: name, excluded, root's number
        self.lines: list[Line] = []
        self.held: list[str] = []
        self.tags = self.roots = self.links = 0
        self.linked = self.other = False

    def _state(self) -> tuple[int, int]:
        return self.open[-1][1:] if self.open else (KEPT, 0)

    def end_line(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            excluded, root = self._state()
            self.lines.append((text, self.tags, excluded != KEPT, root, 0 if self.other else self.links))
            self.tags = 0
        self.held, self.links, self.other = [], 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "a":
            self.linked = any(name == "href" for name, _ in attrs)
        state, root = self._state()
        named = _named(attrs, root > 0)
        # A name on a part of a sentence, or on words in an article, does not make them boilerplate.
        if tag in INLINE and (named == KEPT or not self._hidden(attrs) and (root or "".join(self.held).strip())):
            return
        if tag in ("td", "th"):
            self.held.append(" ")
            return
        self.end_line()
        if tag in VOID:
            return
        if tag == "body":
            self._close("head")
        if tag in CLOSED_BY_BLOCK and self.open and self.open[-1][0] == tag:
            self._close(tag)
        excluded, root = self._state()
        if tag in NO_TEXT:
            excluded = UNREAD
        elif tag in ROOTS:
            if excluded <= LAYOUT:
                excluded = SHUT if named == SHUT else KEPT
                if not root and not excluded:
                    self.roots += 1
                    root = self.roots
        elif excluded <= LAYOUT:
            if tag in BOILERPLATE or tag == "header" and not root:
                excluded = SHUT
            elif tag not in ("html", "body"):
                excluded = max(excluded, named)
        self.open.append((tag, excluded, root))

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return _named([x for x in attrs if x[0] not in ("class", "id")], False) != KEPT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.linked = False
        if tag in INLINE and not any(name == tag for name, _, _ in self.open) or tag in ("td", "th", "br"):
            return
        self.end_line()
        self._close(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if tag in CLOSED_BY_BLOCK and self.open[i][0] not in CLOSED_BY_BLOCK and self.open[i][0] not in INLINE:
                return  # a stray end tag of a line does not close what is around it

    def handle_data(self, data: str) -> None:
        if self._state()[0] == UNREAD:
            return
        self.held.append(data)
        if any(x.isalnum() for x in data):
            self.links += self.linked
            self.other = self.other or not self.linked

    def finish(self, html: str) -> list[Line]:
        for at in range(0, len(html), CHUNK):
            self.feed(html[at : at + CHUNK])
        if self.rawdata.startswith("<!--"):  # an unclosed comment lasts to the end
            self.rawdata = ""
        self.close()
        self.end_line()
        return self.lines


def smoothed(ratio: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(ratio, RADIUS, mode="edge"), kernel / kernel.sum(), mode="valid")


def link_lists(lines: list[Line]) -> np.ndarray:
    """Which lines are of runs of lines with links only, two links or more in a run."""
    out = np.zeros(len(lines), dtype=bool)
    at = 0
    for (only, shut), run in groupby(lines, key=lambda x: (x[4] > 0, x[2])):
        links = [x[4] for x in run]
        out[at : at + len(links)] = only and not shut and sum(links) > 1
        at += len(links)
    return out


def selected(lines: list[Line]) -> list[int]:
    """Indexes of the lines in selected regions."""
    ratio = np.array([0 if x[2] else len(x[0]) / max(1, x[1]) for x in lines], dtype=np.float64)
    if not ratio.any():
        return []
    level, lists = smoothed(ratio), link_lists(lines)
    counted = (ratio > 0) & ~lists
    # In proportion, as ratios spread widely: one very long line must not part other text from its cluster.
    least = SHARE * np.exp(np.log(level[counted if counted.any() else ratio > 0]).mean())
    own = (level >= least) & (ratio > 0)
    if not own.any():
        own = ratio == ratio.max()
    roots = {lines[i][3] for i in np.flatnonzero(own)} - {0}
    if roots:
        return [i for i, x in enumerate(lines) if x[3] in roots and not x[2]]
    # No article: clusters, and what lies between two of them without boilerplate.
    lists &= ratio < least
    own = own & ~lists | (ratio == ratio.max())
    walls = np.cumsum([x[2] for x in lines])
    picked = np.flatnonzero(own)
    out = [int(picked[0])]
    for i in picked[1:].tolist():
        if walls[out[-1]] == walls[i]:
            out += [k for k in range(out[-1] + 1, i) if not lists[k]]
        out.append(i)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines = Lines().finish(html)
    return "\n".join(lines[i][0] for i in selected(lines))


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and the main text."""
    rows = pages.select(*keep, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, rows.drop("__html").schema.add("text", "string"))
