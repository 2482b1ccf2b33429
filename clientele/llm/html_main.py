"""Main text of web pages.

Standard-library parser events, fed in pieces, are turned into lines: one per
block of text, with its number of characters outside links, the tags since the
line before, and the elements around it. The text-to-tag ratios of a page's
lines are smoothed with a Gaussian and split by threshold clustering (two
means) into content and the rest. The content lines select the regions by
their characters: the ``article`` or ``main`` elements that hold some, or the
stretch of lines outside of them from the first content line to the last if it
holds more than any of them (articles with less than half of it are teasers
then). A stretch with at least half of the articles' characters stays beside
them. A selected region gives all its lines but those of elements that never
belong to an article (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments).

One pass over the pages without a shuffle; a task holds one page's lines.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
            "tfoot th thead title tr ul".split())
ENDS_P = BLOCK - {"td", "th", "tr", "option", "optgroup", "legend", "caption", "title", "html", "body"}
NEVER = set("head script style noscript template iframe object svg math canvas audio video select button textarea input form "
            "nav footer aside menu dialog".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "main", "body", "div", "section", "nav", "aside"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
# Names in class or id that mark what is no article; whole names, as parted by anything but letters and digits.
NAMES = set("ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu submenu "
            "breadcrumb breadcrumbs sidebar rail footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup "
            "modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus replies "
            "respond related recommended recommendations pagination pager toolbar widget widgets search skip copyright legal".split())
HEADER_NAMES = {"header", "pageheader", "siteheader"}
SIGMA, PIECE = 1.0, 1 << 16
_SPLIT = re.compile(r"[^a-z0-9]+")


def _marked(tag: str, attrs: dict, in_article: bool) -> bool:
    """Whether an element's own tag or attributes say that it is no article text."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main", "article") and not {"comment", "comments"} & set(_names(attrs)):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I):
        return True
    if ROLES & set((attrs.get("role") or "").lower().split()):
        return True
    names = set(_names(attrs))
    return bool(names & NAMES) or (bool(names & HEADER_NAMES) and not in_article)


def _names(attrs: dict):
    for value in (attrs.get("class"), attrs.get("id")):
        for word in (value or "").split():
            parts = [p for p in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if p]
            # "has-sidebar", "with-menu" and "no-ads" speak of the page around, "main-content-..." of the article
            if parts and parts[0] not in ("has", "with", "no", "main", "content", "article", "post", "entry"):
                yield from parts
            elif len(parts) > 1 and parts[0] in ("article", "post", "entry", "main", "content"):
                yield from (set(parts[1:]) & {"comment", "comments", "nav", "navigation", "share", "related", "footer", "sidebar", "ads", "ad"})


class Lines(HTMLParser):
    """Blocks of a page: ``(text, characters outside links, tags, region, heading)`` of what is not marked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it or one around it is marked, number of its article
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.buffer: list[str] = []
        self.plain, self.tags, self.links, self.regions = 0, 0, 0, 0

    def _state(self) -> tuple[bool, int]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)

    def _end_line(self):
        text = " ".join("".join(self.buffer).split())
        if text:
            region = self._state()[1]
            self.lines.append((text, self.plain, self.tags, region, any(t in HEADINGS for t, _, _ in self.open[-3:])))
            self.tags = 0
        self.buffer, self.plain = [], 0

    def _pop(self, upto: int):
        while len(self.open) > upto:
            tag = self.open.pop()[0]
            if tag == "a":
                self.links = max(0, self.links - 1)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
            return
        if tag in BLOCK or tag in NEVER:
            self._end_line()
        if tag != "title" and tag in BLOCK and any(t == "head" for t, _, _ in self.open):
            self._pop(next(i for i, x in enumerate(self.open) if x[0] == "head"))  # a body without its tag
        if tag in ENDS_P:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    self._pop(i)
                    break
                if self.open[i][0] in SCOPE:
                    break
        if tag in IMPLIED_END:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in IMPLIED_END[tag]:
                    self._pop(i)
                    break
                if self.open[i][0] in SCOPE:
                    break
        if tag in VOID:
            return
        marked, region = self._state()
        marked = marked or _marked(tag, {k: v or "" for k, v in reversed(attrs)}, region > 0)
        if tag in ("article", "main") and not marked and region == 0:
            self.regions += 1
            region = self.regions
        if tag == "a":
            self.links += 1
        self.open.append((tag, marked, region))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br" and tag not in BLOCK and self.open and self.open[-1][0] == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK or tag in NEVER:
            self._end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if tag not in BLOCK and self.open[i][0] in SCOPE:
                return

    def handle_data(self, data):
        marked, region = self._state()
        if marked or (self.open and any(t == "header" for t, _, _ in self.open) and not any(t in HEADINGS for t, _, _ in self.open)):
            return
        self.buffer.append(data)
        if not self.links:
            self.plain += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Where two means part the values (as logarithms); everything is content if they hardly differ."""
    logs = np.log1p(values)
    low, high = float(logs.min()), float(logs.max())
    if high - low < 0.7:
        return -1.0
    for _ in range(30):
        cut = (low + high) / 2
        new = float(logs[logs <= cut].mean()), float(logs[logs > cut].mean())
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    page = Lines()
    for at in range(0, len(html), PIECE):
        page.feed(html[at:at + PIECE])
    page.close()
    page._end_line()
    if not page.lines:
        return ""
    ratios = np.array([plain / max(1, tags) for _, plain, tags, _, _ in page.lines])
    smoothed = smooth(ratios)
    core = smoothed > threshold(smoothed)
    region = np.array([r for *_, r, _ in page.lines])
    content = np.bincount(region, np.array([plain for _, plain, *_ in page.lines]) * core)
    if content[0] > content[1:].max(initial=0):
        chosen, outside = np.flatnonzero(2 * content >= content[0]), True
    else:
        chosen, outside = np.unique(region[core]), 2 * content[0] >= content.sum() - content[0] and content[0] > 0
    chosen = chosen[chosen > 0]
    if not len(chosen) and not outside:
        chosen = np.unique(region[region > 0])
    keep = np.isin(region, chosen)
    if outside:
        at = np.flatnonzero(region == 0)
        where = np.flatnonzero((core & (ratios > 0))[at])
        first, last = int(where[0]), int(where[-1])
        while first > 0 and page.lines[at[first - 1]][4]:  # headings right above belong to it
            first -= 1
        while last + 1 < len(at) and page.lines[at[last + 1]][1] > 0:  # so does what goes on without links
            last += 1
        keep[at[first:last + 1]] = [page.lines[i][1] > 0 for i in at[first:last + 1]]
    return "\n\n".join(line[0] for line, k in zip(page.lines, keep) if k)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page ``page_id, url, text, n_chars``.

    Defined cases: null or empty html, and pages without an article, give an
    empty text; null ids and urls stay null; rows repeated alike give equal
    rows; no rows give no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
