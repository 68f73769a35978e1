"""Main text of HTML pages: text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's parser streams events; a page is never held as a tree. A line is what a browser would set as
one block: text between starts and ends of block elements. Each line has its text's length, its number of tags and how
much of its text is inside links. Lines in navigation, headers, footers, forms, scripts and hidden elements are left
out as they stream, told by element, role and style.

Words of class and id that speak of adverts, notices, sidebars or comments are hints, weighed when the page's text is
known. A name is whole if all its words are such ones ("cookie-notice") and mixed if others are among them
("has-sidebar", "related-work"). An element goes if most of its text is in links, or if it is short and its name is
whole, or mixed and outside articles. A heading saves a short element inside an article, or of a mixed name. Hints never touch article, main and headings, nor an element
that holds more than half of the page's text, unless that is short, the name whole and an article elsewhere.

The ratios of the remaining lines are smoothed with a Gaussian kernel, over neighbours in the same container (the
outermost article or main; what lies outside them is one too), and all lines of the page are clustered against one
threshold. A line is content if its level reaches the threshold and less than half of it is links. The container is a
prior: inside one a PRIOR-th of the threshold is enough, in long elements whose whole name hints at adverts, notices or
comments it takes PRIOR times the threshold. A container with content gives its other lines too, so that short
paragraphs and headings stay, but for runs of links, which no smoothing lifts. Outside containers the regions of content
lines are taken, with the gaps inside a region. A heading at most three lines before a line that is taken comes with it.

Defined results: null html counts as empty; a page without content gives an empty text; unclosed and misnested tags
are closed as browsers roughly do; whole pages are parsed whatever their length; repeated rows are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul caption legend".split()
)
SKIP = frozenset(
    "script style noscript template head title nav footer header aside form button select textarea svg math canvas iframe object audio video map menu dialog search fieldset datalist".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head; anything else ends one that was not closed.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
#: Closed by the start of another block: a paragraph, or an item by the next item.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINER = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: Words of class and id that hint at what is not the article.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promotions cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail widget widgets footer masthead topbar toolbar comment comments disqus respond reply replies discussion "
    "related recommended recommendations share sharing social newsletter subscribe subscription signup login pagination pager skip copyright legal disclaimer teaser outbrain taboola".split()
)
#: Words of layout, which leave a name whole.
NEUTRAL = frozenset("area bar block bottom box button buttons container group inner item items left links list outer panel right section slot top unit wrap wrapper".split())
#: Elements that hints do not touch.
UNHINTED = frozenset(("html", "body")) | CONTAINER | HEADING
#: Characters outside links up to which a hinted element is short.
SHORT = 200
#: Of these a page's own header inside the article is meant, which may hold its title.
KEPT_IN_ARTICLE = frozenset(("header", "hgroup"))
_WORDS = re.compile(r"[a-z]+")
SIGMA, RADIUS = 1.0, 2
#: How much the threshold gives way inside containers, and rises in doubtful elements.
PRIOR = 4.0


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    container: int
    heading: bool
    hinted: bool = False


@dataclass
class Hint:
    """An element whose class or id hints that it is not the article, and its text with that of the hinted ones in it."""

    parent: int
    whole: bool
    inside: bool
    heading: bool = False
    article: bool = False
    chars: int = 0
    linked: int = 0


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.raw: list[tuple] = []  # parts, container, heading
        self.parts: list[tuple[str, bool, int, int]] = []  # text, in a link, hint, tags before it
        self.tags = 0
        self.heading = False
        self.open: list[tuple[str, bool, int, int]] = []  # element, unwanted, container and hint before it
        self.unwanted = self.links = 0
        self.container, self.containers = 0, 1
        self.hint, self.hints = 0, [Hint(0, False, False)]  # the first is the whole page

    def flush(self) -> None:
        if any(data and not data.isspace() for data, *_ in self.parts):
            self.raw.append((self.parts, self.container, self.heading))
        elif self.parts:
            self.tags += sum(p[3] for p in self.parts)
        self.parts, self.heading = [], False

    def lines(self) -> list[Line]:
        """The lines outside elements that go by their hints."""
        hints = self.hints
        for parts, container, heading in self.raw:
            for data, linked, hint, _ in parts:
                h, n = hints[hint], len(data.strip())
                h.heading |= heading
                h.article |= container > 0
                h.chars += n
                h.linked += n * linked
        for h in reversed(hints[1:]):
            up = hints[h.parent]
            up.heading |= h.heading
            up.article |= h.article
            up.chars += h.chars
            up.linked += h.linked
        total = hints[0].chars - hints[0].linked
        gone, doubtful = [False] * len(hints), [False] * len(hints)
        for k, h in enumerate(hints[1:], 1):
            own = h.chars - h.linked
            gone[k], doubtful[k] = gone[h.parent], doubtful[h.parent]
            if 2 * own > total and (h.article or not hints[0].article or not h.whole or own > SHORT):
                continue
            if 2 * h.linked > h.chars or own <= SHORT and (h.whole or not h.inside) and not (h.heading and (h.inside or not h.whole)):
                gone[k] = True
            doubtful[k] |= h.whole and not h.inside
        out, tags = [], 0
        for parts, container, heading in self.raw:
            kept = [p for p in parts if not gone[p[2]]]
            text = " ".join("".join(p[0] for p in kept).split())
            tags += sum(p[3] for p in kept)
            if text:
                doubt = all(doubtful[p[2]] for p in kept)
                out.append(Line(text, tags, sum(len(p[0]) for p in kept if p[1]), 0 if doubt else container, heading, doubt))
                tags = 0
        return out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open and (tag == "body" or tag not in IN_HEAD and self.open[-1][0] == "head"):
            self._end_head()
        if not self.unwanted:
            self.tags += 1
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self._add(" ", False)
                if tag == "hr":
                    self.flush()
            return
        if tag in BLOCK:
            self.flush()
            for k in range(len(self.open) - 1, -1, -1):  # a p ends here, with the inline elements that are open inside it
                if self.open[k][0] == "p":
                    self._close(k)
                    break
                if self.open[k][0] in BLOCK or self.open[k][0] in SKIP:
                    break
            for k in range(len(self.open) - 1, max(-1, len(self.open) - 4), -1):
                if self.open[k][0] in CLOSES.get(tag, ()):
                    self._close(k)
                    break
                if self.open[k][0] in ("ul", "ol", "table", "dl", "div"):
                    break
        bad = tag in SKIP and not (tag in KEPT_IN_ARTICLE and self.container)
        hinted = whole = False
        for name, value in attrs:
            if value and not bad:
                if name in ("class", "id"):
                    for words in map(_WORDS.findall, value.lower().split() if tag not in UNHINTED else ()):
                        if not UNWANTED.isdisjoint(words):
                            hinted = True
                            whole |= all(w in UNWANTED or w in NEUTRAL for w in words)
                elif name == "role":
                    bad = value.strip().lower() in ROLES
                elif name == "style":
                    bad = "display:none" in value.replace(" ", "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                bad = True
        self.open.append((tag, bad, self.container, self.hint))
        self.unwanted += bad
        self.links += tag == "a"
        if hinted and not self.unwanted:
            self.hints.append(Hint(self.hint, whole, self.container > 0))
            self.hint = len(self.hints) - 1
        if tag in CONTAINER and not self.unwanted and not self.container:
            self.container, self.containers = self.containers, self.containers + 1
        if tag in HEADING:
            self.heading = True

    def _close(self, k: int) -> None:
        self.flush()
        while len(self.open) > k:
            tag, bad, container, hint = self.open.pop()
            self.unwanted -= bad
            self.links -= tag == "a"
            self.container, self.hint = container, hint

    def _add(self, data: str, linked: bool) -> None:
        self.parts.append((data, linked, self.hint, self.tags))
        self.tags = 0

    def _end_head(self) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "head":
                return self._close(k)
            if self.open[k][0] == "body":
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.unwanted:
            self.tags += 1
        if tag in VOID:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in BLOCK or self.open[k][1] or any(t in BLOCK or bad for t, bad, *_ in self.open[k:]):
                    if tag in BLOCK or tag in SKIP:
                        self._close(k)
                    else:  # an inline element that ends after blocks began inside it
                        t, bad, _, hint = self.open.pop(k)
                        own = self.open[k][3] if k < len(self.open) else self.hint
                        self.hint = hint if self.hint == own else self.hint
                        self.open[k:] = [(*x[:3], hint if x[3] == own else x[3]) for x in self.open[k:]]
                        self.unwanted -= bad
                        self.links -= t == "a"
                else:
                    for t, *_ in self.open[k:]:
                        self.links -= t == "a"
                    self.hint = self.open[k][3]
                    del self.open[k:]
                return
            if self.open[k][0] in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                return  # an end without a start inside the container

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._end_head()
        if not self.unwanted:
            self._add(data, self.links > 0)


def lines(html: str) -> list[Line]:
    """The page's lines outside unwanted elements, in order."""
    p = _Lines()
    p.feed(html)
    p.close()
    p.flush()
    return p.lines()


def ratios(rows: list[Line]) -> np.ndarray:
    """Characters of text per tag of each line; text in links does not count."""
    return np.array([max(0, len(r.text) - r.linked) / max(1, r.tags) for r in rows], float)


def smooth(x: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing whose kernel is renormalised at the ends."""
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    n = len(x)
    return np.convolve(x, k)[radius : radius + n] / np.convolve(np.ones(n), k)[radius : radius + n]


def select(rows: list[Line]) -> list[Line]:
    """The content's lines."""
    if not rows:
        return []
    by: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        by.setdefault(r.container, []).append(k)
    level = np.zeros(len(rows))
    raw = ratios(rows)
    for at in by.values():
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            level[run] = smooth(raw[run])
    threshold = max(min(float(level.std()), float(level.mean())), 1e-9)
    prior = np.array([PRIOR if r.container else 1 / PRIOR if r.hinted else 1.0 for r in rows])
    links = np.array([r.linked > 0.5 * len(r.text) for r in rows])
    content = (level * prior >= threshold) & ~links
    keep = content.copy()
    for c, at in by.items():
        if c and content[at].any():
            keep[at] = ~links[at] | (level[at] >= threshold)
    if not keep.any() and any(by):  # only links: the container with the most text
        keep[by[max((c for c in by if c), key=lambda c: (sum(len(rows[k].text) for k in by[c]), -c))]] = True
    edges = np.flatnonzero(keep)
    for a, b in zip(edges[:-1], edges[1:], strict=True):  # gaps of a region
        if 1 < b - a <= 3 and not any(links[k] or rows[k].container or rows[k].hinted for k in (*range(a, b), b)):
            keep[a + 1 : b] = True
    for k in range(len(rows) - 2, -1, -1):
        if rows[k].heading and not rows[k].linked:  # with the lead between it and the text
            for j in range(k + 1, min(k + 4, len(rows))):
                if keep[j]:
                    keep[k:j] = True
                    break
                if links[j] or rows[j].hinted:
                    break
    return [r for k, r in enumerate(rows) if keep[k]]


def main_text(html: str | None) -> str:
    return "\n".join(r.text for r in select(lines(html or "")))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, one row per row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    rows = df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
