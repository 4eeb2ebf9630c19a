"""Main text of web pages by the density of text against markup, line by line."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dawnchorus.llm.shared import mapped

# Elements whose text is never content, or is no text at all.
SKIPPED = frozenset(
    "script style noscript template nav header footer aside form button select textarea input "
    "iframe object embed svg canvas audio video head title menu dialog datalist fieldset".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# A paragraph ends where one of these begins, as browsers have it.
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
# Containers that may be the home of an article.
HOMES = frozenset("article main section div td body html".split())
# Words in class, id or role that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside complementary footer header "
    "masthead topbar cookie cookies consent gdpr notice notices popup modal overlay dialog alert "
    "alertdialog newsletter subscribe signup login form search comment comments commentlist disqus reply "
    "replies respond discussion share sharing social related recommended recommendations widget "
    "toolbar pagination pager contentinfo hidden skip toc copyright legal disclaimer".split()
)
# What readers write is as dense as the article, so only its name can tell.
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
# What text inside an article or main element counts against a block with a furniture name.
MARKED = 4
SIGMA = 1.5


def _furnished(attributes: list[tuple[str, str | None]], names: frozenset[str] = FURNITURE) -> bool:
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            words = value.lower().replace("_", " ").replace("-", " ").split()
            if any(w in names for w in words):
                return True
    return False


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    for name, value in attributes:
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class _Lines(HTMLParser):
    """Parser events as lines: each block's text with its tags, and the container it stands in.

    Elements with a name of page furniture are numbered in order; all but the ``pardoned`` are left out.
    """

    def __init__(self, pardoned: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.homes: list[int] = []
        self.parents: list[int] = [-1]
        self.names: list[str] = [""]
        self.stack: list[tuple[str, int, bool, int]] = []
        self.pardoned = pardoned
        self.named = 0
        # Of the furniture: characters of each outermost left-out element, lines of each pardoned one.
        self.lost: dict[int, int] = {}
        self.losing = -1
        self.spans: dict[int, tuple[int, int]] = {}
        self.skipping = 0
        self.held: list[str] = []
        self.count = 0

    def home(self) -> int:
        return next((h for _, h, _, _ in reversed(self.stack) if h >= 0), 0)

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.texts.append(text)
            self.tags.append(self.count)
            self.homes.append(self.home())
        self.held.clear()
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH and any(t == "p" for t, _, _, _ in self.stack):
            self._close("p")
        if tag in BLOCKS and not self.skipping:
            self.flush()
        if tag == "br":
            self.held.append(" ")
        if tag in VOID:
            self.count += 1
            return
        own = tag not in ("html", "body", "article", "main")
        number = -1
        if own and _furnished(attrs):
            number = self.named
            self.named += 1
        skip = tag in SKIPPED or (own and _hidden(attrs)) or (number >= 0 and number not in self.pardoned)
        if (skip or number >= 0) and not self.skipping:
            self.flush()
            if not skip:
                self.spans[number] = (len(self.texts), len(self.texts))
            elif tag not in SKIPPED and not _hidden(attrs) and not _furnished(attrs, READERS):
                self.losing = number
                self.lost[number] = 0
        home = -1
        if tag in HOMES and not skip:
            home = len(self.parents)
            self.parents.append(self.home())
            self.names.append("article" if ("itemprop", "articleBody") in attrs else tag)
        self.stack.append((tag, home, skip, number))
        self.skipping += skip
        self.count += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        self._close(tag)

    def _close(self, tag: str) -> None:
        """Leave an element and whatever inside it was never closed."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                break
            # Text marks that were left open do not keep a block open; blocks hold theirs.
            if self.stack[at][0] in SKIPPED and tag not in ("body", "html"):
                if tag != self.stack[at][0]:
                    return
        else:
            return
        pardoned = [n for _, _, _, n in self.stack[at:] if n in self.spans]
        if (tag in BLOCKS or pardoned) and not self.skipping:
            self.flush()
        for number in pardoned:
            self.spans[number] = (self.spans[number][0], len(self.texts))
        for _, _, skip, _ in self.stack[at:]:
            self.skipping -= skip
        if not self.skipping:
            self.losing = -1
        del self.stack[at:]
        self.count += 1

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.held.append(data)
        elif self.losing >= 0:
            self.lost[self.losing] += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        """Marked sections are markup."""


def _smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the lines; the ends weigh only what they have."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(ratios)), kernel, "same")[: len(ratios)] if len(ratios) > 2 * reach else None
    if total is None:
        padded = np.pad(ratios, reach)
        ones = np.pad(np.ones(len(ratios)), reach)
        return np.convolve(padded, kernel, "valid") / np.convolve(ones, kernel, "valid")
    return np.convolve(ratios, kernel, "same") / total


def _two_means(values: np.ndarray) -> float:
    """Threshold between a low and a high cluster of values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        under, over = values[values <= cut], values[values > cut]
        if not len(over):
            return low - 1
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _weights(page: _Lines, sigma: float) -> np.ndarray:
    """Characters of the lines whose smoothed ratio is in the high cluster, 0 for others."""
    lengths = np.array([len(t) for t in page.texts], dtype=float)
    ratios = lengths / np.maximum(1, np.array(page.tags))
    smooth = _smoothed(ratios, sigma)
    over = smooth > _two_means(smooth)
    # Clusters whose means are within a factor of two are one: all lines are text, or none.
    if not over.any() or over.all() or 2 * smooth[~over].mean() > smooth[over].mean():
        return lengths
    return np.where(over, lengths, 0.0)


def content_lines(page: _Lines, sigma: float = SIGMA) -> list[int]:
    """Lines of the content region.

    A line's ratio is its characters over its tags. Ratios are smoothed, and two clusters of
    them set the threshold. The lines above it weigh for the containers around them; the region is the
    smallest container with over half of all that weight. Elements marked as articles, or else as main, go
    before where they hold over half of it together. All lines of the region belong, short ones too.
    """
    if not page.texts:
        return []
    weight = _weights(page, sigma)
    mass = np.zeros(len(page.parents))
    for home, w in zip(page.homes, weight, strict=True):
        at = home
        while at >= 0:
            mass[at] += w
            at = page.parents[at]
    half = mass[0] / 2
    chosen: set[int] = set()
    for name in ("article", "main"):
        marked = {i for i, n in enumerate(page.names) if n == name and mass[i] > 0}
        # Of marked elements inside one another the outermost holds all.
        outer = {i for i in marked if not _inside(page, page.parents[i], marked)}
        if sum(mass[i] for i in outer) > half:
            chosen = outer
            break
    if not chosen:
        at = 0
        while True:
            below = [i for i, p in enumerate(page.parents) if p == at and mass[i] > half]
            if not below:
                break
            at = below[0]
        chosen = {at}
    return [i for i, home in enumerate(page.homes) if _inside(page, home, chosen)]


def _inside(page: _Lines, home: int, chosen: set[int]) -> bool:
    while home >= 0:
        if home in chosen:
            return True
        home = page.parents[home]
    return False


def _parsed(html: str, pardoned: frozenset[int]) -> _Lines:
    page = _Lines(pardoned)
    page.feed(html)
    page.close()
    for tag, *_ in page.stack[:1]:
        page._close(tag)
    page.flush()
    return page


def lines_of(html: str, sigma: float = SIGMA) -> _Lines:
    """The page without its furniture; a block named so that holds most of all text and of the dense text is none."""
    page = _parsed(html, frozenset())
    while any(page.lost.values()):
        block = max(page.lost, key=page.lost.get)
        marked = {i for i, n in enumerate(page.names) if n in ("article", "main")}
        lines = zip(page.texts, page.homes, strict=True)
        if page.lost[block] <= sum(len(t) * (MARKED if _inside(page, h, marked) else 1) for t, h in lines):
            break
        whole = _parsed(html, page.pardoned | {block})
        start, end = whole.spans[block]
        if start == end:
            break
        weight = _weights(whole, sigma)
        if weight[start:end].sum() * 2 <= weight.sum():
            break
        page = whole
    return page


def extract(html: str | None) -> str:
    """Main text of one page: its content blocks, one per line."""
    page = lines_of(html or "")
    return "\n".join(page.texts[i] for i in content_lines(page))


def page_texts(
    pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Main text of every page: (page, url, text, n_chars).

    General: the project reads no web pages. Menus, headers, footers, sidebars, notices, adverts,
    forms, reader comments, scripts, styles and markup are left out by element and by the names a page
    gives its parts, unless a part with such a name, other than reader comments, holds most of the text; what remains is judged by text
    density (see ``content_lines``). White space within a block
    is one space, a line break in a block too; blocks are joined by line ends.

    A null or empty page gives an empty text; keys and addresses may be null or repeated; further
    columns are ignored. Pages are independent rows, so nothing is shuffled.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (page, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=[page, url, "text", "n_chars"],
            )

    schema = f"`{page}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long"
    return mapped(pages.select(page, url, html), run, schema)
