"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of the page; what stands in
menus, headers, footers, side bars, adverts, forms and comments leaves lines without
text, and text of links counts for nothing. The text lengths of every few
consecutive lines are summed. Where the sum surges the main text begins, where it
dives to nothing it ends, and all lines between are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.scratch import columns_of, tidy, whole_text
from wattframe.llm.words import text_slices

#: Lines summed at once, and the sum that marks main text where no element does.
WINDOW_LINES = 3
SURGE_CHARS = 86

_RAW = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|iframe|object|svg|math|textarea|title|select|canvas|audio|video)\b[^>]*?"
    r"(?:/>|>.*?(?:</\1\s*>|\Z))",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_MARK = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("nav footer aside form button menu dialog fieldset head".split())
_MAIN = frozenset("main articlebody".split())
_BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus dropdown footer footnav gdpr header hidden login masthead menu menubar modal nav navbar "
    "navigation navigationbar newsletter notice notices notification outbrain overlay pager pagination popup promo "
    "promotion promoted recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored sponsors subscribe subscription taboola toolbar topbar widget alert banner contentinfo "
    "complementary sidenav copyright legal disclaimer".split()
)


#: In a name, what follows these tells how the page is laid out, not what the element is.
_LAYOUT = frozenset("has no with without".split())
#: Elements that hold articles which are not the page's own.
_LISTS = frozenset(
    "comment comments disqus outbrain popup promo promoted recommended related replies sponsored taboola widget".split()
)


def _marks(attributes: str) -> set[str]:
    found: set[str] = set()
    for m in _MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            for part in re.split(r"[_-]+", name):
                parts = [x.lower() for x in (part, *re.findall(r"[A-Z]?[a-z]+", part))]
                if _LAYOUT & set(parts):
                    break
                found.update(parts)
    return found


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _SKIPPED or (tag == "header" and not in_article):
        return True
    if tag in ("body", "html", "article", "main") and "=" not in attributes:
        return False
    if not attributes.strip():
        return False
    if tag not in _INLINE and _HIDDEN.search(attributes):
        return True
    marks = _marks(attributes)
    if tag in ("body", "html", "main") or (tag in ("header", "h1") and in_article):
        return False
    return bool(marks & _BOILERPLATE) and not (tag == "article" and not marks & {"comment", "comments", "ad", "related", "promo"})


class _Line:
    __slots__ = ("parts", "linked", "article", "main")

    def __init__(self, article: bool, main: bool):
        self.parts: list[str] = []
        self.linked, self.article, self.main = 0, article, main


def _unlinked(page: str, tags: list[re.Match]) -> list[int]:
    """Characters outside links up to each tag, and in the whole page."""
    sums, at, total, linked = [], 0, 0, False
    for tag in tags:
        if not linked:
            total += len("".join(page[at : tag.start()].split()))
        sums.append(total)
        at = tag.end()
        if tag[2].lower() == "a":
            linked = not tag[1]
    return [*sums, total if linked else total + len("".join(page[at:].split()))]


class _Elements:
    """Where the elements of a page end and what they hold, found in one pass over its tags."""

    def __init__(self, page: str, tags: list[re.Match]):
        self._tags = tags
        self._closed: dict[int, int] = {}
        self._next_block = [len(tags)] * (len(tags) + 1)
        open_: dict[str, list[int]] = {}
        for i, tag in enumerate(tags):
            same = open_.setdefault(tag[2].lower(), [])
            if not tag[1]:
                same.append(i)
            elif same:
                self._closed[same.pop()] = i
        for i in range(len(tags) - 1, -1, -1):
            block = not tags[i][1] and tags[i][2].lower() not in _INLINE
            self._next_block[i] = i if block else self._next_block[i + 1]
        self._page = page
        self._held: tuple[list[int], list[int], list[int]] | None = None

    def end(self, i: int) -> int:
        """The tag that ends an element; the next block if it is never closed."""
        return self._closed.get(i, self._next_block[i + 1])

    def _counted(self) -> tuple[list[int], list[int], list[int]]:
        """Unlinked text, main elements and articles before each tag."""
        if self._held is None:
            mains, articles = [0], [0]
            for tag in self._tags:
                opened = not tag[1]
                mains.append(mains[-1] + (opened and (tag[2].lower() == "main" or bool(_MAIN & _marks(tag[3])))))
                articles.append(articles[-1] + (opened and tag[2].lower() == "article" and not _boilerplate("article", tag[3], False)))
            self._held = _unlinked(self._page, self._tags), mains, articles
        return self._held

    def holds_main_text(self, i: int, marks: set[str]) -> bool:
        """Whether a closed element holds the main element, an article of the page, or most of its text."""
        end = self._closed.get(i)
        if end is None:
            return False
        sums, mains, articles = self._counted()
        if 2 * (sums[end] - sums[i]) > sums[-1] or mains[end] > mains[i + 1]:
            return True
        return articles[end] > articles[i + 1] and not marks & _LISTS


def page_lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """``(text, length without links, in an article, in the main element)`` of each block.

    Blocks of boilerplate are lines without text. A boilerplate element that is never
    closed ends where the next block begins.
    """
    page = _RAW.sub(" ", page.replace("\x00", ""))
    tags = list(_TAG.finditer(page))
    elements: _Elements | None = None
    skip_until = -1  # index of the tag that ends the boilerplate at hand
    links = articles = mains = 0
    lines = [_Line(False, False)]
    at = 0

    def add(text: str) -> None:
        if text:
            lines[-1].parts.append(text)
            if links:
                lines[-1].linked += len("".join(text.split()))

    for i, tag in enumerate(tags):
        if skip_until < 0:
            add(page[at : tag.start()])
        at = tag.end()
        if i < skip_until:
            continue
        if i == skip_until:
            skip_until = -1
            lines.append(_Line(articles > 0, mains > 0))
            if tag[1]:
                continue
        closing, name = bool(tag[1]), tag[2].lower()
        if name == "a":
            links = 0 if closing else 1
        if name in _INLINE and not (not closing and name == "span" and _boilerplate(name, tag[3], articles > 0)):
            if name in ("br", "wbr", "img"):
                add(" ")
            continue
        if not closing and name not in _VOID and not tag[3].rstrip().endswith("/") and _boilerplate(name, tag[3], articles > 0):
            elements = elements or _Elements(page, tags)
            by_name = name not in _SKIPPED and name != "header" and name != "article" and not _HIDDEN.search(tag[3])
            if not (by_name and elements.holds_main_text(i, _marks(tag[3]))):
                skip_until = elements.end(i)
                links = 0
                lines.append(_Line(False, False))
                continue
        if name == "article":
            articles = max(0, articles + (-1 if closing else 1))
        elif name == "main" or (not closing and _MAIN & _marks(tag[3])):
            mains = max(0, mains + (-1 if closing else 1))
        lines.append(_Line(articles > 0, mains > 0))
    if skip_until < 0:
        add(page[at:])
    out = []
    for line in lines:
        text = " ".join(html.unescape("".join(line.parts)).split())
        out.append((text, max(0, len(text.replace(" ", "")) - line.linked), line.article, line.main))
    return out


def main_text(page: str, window: int = WINDOW_LINES, surge: int = SURGE_CHARS) -> str:
    """Blocks of the main text in page order, one to a line."""
    lines = page_lines(page)
    # what articles or the main element hold is main text however short its lines are, if it is most of the page's
    total = sum(n for _, n, _, _ in lines)
    in_article = sum(n for _, n, a, _ in lines if a)
    in_main = sum(n for _, n, _, m in lines if m)
    article = 2 * in_article > total and 2 * in_article >= in_main
    main = not article and 2 * in_main > total
    lines = [(t, n, bool(article and a or main and m)) for t, n, a, m in lines]
    # neighbouring lines without text count as one, so that nesting alone parts nothing
    lines = [x for i, x in enumerate(lines) if x[0] or i == 0 or lines[i - 1][0]]
    texts, lengths, held = zip(*lines)
    if not any(lengths):
        return ""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    runs, start = [], None  # from surge to dive: stretches in which no window is empty
    for i, total in enumerate([*sums, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            runs.append((start, i))
            start = None
    strong = [r for r in runs if max(sums[r[0] : r[1]]) >= surge or any(held[r[0] : r[1]])]
    kept = strong or [max(runs, key=lambda r: sum(lengths[r[0] : r[1]]))]
    return "\n".join(texts[i] for a, b in kept for i in range(a, b) if texts[i])


def _extract(window: int, surge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "html"):
                texts = [main_text(p, window, surge) for p in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["id", "url", "text", "n_chars"],
                )

    return run


def extract_main_text(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    window_lines: int = WINDOW_LINES,
    surge_chars: int = SURGE_CHARS,
) -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``, its code points.

    A null or empty page, or one without main text, has the empty text. Character
    references are decoded, white space inside a block becomes one blank, and blocks
    are joined by one line feed. Repeated rows and rows without an id each give a
    row. An empty table gives an empty one. Other columns are not read.
    """
    rows = columns_of(pages, id_column, url_column, html_column).select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), whole_text(html_column).alias("html")
    )
    out = rows.mapInArrow(tidy(_extract(window_lines, surge_chars)), "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_column, "url": url_column})
