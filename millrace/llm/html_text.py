"""Main text of web pages by consensus host paths (operator 10).

Each page's containers are scored by the text of their paragraphs, links counting against.
Without an article or main element the best container is widened while the element around
it adds text that is not dropped and is not mostly links. Its path, generalised to tags and class names without digits, is the page's vote. Votes
are counted per host in Spark; then every page is read again and gives the text under its
host's winning path, or under its own best container where it has none, or where that path
is outside article and main and holds less than half of the text of the own container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by element and by words of class, id and role. A block's character
references are decoded, its white space becomes single blanks, and blocks are joined by an
empty line. Nothing else is dropped.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import table

SALTS = 64
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|object)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:[^>]*+>|\Z|[^>]*+\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body center div main section td".split())
_DROPPED = frozenset("aside button dialog footer head menu nav".split())
#: Words for what is not the article, and words that may stand beside them without changing that.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus"
    " footer masthead menu nav navbar navigation newsletter notice notices popup promo promos promotion related respond share sharing sidebar social sponsor"
    " sponsored sponsors subscribe subscription".split()
)
_BESIDE = frozenset(
    "a area bar body bottom box block btn button buttons center col column container content form global group header here inner item items js left level line link links list"
    " main mobile module page panel placeholder post posts primary right root section secondary site slot space sub tab text title top unit view widget wrap wrapper".split()
)
_COMMENTS = frozenset("comment comments disqus respond".split())
_PARAGRAPH = frozenset("p pre blockquote td h1 h2 h3 li".split())
_ARTICLE = re.compile(r"(^|>)(article|main)\b")
#: An element of the key closes an open one of the set.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Element:
    """An open element. ``doubt`` says why it may not be part of the article, until the whole page is known."""

    tag: str
    name: str
    path: int  # a hash of the names from the root down to here
    dropped: bool
    number: int
    parent: Element | None
    in_article: bool = False
    doubt: str = ""
    holds_head: bool = False
    holds_article: bool = False


@dataclass
class Block:
    text: str
    links: int
    of: Element


class Page(NamedTuple):
    """Blocks in order, and all elements, parents before what they hold."""

    blocks: list[Block]
    elements: list[Element]

    def sums(self, value: Callable[[Block], int]) -> list[int]:
        """By element: the values of all blocks inside."""
        out = [0] * len(self.elements)
        for block in self.blocks:
            out[block.of.number] += value(block)
        for e in reversed(self.elements):
            if e.parent is not None:
                out[e.parent.number] += out[e.number]
        return out

    def inside(self, hit: Callable[[Element], bool]) -> list[Block]:
        """The blocks that are in an element for which ``hit`` holds."""
        under = [False] * len(self.elements)
        for e in self.elements:
            under[e.number] = hit(e) or (e.parent is not None and under[e.parent.number])
        return [b for b in self.blocks if under[b.of.number]]


_ROOT = "body"


def _step(above: int, name: str) -> int:
    return hash((above, name))


def path_of(element: Element) -> str:
    """The names from the root down to ``element``; body and html are one root."""
    names, at = [], element
    while at is not None and at.tag not in ("html", "body"):
        names.append(at.name)
        at = at.parent
    return ">".join([_ROOT, *reversed(names)])


def _doubt(names: dict[str, str]) -> str:
    """Whether a class, id or role as a whole names something beside the article: "words", or "comments"."""
    found = ""
    for name in " ".join(names.values()).lower().split():
        parts = [re.sub(r"\d+$", "", p) for p in re.split(r"[_-]+", name)]
        parts = [p for p in parts if p]
        hit = _WORDS.intersection(parts)
        if hit and all(p in _WORDS or p in _BESIDE for p in parts):
            if hit & _COMMENTS:
                return "comments"
            found = "words"
    return found


def _open(tag: str, attrs: str, above: Element | None, number: int) -> Element:
    names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs)} if "=" in attrs else {}
    classes = sorted({re.sub(r"\d+", "", c) for c in names.get("class", "").lower().split()} - {""})
    here = ".".join([tag, *classes])
    inside = above is not None and above.in_article
    dropped = (above is not None and above.dropped) or tag in _DROPPED or (tag == "header" and not inside)
    doubt = ""
    if not dropped and tag not in ("html", "body", "article", "main"):
        doubt = "form" if tag == "form" else _doubt(names)
    start = hash(_ROOT)
    path = start if tag in ("html", "body") else _step(above.path if above else start, here)
    return Element(tag, here, path, dropped, number, above, inside or tag in ("article", "main"), doubt)


def _article_blocks(page: Page) -> Page:
    """The page without the blocks that an element in doubt takes out of the article.

    An element that holds the heading or the main element is the page around them, and so
    is one that holds most of the text in paragraphs, if it is a form or holds an article.
    """
    for e in reversed(page.elements):
        if e.parent is not None:
            e.parent.holds_head |= e.holds_head or e.tag in ("h1", "main")
            e.parent.holds_article |= e.holds_article or e.tag == "article"
    text = page.sums(lambda b: len(b.text) if b.of.tag in _PARAGRAPH else 0)
    total = sum(len(b.text) for b in page.blocks if b.of.tag in _PARAGRAPH)

    def out(e: Element) -> bool:
        around = e.holds_head or (2 * text[e.number] > total and (e.doubt == "form" or (e.doubt == "words" and e.holds_article)))
        return bool(e.doubt) and not around

    gone = set(map(id, page.inside(out)))
    return page._replace(blocks=[b for b in page.blocks if id(b) not in gone])


def blocks(page: str) -> Page:
    """The page's blocks in order, each with the element it is in; dropped ones left out."""
    whole = Element("body", _ROOT, hash(_ROOT), False, 0, None)
    elements: list[Element] = [whole]
    stack: list[Element] = []
    found: list[Block] = []
    parts: list[str] = []
    links, at = 0, 0

    def flush() -> None:
        nonlocal links
        if parts and stack and not stack[-1].dropped or parts and not stack:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, links, next((e for e in reversed(stack) if e.tag in _BLOCK), whole)))
        parts.clear()
        links = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if any(e.tag == "a" for e in stack[-4:]):
                links += m.start() - at
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "body", "table") and tag not in ("html", "body", "article"):
                    break
            continue
        if tag in _VOID:
            continue
        closes = _CLOSES.get(tag, {"p"} if tag in _BLOCK else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in closes:
                del stack[k:]
                break
            if stack[k].tag in _CONTAINER or stack[k].tag in ("ul", "ol", "dl", "table"):
                break
        stack.append(_open(tag, m["attrs"] or "", stack[-1] if stack else None, len(elements)))
        elements.append(stack[-1])
    if at < len(page):
        parts.append(page[at:])
    flush()
    return _article_blocks(Page(found, elements))


def best_container(page: Page) -> Element | None:
    """The container whose paragraphs hold most; half of a paragraph's score goes one container further up."""
    score: dict[int, float] = defaultdict(float)
    element: dict[int, Element] = {}
    for block in page.blocks:
        value = (len(block.text) - 2 * block.links) * (1.0 if block.of.tag in ("p", "pre", "blockquote", "td") else 0.5)
        share, at = 1.0, block.of
        while at is not None and share > 0.2:
            if at.tag in _CONTAINER:
                element.setdefault(at.number, at)
                score[at.number] += value * share
                share /= 2
            at = at.parent
    top = max(score, key=lambda n: (score[n], -n), default=None)
    if top is None or score[top] <= 0:
        return None
    best = at = element[top]
    while at is not None:  # a part of an article stands for the article
        if at.tag in ("article", "main"):
            best = at
        at = at.parent
    return best if best.tag in ("article", "main") else _widened(best, page)


def _widened(best: Element, page: Page) -> Element:
    """The highest element up from ``best`` to which each step adds text, not mostly links."""
    text, links = page.sums(lambda b: len(b.text)), page.sums(lambda b: b.links)
    at = best.parent
    while at is not None and 2 * (links[at.number] - links[best.number]) <= text[at.number] - text[best.number]:
        if text[at.number] > text[best.number]:
            best = at
        at = at.parent
    return best


def main_text(page: str, path: str | None) -> str:
    """The text under ``path``, else under the page's own best container, else of the whole page."""
    found = blocks(page)
    chosen: list[Block] = []
    if path:
        wanted = reduce(_step, path.split(">")[1:], hash(_ROOT))
        chosen = found.inside(lambda e: e.path == wanted)
    if (not chosen or not _ARTICLE.search(path)) and (own := best_container(found)):
        whole = found.inside(lambda e: e is own)
        if 2 * sum(len(b.text) for b in chosen) < sum(len(b.text) for b in whole):
            chosen = whole
    return "\n\n".join(b.text for b in chosen or found.blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    NULL or empty html gives an empty text. Pages without a host vote together. Repeated
    rows come back as often; an empty table gives an empty one. Other columns are ignored.
    A page is read in one pass, and what its elements hold is added up in another, so long
    and deeply nested pages take time in proportion.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for page in batch.column(1):
                own = best_container(blocks(page.as_py() or ""))
                paths.append(path_of(own) if own else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["host", "path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", path.as_py()) for page, path in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string").where("path IS NOT NULL")
    winners = votes.groupBy("host", "path").agg(F.count("*").alias("votes")).groupBy("host").agg(F.max(F.struct("votes", "path")).alias("won"))
    # a host's pages are dealt to many tasks
    winners = winners.select("host", F.col("won.path").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op10(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
