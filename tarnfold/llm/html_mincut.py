"""Main text of web pages by a minimum cut.

A page is cut into blocks of text at its block-level tags. A classifier gives
every block the log-odds of being content, from what the block itself shows
(length, share of link text, tag) and from the kinds and names of its
containers; positive odds are its capacity from the source, negative ones that
to the sink. Neighbouring blocks are joined by edges of the same order of size,
the stronger the nearer they are in the DOM and the more alike their elements.
The minimum cut (Dinic's maximum flow) labels all blocks of a page together, so
a short line between two paragraphs goes with them though it looks like
boilerplate by itself, and a menu's one long entry goes with the menu; what
stays on the source's side is the main text.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

#: Quotes count after an equals sign only; elsewhere they are characters like others.
_ATTRS = r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+"
_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_ATTRS})>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: A last slash that belongs to a value without quotes.
_IN_VALUE = re.compile(r"=\s*[^\s\"'=]+\Z")
#: Names that say what a container has or lacks, not what it is.
_ABOUT = re.compile(r"\b(?:has|with|without|no|is|js)[-_][\w-]+", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCKS = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = {"hr"}
#: Elements that are left out with all they hold; without an end tag, those of
#: ``TO_BLOCK`` up to the next block-level tag, of the others the tag only.
DROPPED = {"noscript", "template", "iframe", "textarea", "select", "svg", "math", "canvas", "object", "title"}
TO_BLOCK = {"textarea", "select", "svg", "math", "title"}
#: An open element of the left kind ends where one of the right begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Tags that may end an open element of another name, or of their own.
ENDING = {x for v in ENDS.values() for x in v}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Log-odds that a container adds for what it holds.
TAG_ODDS = {"nav": -4.0, "menu": -4.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "fieldset": -4.0, "button": -4.0, "dialog": -4.0, "search": -4.0, "header": -3.0, "address": -1.0, "article": 0.75, "main": 0.5}
BAD_NAMES = set("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail aside widget widgets footer foot masthead topbar toolbar header comment comments disqus respond reply replies discussion feedback share sharing social related recommended recommendations more trending popular pager pagination tags tagcloud meta byline copyright legal disclaimer skip search form contentinfo complementary".split())
#: Those that tell of an article element itself, whose names often speak of the page around it.
ARTICLE_BAD_NAMES = set("ad ads advert advertisement sponsored promo promoted comment comments reply replies related recommended teaser".split())
GOOD_NAMES = set("article content main body post entry story text page".split())
NAME_ODDS, GOOD_ODDS, HIDDEN_ODDS, COMMENT_ODDS = -4.0, 0.5, -9.0, -5.0
#: Bounds of all containers' odds together: more of the same says nothing new.
LEAST, MOST = -9.0, 1.5
#: Log-odds of a block by its length: from a word or two to that of prose.
SHORT, PROSE, PROSE_CHARS = -2.0, 2.0, 160
LINK_ODDS, HEADING_ODDS, ITEM_ODDS = -3.0, 1.0, -0.25
#: Log-odds that neighbours in one container have one label; it halves with
#: each two steps in the DOM, and is only a part of that between elements of
#: one container that differ in tag but have no names, and between all others.
SMOOTH, OTHER_TAG, UNLIKE = 1.5, 0.5, 0.1
#: Steps in the DOM beyond which no edge is made: it would be weaker than a thousandth.
FAR = 20


class Block(NamedTuple):
    text: str
    tag: str
    odds: float  # of the containers
    node: int  # the element that holds it
    kind: str  # tag and names of that element and of the one around it
    linked: int


class _Open(NamedTuple):
    tag: str
    node: int
    odds: float
    kind: str  # as a block's
    inside: bool  # an article or main
    article: bool  # an article


class Page(NamedTuple):
    blocks: list[Block]
    parents: list[int]  # of each element; the page itself is element 0
    depths: list[int]


def _hidden(attrs: str) -> bool:
    """Whether an element is hidden by its attributes; words inside other values don't count."""
    if not _HIDDEN.search(attrs):
        return False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDING.search(value):
            return True
    return False


def _enter(tag: str, attrs: str, top: _Open, node: int) -> _Open:
    """An element with the odds of its containers and what it adds itself."""
    odds, names = top.odds, frozenset()
    if tag == "header" and top.inside:
        odds -= 0.5  # an article's own header holds its title
    elif tag in ("article", "main") and top.inside:
        if top.article:
            odds += COMMENT_ODDS  # articles inside an article are reader comments
    else:
        odds += TAG_ODDS.get(tag, 0.0)
    if attrs:
        names = frozenset(w.lower() for m in _NAMES.finditer(attrs) for w in _PART.findall(_ABOUT.sub(" ", m[1] or m[2] or m[3] or "")))
        if names & (ARTICLE_BAD_NAMES if tag == "article" else BAD_NAMES) and tag not in ("html", "body", "main"):
            odds += COMMENT_ODDS if tag == "article" else NAME_ODDS
        elif names & GOOD_NAMES and not top.inside:
            odds += GOOD_ODDS
        if _hidden(attrs):
            odds += HIDDEN_ODDS
    return _Open(tag, node, min(MOST, max(LEAST, odds)), f"{top.kind.rpartition('>')[2]}>{' '.join([tag, *sorted(names)])}", top.inside or tag in ("article", "main"), top.article or tag == "article")


def _tokens(page: str) -> Iterator[tuple[re.Match, int]]:
    """Tags and comments, and where each ends; an element that is left out is one."""
    found = list(_TOKENS.finditer(page))
    names = [(m["name"] or "").lower() for m in found]
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        if name in DROPPED:
            if found[i]["end"]:
                if opened.get(name):
                    ends[opened[name].pop()] = i
            elif not (name in ("svg", "math") and found[i]["attrs"].endswith("/") and not _IN_VALUE.search(found[i]["attrs"])):
                opened.setdefault(name, []).append(i)
    to_block = {i for name in TO_BLOCK for i in opened.get(name, ())}
    i = 0
    while i < len(found):
        m, last, end = found[i], ends.get(i, i), None
        if i in to_block:
            while last + 1 < len(found) and (names[last + 1] not in BLOCKS or names[last + 1] == "option"):
                last += 1
            end = found[last + 1].start() if last + 1 < len(found) else len(page)
        yield m, found[last].end() if end is None else end
        i = last + 1


def parse(page: str) -> Page:
    """The page's blocks with text, in order, and its tree of elements."""
    out: list[Block] = []
    parents, depths = [0], [0]
    stack = [_Open("", 0, 0.0, "", False, False)]
    opened: Counter[str] = Counter()
    texts: list[str] = []
    linked = at = 0
    in_link = False

    def close() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html_lib.unescape("".join(texts)).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.tag, top.odds, top.node, top.kind, min(linked, len(text))))
            texts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        texts.append(text)
        if in_link:
            linked += len(text)

    def pop_to(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    for m, end in _tokens(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = end
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in BLOCKS:
            if name == "a":
                in_link = not m["end"]
            elif name == "br":
                texts.append(" ")
            continue
        close()
        in_link = False
        if m["end"]:
            if opened[name]:
                i = len(stack) - 1
                while stack[i].tag != name:
                    i -= 1
                pop_to(i)
            continue
        if stack[-1].tag == "p":
            pop_to(len(stack) - 1)
        if name in ENDING:
            for i in range(len(stack) - 1, 0, -1):
                if name in ENDS.get(stack[i].tag, ()):
                    pop_to(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "div", "section", "article"):
                    break
        if name not in VOID:
            top = stack[-1]
            parents.append(top.node)
            depths.append(depths[top.node] + 1)
            stack.append(_enter(name, m["attrs"], top, len(parents) - 1))
            opened[name] += 1
    if at < len(page):
        take(page[at:])
    close()
    return Page(out, parents, depths)


def blocks(page: str) -> list[Block]:
    return parse(page).blocks


def odds(b: Block) -> float:
    """Log-odds that a block is content, by itself."""
    w = b.odds + SHORT + (PROSE - SHORT) * min(1.0, math.log1p(len(b.text)) / math.log1p(PROSE_CHARS))
    w += LINK_ODDS * b.linked / len(b.text)
    if b.tag in HEADINGS:
        w += HEADING_ODDS
    elif b.tag in ("li", "td", "th", "dt"):
        w += ITEM_ODDS
    return w


def _steps(page: Page, u: int, v: int) -> int:
    """Steps between two elements in the tree, ``FAR`` or more beyond that."""
    n = 0
    while u != v and n < FAR:
        if page.depths[u] >= page.depths[v]:
            u = page.parents[u]
        else:
            v = page.parents[v]
        n += 1
    return n


def _alike(page: Page, a: Block, b: Block) -> float:
    if a.kind == b.kind:
        return 1.0
    plain = all(" " not in x.kind.rpartition(">")[2] for x in (a, b))
    return OTHER_TAG if plain and page.parents[a.node] == page.parents[b.node] else UNLIKE


def edges(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the one before, and with the one
    before of its kind in its container, if others lie between."""
    out: list[tuple[int, int, float]] = []
    last: dict[tuple[int, str], int] = {}
    for j, b in enumerate(page.blocks):
        up = page.parents[b.node], b.kind
        for i in {j - 1, last.get(up, j - 1)} - {-1}:
            a = page.blocks[i]
            n = _steps(page, a.node, b.node)
            if n < FAR:
                strength = SMOOTH * 0.5 ** (max(0, n - 2) / 2) * _alike(page, a, b)
                out.append((i, j, strength if i == j - 1 else strength / 2))
        last[up] = j
    return out


def min_cut(weights: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut: True on the source's side. ``weights``: each
    node's capacity from the source less that to the sink, of which only the
    difference can matter. Dinic's algorithm; the source's side is the least
    of those that cost the minimum."""
    n = len(weights)
    left = list(weights)  # what the source can still send (> 0) or the sink still take (< 0)
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for u, v, c in links:
        near[u].append(len(to))
        to.append(v)
        room.append(c)
        near[v].append(len(to))
        to.append(u)
        room.append(c)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if left[i] > tiny]
        for i in queue:
            level[i] = 0
        end = None
        for u in queue:  # grows while it is read
            if end is not None and level[u] >= end:
                break
            for e in near[u]:
                v = to[e]
                if room[e] > tiny and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
                    if left[v] < -tiny and end is None:
                        end = level[v]
        if end is None:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in [i for i in queue if level[i] == 0]:
            path: list[int] = []
            u = s
            while left[s] > tiny:
                if left[u] < -tiny and path:
                    push = min(left[s], -left[u], *(room[e] for e in path))
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    left[s] -= push
                    left[u] += push
                    path, u = [], s
                    continue
                while at[u] < len(near[u]):
                    e = near[u][at[u]]
                    if room[e] > tiny and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(near[u]):
                    path.append(near[u][at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def labels(page: Page) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    return min_cut([odds(b) for b in page.blocks], edges(page))


def main_text(page: str | None) -> str:
    """Blocks of the main text, one a line; empty without any."""
    if not page:
        return ""
    parsed = parse(page)
    return "\n".join(b.text for b, good in zip(parsed.blocks, labels(parsed), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row. Null or empty
    html, and pages without content: an empty text. Repeated rows give equal
    results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 8 << 20):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), run, "page_id long, url string, text string, n_chars long")


def op2_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
