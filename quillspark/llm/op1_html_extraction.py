"""Main text of web pages by tag-path ratios.

A page becomes its text blocks in order, each with the path of block elements from the root (an element's class is part of its name).
For each path the text outside links and the punctuation of its blocks are added up and divided by the number of its
blocks: the tag-path ratios. Each block takes its path's ratios; both series are smoothed over the page by a Gaussian, fused
(text times one plus punctuation), averaged over the path's blocks again and multiplied by the root of the path's share of the page's
text: the path's score. Paths whose score reaches `part` of the page's mean score, weighed by text, are content, and their
blocks are selected.

Names (an element, role, class or id that says menu, header, footer, sidebar, notice, advert, form or comments) are a prior: where other paths
hold a sentence or some text (`TOLD`), these are judged by their ratios alone, whatever stands around them under names. Where they don't, names lower the
score of the paths below them, to `PRIOR` of it, and further the less text a page has to judge by; paths under comments are judged only where there is nothing else.

Headings and short paragraphs, which no ratio shows, come along with what they belong to: text elements whose parent, or its
parent, is also the parent of a selected block, headings and weakly scored text elements that touch kept blocks in page order, and then all that stands in the
container of the kept blocks, tables, lists and short blocks included (`whole`). Paths under
the prior and paths of links are never taken that way. Extraction needs a page's own bytes only, so nothing is shuffled.

Defined cases: null, empty and text-free pages give the empty text; unclosed, crossed and cut-off tags are read as browsers do, nearly;
`<br>` counts as white space; time and memory grow in proportion to the page, however deep it nests; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of the page's mean: what a path's score needs to be content, and what the bare ratios of a text element beside content need.
PART, WEAK = 0.5, 0.15
#: What names leave of a score on a page of ENOUGH characters outside links; on shorter ones less, by the cube of their share of it.
PRIOR, ENOUGH = 0.3, 500
#: Characters of text under no name that tell enough to leave what stands under names out, if there is no sentence among them.
TOLD = 80
#: The share of the kept text that a container holds.
NEARLY = 0.9
#: Of the Gaussian over neighbouring blocks.
RADIUS, SIGMA = 1, 0.7

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…](?=[\s\"'”’»)\]]|\Z)|[。，；：！？、]")

RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table select article section main body html div".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADING | frozenset("p li dt dd pre blockquote td th figcaption address".split())
PARTIAL = frozenset("ul ol dl table thead tbody tfoot tr".split())
ASIDE = frozenset("nav footer aside form menu button select dialog head fieldset object svg audio video canvas".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices alert sidebar sidebars nav navbar navigation menu menus submenu "
    "breadcrumb breadcrumbs footer header masthead comment comments commentlist discussion respond reply replies disqus related recommended recommendations promo promotion "
    "sponsor sponsored social share sharing newsletter subscribe subscription signup login signin search popup modal overlay widget widgets toolbar pagination pager "
    "complementary contentinfo form paywall skip".split()
)
REMARK_NAMES = frozenset("comment comments commentlist discussion respond reply replies disqus".split())


class Element:
    __slots__ = ("name", "path", "aside", "remark", "article", "up", "depth")

    def __init__(self, name: str, path: int, aside: bool, remark: bool, article: bool, up: Element | None) -> None:
        self.name, self.path, self.aside, self.remark, self.article, self.up = name, path, aside, remark, article, up
        self.depth = up.depth + 1 if up else 0


class Block:
    __slots__ = ("element", "text", "length", "points", "linked")

    def __init__(self, element: Element, text: str, linked: int) -> None:
        self.element, self.text, self.linked = element, text, min(linked, len(text))
        self.length, self.points = len(text) - self.linked, len(PUNCTUATION.findall(text))


class Open:
    """The open elements, with the places of each name, so that no tag has to walk all of them. Paths are numbers."""

    def __init__(self) -> None:
        self.stack = [Element("", 0, False, False, False, None)]
        self.places: dict[str, list[int]] = {}
        self.scopes = [0]
        self.paths: dict[tuple[int, str], int] = {}

    def push(self, name: str, names: str, classes: str) -> None:
        up = self.stack[-1]
        aside, remark = up.aside or name in ASIDE or name == "header" and not up.article, up.remark
        if names and not remark and name not in ("html", "body", "main"):
            told = {y for x in names.split() for y in PARTS.split(x)} & ASIDE_NAMES
            remark = bool(told & REMARK_NAMES)
            aside = aside or remark or name != "article" and bool(told - {"header"} if up.article else told)
        path = self.paths.setdefault((up.path, f"{name}.{classes}"), len(self.paths) + 1)
        self.places.setdefault(name, []).append(len(self.stack))
        if name in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(Element(name, path, aside, remark, up.article or name in ("article", "main"), up))

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        for e in self.stack[at:]:
            self.places[e.name].pop()
        del self.stack[at:]
        while self.scopes[-1] >= at:
            self.scopes.pop()

    def close(self, name: str) -> None:
        if held := self.places.get(name):
            self.cut(held[-1])

    def make_room(self, name: str) -> None:
        """Close what a start tag ends: an open paragraph and its own kind, up to the next enclosing list, table or section."""
        first = len(self.stack)
        for x in ("p", *CLOSES.get(name, ())):
            if held := self.places.get(x):
                if (i := bisect_right(held, self.scopes[-1])) < len(held):
                    first = min(first, held[i])
        if first < len(self.stack):
            self.cut(first)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in their order."""
    open_, found = Open(), []
    run: list[str] = []
    links = linked = 0

    def cut() -> None:
        nonlocal linked
        if run and (text := " ".join(html.unescape("".join(run)).split())):
            found.append(Block(open_.stack[-1], text, linked))
        run.clear()
        linked = 0

    place, end = 0, len(page)
    while place < end:
        m = MARKUP.search(page, place)
        upto = m.start() if m else end
        if upto > place:
            run.append(page[place:upto])
            if links:
                linked += upto - place
        if not m:
            break
        place = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = 0
            if name not in INLINE:
                cut()
                open_.close(name)
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, place)
            place = close.start() if close else end
            if close and (m := MARKUP.match(page, place)):
                place = m.end()
            if name != "noscript":
                run.append(" ")
            continue
        if name == "a":
            links = 1
        if name in INLINE:
            if name == "br":
                run.append(" ")
            continue
        cut()
        if name in VOID:
            continue
        open_.make_room(name)
        said = [(k.lower(), x or y or z) for k, x, y, z in NAMED.findall(m[3])] if m[3] and "=" in m[3] else []
        open_.push(name, " ".join(v for _, v in said).lower(), " ".join(v for k, v in said if k == "class").lower())
    cut()
    return found


def smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    kernel /= kernel.sum()
    return np.convolve(np.pad(x, RADIUS, mode="edge"), kernel, mode="valid")


def ratios(path: np.ndarray, length: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The fused score of each path, from the path, the text and the punctuation of each block."""
    n, total = np.bincount(path), np.bincount(path, length)
    text, marks = total / n, np.bincount(path, points) / n
    fused = smooth(text[path]) * (1 + smooth(marks[path]))
    return np.bincount(path, fused) / n * np.sqrt(total / max(1.0, total.sum()))


def judged(blocks: list[Block]) -> list[Block]:
    """The blocks that the ratios judge: those under no name if they tell enough, else those under none for comments, else all."""
    free = [b for b in blocks if not b.element.aside]
    if any(b.length and (b.points or b.element.article) for b in free) or sum(b.length for b in free) >= TOLD:
        return free
    own = [b for b in blocks if not b.element.remark]
    return own if any(b.length for b in own) else blocks


def whole(blocks: list[Block], keep: np.ndarray, free: np.ndarray) -> None:
    """Lets in what stands in the container of the kept blocks, if most of its text is kept: short blocks, cells and lists that no ratio shows.

    The container is the innermost element that holds nearly all that is kept, an `<article>` or `<main>` around it before others. Where it is the whole page, only
    text elements that stand between two kept siblings come along.
    """
    seen: dict[int, Element] = {}
    held: dict[int, list[float]] = {}
    for b, k in zip(blocks, keep):
        e, n = b.element, len(b.text)
        sums = held.setdefault(id(e), [0.0, 0.0])
        sums[0] += n
        sums[1] += n * bool(k)
        while e and id(e) not in seen:
            seen[id(e)] = e
            held.setdefault(id(e), [0.0, 0.0])
            e = e.up
    best: dict[int, Element] = {}
    for e in sorted(seen.values(), key=lambda x: -x.depth):
        if e.up:
            up = held[id(e.up)]
            up[0] += held[id(e)][0]
            up[1] += held[id(e)][1]
            if id(e.up) not in best or held[id(best[id(e.up)])][1] < held[id(e)][1]:
                best[id(e.up)] = e
    at = next(e for e in seen.values() if not e.up)
    kept = held[id(at)][1]
    while (below := best.get(id(at))) and held[id(below)][1] >= NEARLY * kept:
        at = below
    around = at
    while around and around.name not in ("article", "main"):
        around = around.up
    while at.up and (at.name in TEXTUAL or at.name in PARTIAL):
        at = at.up
    at = around or at
    total, chosen = held[id(at)]
    if at.name not in ("", "html", "body") and 2 * chosen >= total:
        inside = {id(at)}
        for e in sorted(seen.values(), key=lambda x: x.depth):
            if e.up and id(e.up) in inside:
                inside.add(id(e))
        for i, b in enumerate(blocks):
            keep[i] |= id(b.element) in inside and bool(free[i])
        return
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if keep[i]:
            last[id(b.element.up)] = i
    reach = -1  # up to where a kept sibling of a kept block before follows
    for i, b in enumerate(blocks):
        if keep[i]:
            reach = max(reach, last[id(b.element.up)])
        elif i < reach and free[i] and b.element.name in TEXTUAL:
            keep[i] = True


def selected(blocks: list[Block], part: float = PART, score_of=ratios) -> list[Block]:
    """The blocks that are content, in page order."""
    blocks = judged(blocks)
    if not blocks:
        return []
    names = {p: i for i, p in enumerate(dict.fromkeys(b.element.path for b in blocks))}
    path = np.array([names[b.element.path] for b in blocks])
    length, points, linked = (np.array([getattr(b, x) for b in blocks], dtype=float) for x in ("length", "points", "linked"))
    score, text = score_of(path, length, points), np.bincount(path, length)
    low = PRIOR * min(1.0, text.sum() / ENOUGH) ** 3
    aside = np.zeros(len(names), dtype=bool)
    aside[path] = [b.element.aside for b in blocks]
    prior = np.where(aside, low, 1.0)
    weight = text * prior
    if not weight.sum():
        return []
    mean = (score * weight).sum() / weight.sum()
    strong = score * prior >= part * mean
    # what may come along: neither under the prior nor a list of links
    free = ~aside & (2 * np.bincount(path, linked) <= np.bincount(path, linked + length))
    keep = strong[path]
    hosts = {id(b.element.up) for b, k in zip(blocks, keep) if k}
    for i, b in enumerate(blocks):
        e = b.element
        if not keep[i] and free[path[i]] and (id(e) in hosts or e.name in TEXTUAL and (id(e.up) in hosts or e.up and id(e.up.up) in hosts)):
            keep[i] = True
    dense = text * (1 + np.bincount(path, points) / np.bincount(path)) / np.bincount(path)
    weak = dense >= WEAK * (dense * weight).sum() / weight.sum()
    loose = [b.element.name in HEADING or b.element.name in TEXTUAL and weak[p] for b, p in zip(blocks, path)]
    loose = np.array(loose) & free[path]
    for order in (range(1, len(blocks)), range(len(blocks) - 2, -1, -1)):
        for i in order:
            if loose[i] and not keep[i] and keep[i - order.step]:
                keep[i] = order.step < 0 or blocks[i].element.name not in HEADING
    if not aside.any():
        whole(blocks, keep, free[path])
    return [b for b, k in zip(blocks, keep) if k]


def main_text(page: str | None, part: float = PART, score_of=ratios) -> str:
    """The content blocks, joined by line ends."""
    blocks = blocks_of(page) if page else []
    return "\n".join(b.text for b in selected(blocks, part, score_of)) if blocks else ""


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, part: float = PART) -> DataFrame:
    """page_id, url, text, n_chars for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), part) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, SCHEMA)
