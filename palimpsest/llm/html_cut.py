"""Main text of web pages by minimum cut.

The nodes of a page's graph are its blocks of text. A linear classifier gives the cost of calling a block content or boilerplate,
and so the capacities of its edges to the two terminals, from its length and links and from the tags and names of the elements
around it. Smoothness edges tie blocks that follow one another, the less the farther apart they are in the document tree, and
blocks that follow one another inside one element, though others stand between. The minimum cut labels all blocks at once:
elements that say much of a block outweigh its neighbours, and where they say little, a short line goes with the paragraphs
that it stands among.

Kept are all texts but those of scripts, styles, templates, drawings, forms' own fields, embedded frames and media; formulas, objects'
substitutes and what is meant for pages without scripts are text like any other.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: Comments; elements whose content is not page text; declarations; tags.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template|svg|iframe|textarea|title|select|canvas|audio|video)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)"
    rf"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS}|[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)
_PIECES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# HTML element classes and the words that sites use in class and id names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msub msup mfrac msqrt".split())
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
_TAG = {
    "nav": -6.0, "header": -4.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "button": -6.0, "fieldset": -5.0, "dialog": -6.0, "head": -9.0, "label": -3.0,
    "article": 5.0, "main": 4.0, "p": 1.0, "h1": 0.5, "blockquote": 1.0, "pre": 1.0, "li": -0.5, "td": -0.3, "figcaption": 0.5,
}
_BAD = frozenset(
    """ad ads adv advert adverts advertisement advertising adsbygoogle banner promo promotion sponsor sponsored sponsors sidebar side aside rail widget widgets menu
    menubar nav navbar navigation breadcrumb breadcrumbs header masthead footer foot colophon copyright cookie cookies consent gdpr notice notices alert notification
    warning popup modal overlay dialog comment comments commentlist disqus reply replies respond discussion reader feedback share sharing social follow related
    recommend recommended recommendations suggested more trending popular newsletter subscribe subscription signup login register form search searchbox toolbar
    pagination pager skip legal disclaimer tags tagcloud toc hidden""".split()
)
_GOOD = frozenset("article articlebody content main body story post entry text maincontent".split())
_AD_LEADS = -7.0
_NAMED_GOOD = 1.5
#: Smoothness: neighbours in page order, neighbours inside an element, and what a step in the tree divides by.
ADJACENT, INSIDE, STEP = 0.9, 0.6, 0.5
#: The classifier: what it starts from, the shares of links and of the length, and the most that elements say either way.
START, LINKED, LENGTH, AROUND = -0.2, -3.0, 0.8, 4.0


def _own_score(tag: str, attrs: str) -> float:
    score = _TAG.get(tag, 0.0)
    if attrs and len(attrs) > 3:
        low = attrs.lower()
        if "class" in low or "id" in low or "role" in low or "aria" in low or "itemprop" in low:
            words = {w.lower() for m in _NAMES.finditer(attrs) for w in _PIECES.findall(m[1])}
            if words & _BAD:
                score += _AD_LEADS if tag not in ("body", "html", "article", "main") else 0.0
            elif words & _GOOD:
                score += _NAMED_GOOD
        if ("hidden" in low or "display" in low) and _HIDDEN.search(attrs):
            score += _AD_LEADS
    return score


class _Block:
    """A block of text: its code points, those in links, the element around it and what inline elements say of it."""

    __slots__ = ("box", "chars", "linked", "score", "text")

    def __init__(self, text: str, linked: int, score: float, box: int) -> None:
        self.text, self.chars, self.linked, self.score, self.box = text, len(text), linked, score, box


class _Box(NamedTuple):
    """An element: the element around it (-1: none), its depth, and what its tag and names say."""

    around: int
    depth: int
    score: float


def blocks(page: str) -> tuple[list[_Block], list[_Box]]:
    """Text blocks in page order, references decoded and white space made single blanks, and the elements. Tags may be
    unclosed or cut off; markup never becomes text."""
    out: list[_Block] = []
    boxes = [_Box(-1, 0, 0.0)]
    stack: list[tuple[str, float, int]] = [("", 0.0, 0)]  # tag, score of inline elements open inside the box, box
    opened: dict[str, int] = {}  # how many elements of a tag are open
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(_Block(text, min(linked, len(text)), stack[-1][1], stack[-1][2]))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if links:
            linked += len(piece.strip())

    def close_to(depth: int) -> None:
        nonlocal links
        for tag, _, _ in stack[depth:]:
            opened[tag] -= 1
            links -= tag == "a"
        del stack[depth:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        tag = name.lower()
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in _INLINE
        if m[2]:
            if not inline:
                flush()
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag and not (inline and stack[depth][0] not in _INLINE):
                    depth -= 1
                if stack[depth][0] == tag:
                    close_to(depth)
            continue
        if not inline:
            flush()
            ends = _SAME.get(tag, "p" if tag not in _VOID else "")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                ends = "p " + ends
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends.split():
                    close_to(i)
                    break
                if stack[i][0] not in _INLINE and stack[i][0] != "p":
                    break
        if tag in _VOID or m[4].endswith("/"):
            continue
        own = _own_score(tag, m[4])
        if inline:
            stack.append((tag, stack[-1][1] + own, stack[-1][2]))
        else:
            around = stack[-1][2]
            boxes.append(_Box(around, boxes[around].depth + 1, own))
            stack.append((tag, 0.0, len(boxes) - 1))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return out, boxes


def _softplus(x: float) -> float:
    return math.log1p(math.exp(-abs(x))) + max(x, 0.0)


def log_odds(block: _Block, around: float) -> float:
    """The classifier's log odds that a block is content. around: what the elements around it say."""
    share = block.linked / max(block.chars, 1)
    said = max(-AROUND, min(AROUND, around + block.score))
    return START + LINKED * share + LENGTH * min(math.log1p(block.chars / 40), 3.0) + said


def costs(block: _Block, around: float) -> tuple[float, float]:
    """Costs of the labels content and boilerplate of a block."""
    z = log_odds(block, around)
    return _softplus(-z), _softplus(z)


def _distance(a: int, b: int, boxes: list[_Box]) -> int:
    """Steps between two elements in the document tree."""
    steps = 0
    while a != b:
        if boxes[a].depth >= boxes[b].depth:
            a = boxes[a].around
        else:
            b = boxes[b].around
        steps += 1
    return steps


def graph(found: list[_Block], boxes: list[_Box]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminals and edges of a page, whose nodes are its blocks."""
    said = [0.0] * len(boxes)
    for i, box in enumerate(boxes):  # an element comes after the one around it
        said[i] = box.score + (said[box.around] if i else 0.0)
    terminal = []
    for b in found:
        content, boilerplate = costs(b, said[b.box])
        terminal.append(boilerplate - content)  # what both terminals share is cut in any case
    edges = [(i, i + 1, ADJACENT / (1 + STEP * _distance(a.box, b.box, boxes))) for i, (a, b) in enumerate(zip(found, found[1:]))]
    last: dict[int, int] = {}  # of the blocks around which an element is the next but one, the latest
    for i, b in enumerate(found):
        outer = boxes[b.box].around
        if outer in last and last[outer] < i - 1:
            edges.append((last[outer], i, INSIDE))
        last[outer] = i
    return terminal, edges


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side. terminal: capacity from the source (positive) or to the
    sink (negative); edges hold both ways. Flows go level by level from the sources, each level graph filled before the next."""
    n, tiny = len(terminal), 1e-9
    near: list[list[int]] = [[] for _ in range(n)]
    end, room = [], []  # arcs; the reverse of arc e is e ^ 1
    for a, b, w in edges:
        near[a].append(len(end))
        near[b].append(len(end) + 1)
        end += (b, a)
        room += (w, w)
    rest = list(terminal)
    while True:
        level = [0 if r > tiny else -1 for r in rest]
        ring, reached = [i for i in range(n) if not level[i]], False
        sources, depth = ring, 0
        while ring and not reached:
            depth += 1
            after = []
            for i in ring:
                for e in near[i]:
                    j = end[e]
                    if room[e] > tiny and level[j] < 0:
                        level[j] = depth
                        after.append(j)
                        reached = reached or rest[j] < -tiny
            ring = after
        if not reached:
            return [x >= 0 for x in level]
        arc = [0] * n
        for source in sources:
            path: list[int] = []
            i = source
            while rest[source] > tiny:
                if rest[i] < -tiny:
                    flow = min(rest[source], -rest[i], min(room[e] for e in path))
                    rest[source] -= flow
                    rest[i] += flow
                    for k in range(len(path) - 1, -1, -1):
                        room[path[k]] -= flow
                        room[path[k] ^ 1] += flow
                    full = next((k for k, e in enumerate(path) if room[e] <= tiny), len(path))
                    i = end[path[full] ^ 1] if full < len(path) else i
                    del path[full:]
                    continue
                while arc[i] < len(near[i]) and not (room[near[i][arc[i]]] > tiny and level[end[near[i][arc[i]]]] == level[i] + 1):
                    arc[i] += 1
                if arc[i] < len(near[i]):
                    path.append(near[i][arc[i]])
                    i = end[path[-1]]
                elif path:
                    i = end[path.pop() ^ 1]
                    arc[i] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line; empty if there is none."""
    found, boxes = blocks(page or "")
    keep = minimum_cut(*graph(found, boxes)) if found else []
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of pages but the html, plus text (empty if there is none; a null page is empty) and
    n_chars, its code points. Existing columns of these names are replaced. Whole pages are read. Repeated rows each have their text;
    where two labellings cost the same, blocks that no flow reaches from the content side are boilerplate; an empty table
    gives no rows."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(h.as_py()) for h in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema)
    return pages.select(*kept, html_col).mapInArrow(batches, f"{schema}{', ' if kept else ''}text string, n_chars long")
