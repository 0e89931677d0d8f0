"""A page as blocks: elements that break lines, their text, and features of each for a classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

# ---- fixed values: element names ----
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section"
    " select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript title svg math object canvas audio video datalist".split())
HEAD_TAGS = frozenset("html head base link meta noscript script style template title".split())
FOREIGN = frozenset(["svg", "math"])  # of all elements that hold others, these can close themselves
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body html".split())

_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FEATURES = 27


@dataclass
class Block:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    start: int = 0
    own: int = 0
    linked: int = 0
    marks: int = 0
    children: list[int] = field(default_factory=list)


class PageParser(HTMLParser):
    """Blocks of a page in order (the first is the page itself) and its lines: lists of (block, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks = [Block("", -1, 0, [])]
        self.lines: list[list[tuple[int, str]]] = [[]]
        self.stack: list[tuple[str, int]] = [("", 0)]  # (tag, block in force)
        self.open: dict[str, int] = {}
        self.silent = self.links = self.length = 0

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        if tag in SILENT:
            self.silent -= 1
        if tag == "a":
            self.links -= 1
        if tag in BLOCKS:
            self._break()

    def _break(self) -> None:
        if self.lines[-1]:
            self.lines.append([])

    def _close_until(self, tags: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of ``tags``, if no list or table lies between."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in SCOPES:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_TAGS and (tag == "body" or self.stack[-1][0] == "head"):
            self._end_head()
        if tag in BLOCKS:
            self._close_until(CLOSED_BY_BLOCK)
            self._close_until(CLOSED_BY_SAME.get(tag, frozenset()))
            self._break()
        if tag == "br" or tag == "hr":
            self.handle_data("\n")
        if tag in VOID:
            return
        at = self.stack[-1][1]
        if tag in BLOCKS:
            named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemprop"))
            tokens = [f"<{tag}>", *(t.lower() for t in _TOKEN.findall(named))]
            self.blocks.append(Block(tag, at, self.blocks[at].depth + 1, tokens, start=self.length))
            self.blocks[at].children.append(len(self.blocks) - 1)
            at = len(self.blocks) - 1
        self.stack.append((tag, at))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def _end_head(self) -> None:
        """Close a head that is left open."""
        while self.open.get("head"):
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in FOREIGN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag == "p":
            self._break()

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and not data.isspace():
            self._end_head()
        if self.silent:
            return
        at = self.stack[-1][1]
        self.lines[-1].append((at, data))
        n = len(data) - data.count(" ")
        block = self.blocks[at]
        block.own += n
        block.linked += n if self.links else 0
        block.marks += sum(map(data.count, ".,;:!?"))
        self.length += n


def parse(html: str) -> PageParser:
    page = PageParser()
    page.feed(html)
    page.close()
    return page


def lines_of(page: PageParser, kept: np.ndarray) -> list[str]:
    """Text of the kept blocks, line by line, white space as one space."""
    found = (" ".join("".join(text for at, text in line if kept[at]).split()) for line in page.lines)
    return [line for line in found if line]


def features(page: PageParser, odds: dict[str, float]) -> np.ndarray:
    """One row per block: subtree density, attribute tokens, depth and sibling statistics."""
    blocks = page.blocks
    n = len(blocks)
    own = np.array([b.own for b in blocks], float)
    total, linked, marks, count, paragraphs = own.copy(), np.array([b.linked for b in blocks], float), np.array([b.marks for b in blocks], float), np.ones(n), np.array([b.tag == "p" for b in blocks], float)
    for i in range(n - 1, 0, -1):
        p = blocks[i].parent
        total[p] += total[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        count[p] += count[i]
        paragraphs[p] += paragraphs[i]
    page_total = max(1.0, total[0])
    out = np.zeros((n, FEATURES), np.float32)
    low, high, mean = np.zeros(n), np.zeros(n), np.zeros(n)
    shares: list[Counter[str] | None] = [None] * n  # tags among a block's children
    for i, b in enumerate(blocks):
        found = [odds.get(t, 0.0) for t in b.tokens[1:]]
        low[i], high[i] = min(found, default=0.0), max(found, default=0.0)
        up = max(b.parent, 0)
        siblings = blocks[up].children if i else [0]
        place = _place(siblings, i)
        if i and shares[up] is None:
            shares[up] = Counter(blocks[s].tag for s in siblings)
        same = shares[up][b.tag] / len(siblings) if i else 1.0
        before = siblings[place - 1] if place else -1
        after = siblings[place + 1] if place + 1 < len(siblings) else -1
        t = max(1.0, total[i])
        out[i, :20] = (
            odds.get(b.tokens[0], 0.0) if b.tokens else 0.0, low[i], high[i], b.depth, len(siblings), place / len(siblings), same,
            math.log1p(own[i]), math.log1p(total[i]), total[i] / page_total, total[i] / max(1.0, total[up]), linked[i] / t, marks[i] / t,
            total[i] / count[i], math.log1p(count[i]), paragraphs[i], b.start / page_total, (b.start + total[i]) / page_total,
            math.log1p(total[before]) if before >= 0 else -1, math.log1p(total[after]) if after >= 0 else -1,
        )
        if i:  # what the blocks around it are called
            out[i, 20] = min(out[up, 20], out[up, 0], low[up])
            out[i, 21] = max(out[up, 21], out[up, 0], high[up])
            out[i, 22], out[i, 23] = out[up, 0], out[up, 11]
            mean[up] += out[i, 0] + low[i] + high[i]
    for i, b in enumerate(blocks):
        out[i, 24] = mean[i] / max(1, len(b.children))
        out[i, 25] = len(b.children)
        out[i, 26] = len(b.tokens)
    return out


def _place(siblings: list[int], i: int) -> int:
    low, high = 0, len(siblings) - 1
    while low < high:  # children are numbered in order
        middle = (low + high) // 2
        low, high = (middle + 1, high) if siblings[middle] < i else (low, middle)
    return low


def decode(page: PageParser, logits: np.ndarray) -> np.ndarray:
    """Kept blocks: the best choice in which no block is kept under one that is not."""
    blocks = page.blocks
    weight = np.array([0.25 + math.log1p(b.own) for b in blocks])
    best = logits * weight
    for i in range(len(blocks) - 1, 0, -1):
        best[blocks[i].parent] += max(0.0, best[i])
    kept = np.zeros(len(blocks), bool)
    kept[0] = best[0] > 0
    for i in range(1, len(blocks)):
        kept[i] = kept[blocks[i].parent] and best[i] > 0
    return kept
