"""Main text of web pages by gradient-boosted trees over DOM blocks and hierarchical decoding.

A page is parsed into blocks (elements that break lines). Each gets features of its subtree
(text, density, links, punctuation), its attribute tokens (as log-odds learned in training),
its depth and its siblings. Boosted trees give every block a logit; decoding takes the best
choice for the whole tree in which nothing is kept below a block that is not, by one pass up
and one down, so that ancestors and descendants never contradict each other.

The trees are trained on labelled pages: layouts of many kinds (``html_templates``) written
around sentences of ``SAMPLE_PAGES`` pages of the table at most (those of at
most ``SAMPLE_CHARS`` characters whose ids hash lowest), and those of the sampled pages whose markup names exactly one article.

Character references are decoded, white space inside a block becomes one space (as Unicode
defines it, no-break spaces included), blocks are joined in page order by one space. Text of
scripts, styles, templates, titles and the like is never part of a page's text.

Nulls: a null or empty page has the empty text; so has one with nothing but markup. Broken
markup is read as far as it goes. Repeated rows each get their row; an empty table gives no
rows. Other columns are carried only where asked for.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.llm.boosting import Trees, boost
from motioncat.llm.common import lowest_hashes, slices, texts_of
from motioncat.llm.html_dom import PageParser, decode, features, lines_of, parse
from motioncat.llm.html_templates import Page

SAMPLE_PAGES = 300
SAMPLE_CHARS = 100_000
TRAINING_PAGES = 800
SLICE_CHARS = 1_000_000
_MARK = re.compile(r" ?\[\[(\d+)\]\]")


@dataclass
class PageModel:
    odds: dict[str, float]
    trees: Trees


def training_page(rng: random.Random, sentences: list[str]) -> tuple[PageParser, np.ndarray, list[str]]:
    """A parsed page, which blocks belong to the article or hold it, and the article's lines."""
    made = Page(rng, sentences)
    html = made.html()
    page = parse(html)
    main, lines = np.zeros(len(page.blocks), bool), []
    for n, line in enumerate(page.lines):
        text = "".join(t for _, t in line)
        marks = [int(m) for m in _MARK.findall(text)]
        if any(m not in made.other for m in marks):
            for at, _ in line:
                main[at] = True
            lines.append(" ".join(_MARK.sub("", text).split()))
        page.lines[n] = [(at, _MARK.sub("", t)) for at, t in line]
    for i in range(len(page.blocks) - 1, 0, -1):
        main[page.blocks[i].parent] |= main[i]
    return page, main, lines


def sentences_of(page: PageParser) -> list[str]:
    """Up to 20 sentences, whatever part of the page they stand in."""
    text = [" ".join("".join(t for _, t in line).split()) for line in page.lines]
    return [s for line in text if len(line) > 40 for s in re.split(r"(?<=[.!?]) ", line) if 8 < len(s) < 400][:20]


def labelled_by_markup(page: PageParser) -> np.ndarray | None:
    """Which blocks belong to the one article that the page's own markup names, if it names one."""
    marked = [i for i, b in enumerate(page.blocks) if b.tag == "article"] or [i for i, b in enumerate(page.blocks) if b.tag == "main"]
    if len(marked) != 1:
        return None
    main = np.zeros(len(page.blocks), bool)
    for i, block in enumerate(page.blocks):
        other = block.tag in ("nav", "aside", "form", "footer", "button", "menu")
        main[i] = i == marked[0] or (i > 0 and main[block.parent] and not other)
    for i in range(marked[0], 0, -1):
        main[page.blocks[i].parent] |= main[i]
    return main


@lru_cache(maxsize=4)
def fit_pages(htmls: tuple[str, ...], pages: int = TRAINING_PAGES, seed: int = 3) -> PageModel:
    """Train on invented layouts around the sample's sentences, and on sampled pages that name their article."""
    rng = random.Random(seed)
    given = [parse(h) for h in htmls]
    sentences = [s for page in given for s in sentences_of(page)] or ["A sentence of some words.", "Another one, of a few more words than that.", "Words follow words here, until the line ends."]
    shown = [training_page(rng, sentences)[:2] for _ in range(pages)]
    shown += [(page, main) for page in given if (main := labelled_by_markup(page)) is not None]
    yes, no = Counter(), Counter()
    for page, main in shown:
        for block, m in zip(page.blocks, main):
            (yes if m else no).update(set(block.tokens))
    many_yes, many_no = sum(m.sum() for _, m in shown), sum((~m).sum() for _, m in shown)
    odds = {t: math.log((yes[t] + 0.5) / (many_yes + 1)) - math.log((no[t] + 0.5) / (many_no + 1)) for t in yes | no if yes[t] + no[t] >= 4}
    x = np.concatenate([features(page, odds) for page, _ in shown])
    y = np.concatenate([main for _, main in shown]).astype(float)
    weight = np.concatenate([[0.3 + math.log1p(b.own) / 4 for b in page.blocks] for page, _ in shown])
    return PageModel(odds, boost(x, y, weight))


def sample_pages(pages: DataFrame, key: str = "page_id", html: str = "html", limit: int = SAMPLE_PAGES) -> tuple[str, ...]:
    """Pages to train on: those of at most ``SAMPLE_CHARS`` characters whose ids hash lowest."""
    rows = lowest_hashes(pages.select(key, html).filter(F.length(html) <= SAMPLE_CHARS), key, limit).select(html).collect()
    return tuple(sorted(row[0] for row in rows))


def main_texts(htmls: list[str], model: PageModel) -> list[str]:
    pages = [parse(h) for h in htmls]
    if not pages:
        return []
    logits = model.trees.logits(np.concatenate([features(p, model.odds) for p in pages]))
    ends = np.cumsum([len(p.blocks) for p in pages])
    return [" ".join(lines_of(p, decode(p, logits[e - len(p.blocks) : e]))) for p, e in zip(pages, ends)]


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = (), model: PageModel | None = None) -> DataFrame:
    """(key, carried columns, text) for every row."""
    if model is None:
        model = fit_pages(sample_pages(pages, key, html))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = texts_of(batch.column(batch.num_columns - 1))
            for i, j in slices(map(len, htmls), SLICE_CHARS):
                texts = pa.array(main_texts(htmls[i:j], shared.value), pa.string())
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:-1]), texts], names=[f"c{n}" for n in range(batch.num_columns)])

    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, *carry)]
    return pages.select(key, *carry, html).mapInArrow(run, ", ".join([*fields, "text string"]))
