"""Token counts of document sections by offset-mapped attribution.

A document is encoded once as a whole. The tokens' byte lengths give their character spans,
which are joined with the sections' spans by sorted intervals (two binary searches a section
instead of a comparison of every token with every section). A token that reaches over a
section's border is allocated by an explicit rule:

* ``start``: to the section that holds its first character;
* ``majority``: to the section that holds most of its characters, the earlier one on a tie.

A token that begins inside a character (its bytes are split over tokens) counts as starting
at that character. Sections must be sorted and must not overlap; tokens outside all of them
are reported as section -1.

Nulls: a null text counts as empty; a null or empty list of sections leaves all tokens in
section -1. A document without any token and section gives one row with section -1 and zero
tokens, so that no document is lost. Repeated rows each give their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motioncat.llm.bpe import library_encoder, vocabulary
from motioncat.llm.common import slices, texts_of

RULES = ("start", "majority")
SLICE_CHARS = 1_000_000


def cut_at(text: str, separator: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pieces of ``text`` that end with ``separator``; the last may lack it."""
    cuts, at = [0], text.find(separator)
    while at >= 0:
        cuts.append(at + len(separator))
        at = text.find(separator, cuts[-1])
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return np.array(cuts[:-1], dtype=np.int64), np.array(cuts[1:], dtype=np.int64)


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 character of every token."""
    stops = np.cumsum(sizes[ids])
    starts = stops - sizes[ids]
    raw = text.encode()
    if len(raw) == len(text):
        return starts, stops
    leads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(leads)])  # characters that begin before a byte
    return upto[starts + 1] - 1, upto[stops]


def attribute(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token (-1: none), and whether it reaches over a border of one."""
    none = np.full(len(starts), -1)
    if not len(low):
        return none, np.zeros(len(starts), bool)
    first = np.searchsorted(high, starts, side="right")  # first section that ends behind the start
    last = np.searchsorted(low, ends, side="left") - 1  # last section that begins before the end
    home = np.where((first < len(low)) & (low[np.minimum(first, len(low) - 1)] <= starts), first, -1)
    inside = (home >= 0) & (high[np.maximum(home, 0)] >= ends)
    crossing = ~inside & (last >= first)
    if rule == "majority":
        for t in np.nonzero(crossing)[0]:
            s = np.arange(first[t], last[t] + 1)
            share = np.minimum(high[s], ends[t]) - np.maximum(low[s], starts[t])
            outside = ends[t] - starts[t] - share.sum()
            home[t] = s[share.argmax()] if share.max() >= outside else -1
    return home, crossing


def count_tokens(docs: DataFrame, sections: str | None = None, key: str = "doc_id", text: str = "text", rule: str = "majority", separator: str = "\n", path: str | None = None) -> DataFrame:
    """(key, section, start, end, n_tokens, n_crossing) for every section of every document.

    ``sections`` names an array<struct<start,end>> column of character spans; without it the
    sections are what ``separator`` cuts the text into, lines as it stands. ``n_crossing`` counts the allocated tokens that reach over a border. Section -1 is reported where it has tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = library_encoder(path), vocabulary(path).sizes
        for batch in batches:
            texts, spans = texts_of(batch.column(1)), batch.column(batch.num_columns - 1)
            for i, j in slices(map(len, texts), SLICE_CHARS):
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                for k, given in zip(range(i, j), spans[i:j].to_pylist() if sections else [None] * (j - i)):
                    if sections is None:
                        low, high = cut_at(texts[k], separator)
                    else:
                        low = np.array([s["start"] for s in given or []], dtype=np.int64)
                        high = np.array([s["end"] for s in given or []], dtype=np.int64)
                    starts, ends = token_spans(texts[k], encode(texts[k]), sizes)
                    home, crossing = attribute(starts, ends, low, high, rule)
                    counts = np.bincount(home + 1, minlength=len(low) + 1)
                    crossed = np.bincount(home[crossing] + 1, minlength=len(low) + 1)
                    skip = 1 if len(low) and not counts[0] else 0
                    n = len(low) + 1 - skip
                    own = np.arange(-1 + skip, len(low))
                    edges = [np.concatenate([[0], low])[skip:], np.concatenate([[len(texts[k])], high])[skip:]]
                    for column, values in zip(columns, [np.full(n, k), own, *edges, counts[skip:], crossed[skip:]]):
                        column.append(values)
                flat = [np.concatenate(c).astype(np.int64) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat[0])), *map(pa.array, flat[1:])], names=["key", "section", "start", "end", "n_tokens", "n_crossing"])

    schema = f"`{key}` {kind}, section long, start long, end long, n_tokens long, n_crossing long"
    return docs.select(key, text, *[sections] * bool(sections)).mapInArrow(run, schema)
