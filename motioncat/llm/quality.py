"""Quality by ordinal cumulative-link regression on graded ratings.

Features of a text, hashed: the words themselves, their first four letters and their shapes
(runs of letters and digits as one sign, other characters as they are), each as its share of
all words, and a few coarse traits of the whole (share of distinct words, of repeated
neighbours, of capitals). One weight vector and ordered thresholds give the expected grade and
P(grade >= g); a text is kept if P(grade > least) reaches ``KEEP``.

Grades of the query: 0 = labelled poor; 1 = good but toxic; 2 = good. The model is fitted on
``SAMPLE_DOCUMENTS`` labelled documents at most (those whose ids hash lowest).

Nulls: a null text counts as empty and is scored like one. Labels without an id or grade are
left out; several labels of one id count as their least grade. Without labels, or with one
grade only, that grade is predicted for all and everything is kept. Repeated rows each get
their row; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.llm.ordinal import CACHED_TOKENS, SAMPLE_DOCUMENTS, OrdinalModel, bucket, fit_ordinal, keep_rows, sample_features, score

KEEP = 0.3
STEP, L1 = 1.0, 25.0
SCALE = 20.0
_RUNS = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"))


def shape(word: str) -> str:
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word[:12]


def word_features(word: str) -> list[str]:
    low = word.lower()
    return [f"w:{low}", f"p:{low[:4]}", f"s:{shape(word)}"]


@lru_cache(maxsize=CACHED_TOKENS)
def word_buckets(word: str) -> list[int]:
    return [bucket(f) for f in word_features(word)]


def text_traits(words: list[str], text: str) -> list[str]:
    n = len(words)
    if not n:
        return ["empty"]
    same = sum(a == b for a, b in zip(words, words[1:]))
    capitals = sum(w.isupper() for w in words)
    return [f"distinct:{10 * len(set(words)) // n}:{min(12, n.bit_length())}", f"same:{(10 * same + n - 1) // n}", f"capitals:{(10 * capitals + n - 1) // n}"]


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text."""
    words = text.split()
    total: dict[int, float] = {}
    for w in words:
        for b in word_buckets(w):
            total[b] = total.get(b, 0.0) + SCALE / len(words)
    for f in text_traits(words, text):
        b = bucket(f)
        total[b] = total.get(b, 0.0) + 1.0
    return np.array(list(total), np.int64), np.array(list(total.values()), np.float32)


def latent_of(weights: dict[int, float]) -> Callable[[str], float]:
    """w.x of a text; the weights of a word's features are summed once per word."""
    known: dict[str, float] = {}

    def latent(text: str) -> float:
        words = text.split()
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHED_TOKENS:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = sum(weights.get(bucket(f), 0.0) for f in word_features(w))
            found = list(map(known.__getitem__, words))
        traits = sum(weights.get(bucket(f), 0.0) for f in text_traits(words, text))
        return traits + (SCALE * sum(found) / len(words) if words else 0.0)

    return latent


def grades(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade) from 0/1 columns ``quality`` and ``toxic``."""
    good = F.when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return labels.filter("quality is not null").select(key, F.when(F.col("quality") > 0, good).otherwise(0).alias("grade"))


def fit_quality(docs: DataFrame, rated: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SAMPLE_DOCUMENTS) -> OrdinalModel:
    """Fit on ``rated`` (key, grade)."""
    return fit_ordinal(*sample_features(docs, rated, vector, key, text, limit), alpha=STEP, l1=L1)


def rate_quality(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """(key, expected_grade, tail array<double>, kept) for every row."""
    scored = score(docs, model, latent_of, key, text)
    kept = (F.size("tail") == 0) | (F.get("tail", F.lit(0)) >= keep)
    return scored.select(key, F.col("expected").alias("expected_grade"), "tail", kept.alias("kept"))


def keep_good(docs: DataFrame, model: OrdinalModel, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return keep_rows(docs, model, latent_of, text, lambda p: p >= keep)
