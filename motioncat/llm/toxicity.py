"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text, hashed: its distinct words, lower-cased and cut at characters other than
letters, and their first four letters; each counts once for every distinct word that has it.
The L1 term leaves all but telling words without weight, so length alone neither raises nor
lowers a text's severity. Output: expected severity and P(severity >= g); a text is toxic if
P(severity > least) reaches ``REJECT``.

Severities of the query: 0 = not toxic; 1 = toxic; 2 = toxic and of poor quality; those that
occur in the labels are fitted, on ``SAMPLE_DOCUMENTS`` labelled documents at most.

Nulls: a null text counts as empty. Labels without an id or grade are left out; several labels
of one id count as their least severity. Without labels, or with one severity only, that one
is predicted and nothing is called toxic. Repeated rows each get their row; other columns do
not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.llm.ordinal import CACHED_TOKENS, SAMPLE_DOCUMENTS, OrdinalModel, bucket, fit_ordinal, keep_rows, sample_features, score

REJECT = 0.5
STEP, L1 = 3.0, 12.0
PREFIX = 4
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[str, ...]:
    return (f"w:{word}", f"p:{word[:PREFIX]}") if len(word) > PREFIX else (f"w:{word}",)


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text."""
    total: dict[int, float] = {}
    for w in set(_WORD.findall(text.lower())):
        for f in word_features(w):
            b = bucket(f)
            total[b] = total.get(b, 0.0) + 1.0
    return np.array(list(total), np.int64), np.array(list(total.values()), np.float32)


def latent_of(weights: dict[int, float]) -> Callable[[str], float]:
    known: dict[str, float] = {}

    def latent(text: str) -> float:
        total = 0.0
        for w in sorted(set(_WORD.findall(text.lower()))):
            value = known.get(w)
            if value is None:
                if len(known) > CACHED_TOKENS:
                    known.clear()
                value = known[w] = sum(weights.get(bucket(f), 0.0) for f in word_features(w))
            total += value
        return total

    return latent


def severities(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade) from 0/1 columns ``quality`` and ``toxic``."""
    worse = F.when(F.coalesce("quality", F.lit(1)) > 0, 1).otherwise(2)
    return labels.filter("toxic is not null").select(key, F.when(F.col("toxic") > 0, worse).otherwise(0).alias("grade"))


def fit_toxicity(docs: DataFrame, rated: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SAMPLE_DOCUMENTS) -> OrdinalModel:
    """Fit on ``rated`` (key, grade)."""
    return fit_ordinal(*sample_features(docs, rated, vector, key, text, limit), alpha=STEP, l1=L1)


def rate_toxicity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text", reject: float = REJECT) -> DataFrame:
    """(key, severity, tail array<double>, toxic) for every row."""
    scored = score(docs, model, latent_of, key, text)
    toxic = (F.size("tail") > 0) & (F.get("tail", F.lit(0)) >= reject)
    return scored.select(key, F.col("expected").alias("severity"), "tail", toxic.alias("toxic"))


def keep_civil(docs: DataFrame, model: OrdinalModel, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    return keep_rows(docs, model, latent_of, text, lambda p: p < reject)
