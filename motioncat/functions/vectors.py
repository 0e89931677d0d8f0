"""Expressions on embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
EPSILON = 1e-8
CROP_PIXELS = 224 * 224
SHARPNESS_SCALE = 100.0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled(a: Column, by: Column) -> Column:
    return let(by, lambda k: F.transform(a, lambda x: x * k))


def unit(a: Column, epsilon: float = 0.0) -> Column:
    """Vector divided by its length (plus ``epsilon``); a zero vector stays zero."""
    length = norm(a) + F.lit(epsilon)
    return scaled(a, F.coalesce(F.lit(1.0) / F.nullif(length, F.lit(0.0)), F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def variance(a: Column) -> Column:
    """Population variance of the components, null for an empty vector."""
    spread = let(mean(a), lambda m: _sum(F.transform(a, lambda x: (x - m) * (x - m))))
    return F.when(F.size(a) > 0, spread / F.size(a))


def fit_length(a: Column, dim: int) -> Column:
    """Repeat or cut a vector to ``dim`` components."""
    times = F.ceil(F.lit(dim) / F.size(a)).cast("int")
    return F.slice(F.flatten(F.array_repeat(a, times)), 1, dim)


def combine(vectors: list[Column], weights: list[float], dim: int) -> Column:
    """Weighted sum of vectors brought to ``dim`` components, scaled to unit length."""
    total = sum(weights)
    parts = [scaled(fit_length(v, dim), F.lit(w / total)) for v, w in zip(vectors, weights)]
    mixed = parts[0]
    for part in parts[1:]:
        mixed = F.zip_with(mixed, part, lambda x, y: x + y)
    return let(mixed, unit)


def quality(embedding: Column, area: Column, sharpness: Column) -> Column:
    """Mean of crop size, sharpness and closeness to unit length, each capped to [0, 1]."""
    size = F.least(F.lit(1.0), area / F.lit(float(CROP_PIXELS)))
    sharp = F.least(F.lit(1.0), sharpness / SHARPNESS_SCALE)
    length = F.greatest(F.lit(0.0), 1.0 - F.abs(1.0 - norm(embedding)))
    return (size + sharp + length) / 3


def variance_quality(embedding: Column) -> Column:
    return F.least(F.lit(1.0), variance(embedding) * 10)
