"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.operators.graph import connected_components
from motioncat.session import materialize


def slices(sizes: Iterable[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges whose sizes sum to about ``budget``, one item at least."""
    start = total = end = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= budget:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


def lowest_hashes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows whose ``key`` hashes lowest.

    In a large table only rows below a hash that about twice as many pass are looked at, so
    that a task hands on its share of them and not ``limit`` rows of its own. Where too few rows
    pass, since keys repeat, all are looked at; the rows chosen are the same.
    """
    n = rows.count()
    if n > 4 * limit:
        below = rows.filter(F.xxhash64(key) < -(1 << 63) + (2 * limit + 100) * (1 << 64) // n)
        if below.count() >= limit:
            rows = below
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of a text column; a null text counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def byte_slices(column: pa.ChunkedArray | pa.Array, budget: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, UTF-8 texts) of consecutive rows that hold about ``budget`` bytes; a null counts as empty.

    Lengths are read from the Arrow column, so only one slice at a time becomes Python objects.
    """
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    lengths = pc.fill_null(pc.binary_length(raw), 0)
    for start, end in slices(lengths.to_numpy(zero_copy_only=False).tolist(), budget):
        yield start, end, [b"" if t is None else t for t in raw[start:end].to_pylist()]


def links_to_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each item's component, for links a[i]-b[i] among ``n`` items."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def component_of(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``component``, the least node reachable over ``edges`` (a, b); itself if none."""
    found = connected_components(edges).select(F.col("id").alias(node), F.col("component").alias("_component"))
    out = nodes.join(found, node, "left")
    return out.withColumn("component", F.coalesce("_component", node)).drop("_component")


__all__ = ["byte_slices", "component_of", "links_to_labels", "lowest_hashes", "materialize", "slices", "texts_of"]
