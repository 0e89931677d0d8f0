"""Near-duplicates of embeddings by spherical-cap filters with random product codes.

Filters. A unit vector is turned at random and cut into two halves; each half has a code of
random directions, and a filter is a pair of them, one for each half. A vector is filed under
every filter whose direction it exceeds the cap's height with. The filters are list-decoded:
both halves' inner products are sorted, and a pair is expanded only while the sum can still
exceed the height, so that the cost follows the list, not the number of filters. Two vectors
with cosine c exceed the same filter far more often than two unrelated ones; height and code
size follow from the number of vectors so that a filter holds about ``CAP_ROWS`` unrelated
vectors and ``SHARE`` of pairs at the very limit share a filter; closer pairs share more.

Join. Rows meet by filter and every pair is verified with double-precision cosines. A pair
counts only under the first filter that both have. Equal vectors are combined before and
weigh as many as they are. A filter with many rows is cut into parts, and every two parts are
compared in a task of their own; tasks return link counts and spanning stars, never pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing and keep
their row; so do vectors with a null id, whose component is null if it has no other member.
Vectors of different lengths never link. Rows with the same id and different vectors are
counted as different vectors. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.llm.common import component_of, links_to_labels, materialize

MIN_COSINE = 0.9
CAP_ROWS = 256
SHARE = 0.95
PART_ROWS = 2048
SEED = 17


def _tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def _shared_tail(height: float, cosine: float) -> float:
    """P(both of two unit normals with correlation ``cosine`` exceed ``height``)."""
    x = height + (np.arange(2000) + 0.5) * 0.004
    inner = (height - cosine * x) / math.sqrt(max(1e-12, 1 - cosine**2))
    return float(sum(math.exp(-(a**2) / 2) / math.sqrt(2 * math.pi) * _tail(b) for a, b in zip(x, inner)) * 0.004)


class CapFilters:
    """Random product code over unit vectors of ``size`` components."""

    def __init__(self, size: int, height: float, code: int, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        self.half = max(1, size // 2)
        halves = (rng.standard_normal((code, self.half)), rng.standard_normal((code, max(1, size - self.half))))
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2) for c in halves]
        self.code, self.height = code, height / math.sqrt(size)

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter that a row exceeds, by row."""
        turned = units @ self.turn
        right_part = turned[:, self.half :] if turned.shape[1] > self.half else np.zeros((len(turned), 1))
        left, right = turned[:, : self.half] @ self.codes[0].T, right_part @ self.codes[1].T
        order = np.argsort(-right, axis=1)
        sorted_right = np.take_along_axis(right, order, axis=1)
        row, first = np.nonzero(left + sorted_right[:, :1] >= self.height)
        rows, filters = [], []
        depth = 0
        while len(row):
            rows.append(row)
            filters.append(first * self.code + order[row, depth])
            depth += 1
            if depth == self.code:
                break
            on = left[row, first] + sorted_right[row, depth] >= self.height
            row, first = row[on], first[on]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        r, f = np.concatenate(rows), np.concatenate(filters)
        by = np.lexsort((f, r))
        return r[by], f[by]


def plan_filters(rows: int, size: int, cosine: float = MIN_COSINE) -> tuple[float, int]:
    """Cap height, in standard deviations of a random direction, and code size of each half.

    The height follows from the number of rows. The code starts at what independent normal
    products would need, and grows until ``SHARE`` of a fixed set of pairs at the limit have a
    filter in common: the directions of a product code are not independent, and in few
    dimensions inner products are far from normal.
    """
    height = 1.5
    while rows * _tail(height) > CAP_ROWS and height < 5.5:
        height += 0.05
    height = min(height, 0.5 * math.sqrt(size))
    rng = np.random.default_rng(SEED + 1)
    x = rng.standard_normal((500, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    first = code = max(6, math.ceil(math.sqrt(3 / _shared_tail(height, cosine))))
    while True:
        filters = CapFilters(size, height, code)
        (rx, fx), (ry, fy) = filters.decode(x), filters.decode(y)
        both = np.intersect1d(rx * code**2 + fx, ry * code**2 + fy) // code**2
        if len(np.unique(both)) >= SHARE * len(x) or code > 6 * first:
            return height, code
        code = math.ceil(code * 1.15)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _distinct(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(code, copies, first key, vector) of distinct usable vectors; (key, code) of every row, null if unusable."""
    good = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("_v")).withColumn("_ok", F.coalesce(good, F.lit(False)))
    marked = rows.withColumn("code", F.when(F.col("_ok"), F.struct(F.xxhash64("_v").alias("a"), F.xxhash64(F.reverse("_v"), F.size("_v")).alias("b"))))
    members = materialize(marked.select("key", "code"), "members")
    reps = marked.filter("_ok").groupBy("code").agg(F.min("key").alias("first"), F.count("*").alias("copies"), F.first("_v").alias("vector"))
    return materialize(reps, "vectors"), members


def link_vectors(reps: DataFrame, cosine: float = MIN_COSINE, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b, links) from ``reps`` (code, copies, vector): a's links found in a task, and a link to b, or null."""
    counted = reps.groupBy(F.size("vector").alias("size")).count().collect()  # one row a length
    plans = {size: plan_filters(n, size, cosine) for size, n in counted}

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = {}
        for pdf in batches:
            for size, same in pdf.groupby(pdf["vector"].map(len)):
                for i in range(0, len(same), 1024):
                    part = same.iloc[i : i + 1024]
                    units = _units(np.stack(part["vector"].to_numpy()))
                    if size not in filters:
                        filters[size] = CapFilters(size, *plans[size])
                    row, found = filters[size].decode(units)
                    starts = np.searchsorted(row, np.arange(len(part) + 1))
                    yield pd.DataFrame({"a": part["a"], "b": part["b"], "copies": part["copies"], "size": size, "filters": [found[s:e].astype(np.int32) for s, e in zip(starts, starts[1:])], "unit": list(units)})

    rows = reps.select("code.a", "code.b", "copies", "vector").mapInPandas(file, "a long, b long, copies long, size int, filters array<int>, unit array<double>")
    filed = materialize(rows, "filed")
    keys = filed.select("size", "a", F.explode("filters").alias("filter"))
    # only filters with two rows or more matter; the large ones are cut
    shared = keys.groupBy("size", "filter").agg(F.count("*").alias("n")).filter("n > 1").select("size", "filter", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    placed = filed.withColumn("filter", F.explode("filters")).join(shared, ["size", "filter"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = spread.select("size", "filter", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "a", "b", "copies", "filters", "unit")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, this = pdf["p"].iat[0], pdf["q"].iat[0], pdf["filter"].iat[0]
        left = pdf[pdf["own"] == p].reset_index(drop=True)
        right = left if p == q else pdf[pdf["own"] == q].reset_index(drop=True)
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("a1", "a2", "b1", "b2", "links")})
        sims = np.stack(left["unit"].to_numpy()) @ np.stack(right["unit"].to_numpy()).T
        near = sims >= cosine
        i, j = np.nonzero(np.triu(near, k=1) if p == q else near)
        lf, rf = left["filters"].to_numpy(), right["filters"].to_numpy()
        first = _first_common(lf, rf, i, j) == this
        i, j = i[first], j[first]
        offset = 0 if p == q else len(left)
        both = left if p == q else pd.concat([left, right], ignore_index=True)
        j = j + offset
        copies = both["copies"].to_numpy()
        links = np.bincount(i, weights=copies[j], minlength=len(both)) + np.bincount(j, weights=copies[i], minlength=len(both))
        label = links_to_labels(len(both), i, j)
        hit = np.nonzero(links)[0]
        a, b = both["a"].to_numpy(), both["b"].to_numpy()
        return pd.DataFrame({"a1": a[hit], "a2": b[hit], "b1": a[label[hit]], "b2": b[label[hit]], "links": links[hit].astype(np.int64)})

    found = tasks.groupBy("size", "filter", "p", "q").applyInPandas(verify, "a1 long, a2 long, b1 long, b2 long, links long")
    pair = F.struct(F.col("a1").alias("a"), F.col("a2").alias("b"))
    return found.select(pair.alias("a"), F.struct(F.col("b1").alias("a"), F.col("b2").alias("b")).alias("b"), "links")


def _first_common(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least filter that left[i] and right[j] have in common; their lists ascend."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 4096):
        ii, jj = i[at : at + 4096], j[at : at + 4096]
        rows, r_inv = np.unique(ii, return_inverse=True)
        cols, c_inv = np.unique(jj, return_inverse=True)
        lw, rw = max(len(left[r]) for r in rows), max(len(right[c]) for c in cols)
        lp, rp = np.full((len(rows), lw), -1), np.full((len(cols), rw), -2)
        for k, r in enumerate(rows):
            lp[k, : len(left[r])] = left[r]
        for k, c in enumerate(cols):
            rp[k, : len(right[c])] = right[c]
        same = (lp[r_inv][:, :, None] == rp[c_inv][:, None, :]).any(axis=2)
        out[at : at + 4096] = lp[r_inv, same.argmax(axis=1)]
    return out


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = MIN_COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    reps, members = _distinct(vectors, key, vector)
    links = materialize(link_vectors(reps, cosine), "links")
    counts = links.groupBy(F.col("a").alias("code")).agg(F.sum("links").alias("links"))
    grouped = component_of(reps.select("code", "first", "copies"), "code", links.filter("a <> b").select("a", "b").distinct())
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    found = grouped.join(least, "component").join(counts, "code", "left").select("code", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = members.join(found, "code", "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("key") == component).alias("kept"))
