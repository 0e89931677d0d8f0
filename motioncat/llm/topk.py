"""Exact top-k inner products by a pivot-distance index.

Index. Vectors are lifted by one component so that all have the same length; then a greater
inner product with a query means a smaller distance, and the triangle inequality applies.
Every vector is keyed by its nearest pivot and its distance to it. The distances under a pivot
are cut into rings (annuli) at quantiles of a bounded sample; pivots and rings number
``MAX_PIVOTS`` and ``RINGS`` at most, so the directory of rings is bounded, while every vector
is filed. A ring with many vectors is cut into parts, each a task's worth.

Search. By the directory a query's least possible distance to anything in a ring is
max(d(q, pivot) - outer, inner - d(q, pivot), 0). Rings are sorted by it and expanded from the
nearest until they hold ``SEED_ROWS`` vectors, which gives the query a k-th score to beat. Then
only rings whose bound does not exceed the distance of that score are visited, once each; the
search stops there, since no other ring can hold a better vector. Scores are integer inner
products of the vectors themselves; the bounds only decide which rings to read, with a margin
for rounding. Queries are planned and sent in slices of bounded size, packed, one row for a ring and
the queries of a slice that visit it; a ring's part meets them by a join on its number, and only each
query's k best of a part go on, in the second search only those that reach the score to beat.

Vectors that are null, empty, or hold null or non-finite components take no part, neither do
rows with a null id; vectors of different lengths do not meet. Ties go to the smaller id. Rows
that repeat an id are different candidates, except that none of them is a candidate of a query
with that id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from motioncat.llm.common import lowest_hashes, materialize
from motioncat.session import small_side

MAX_PIVOTS = 256
RINGS = 16
SAMPLE_ROWS = 16384
PART_ROWS = 4096
SEED_ROWS = 2048
QUERY_ROWS = 4096
# Queries are planned so many at a time, and rows of a plan are handed on in frames of about so many bytes.
PLANNED_AT_ONCE = 64
PLAN_BYTES = 4 << 20
# So many lengths at most get a directory of their own; the vectors of each further length are one ring.
INDEXED_LENGTHS = 64
SAFE = float(1 << 52)


def quantised(vector: str, scale: int = 256) -> Column:
    """Components as floor(scale * x); null if any is null or not finite, or there are none."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0)
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-numbered doubles; they must fit in 64 bits."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= SAFE:
        exact = np.vectorize(int, otypes=[object])
        return (exact(a) @ exact(b).T).astype(np.int64)
    return (a @ b.T).astype(np.int64)


class Directory:
    """Pivots and rings over lifted vectors; fitted on a sample, it files every vector."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int) -> None:
        self.longest = longest
        lifted = self.lift(sample)
        chosen = [0]
        gap = ((lifted - lifted[0]) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(lifted)):  # each next pivot is the farthest from those before
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
        self.pivots = lifted[chosen]
        home, distance = self._nearest(lifted)
        self.cuts = np.zeros((len(chosen), RINGS - 1))
        for p in range(len(chosen)):
            own = distance[home == p]
            self.cuts[p] = np.quantile(own, np.arange(1, RINGS) / RINGS) if len(own) else 0.0

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest - (vectors**2).sum(axis=1)))
        return np.hstack([vectors, rest[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        squared = (lifted**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0.0, squared))

    def _nearest(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(lifted)
        home = d.argmin(axis=1)
        return home, d[np.arange(len(d)), home]

    def file(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ring number and distance to its pivot of every vector."""
        home, distance = self._nearest(self.lift(vectors))
        return home * RINGS + (distance[:, None] > self.cuts[home]).sum(axis=1), distance


def _bounds(directory: Directory, queries: np.ndarray, rings: pd.DataFrame) -> np.ndarray:
    """Least possible distance of every query (not lifted: its last component is zero) to every ring."""
    flat = np.hstack([queries, np.zeros((len(queries), 1))])
    d = directory.distances(flat)[:, rings["ring"].to_numpy() // RINGS]
    slack = 1e-7 * (np.sqrt(directory.longest) + np.sqrt((queries**2).sum(axis=1)))[:, None] + 1e-9
    return np.maximum(0.0, np.maximum(d - rings["outer"].to_numpy(), rings["inner"].to_numpy() - d) - slack)


def _packed(queries: np.ndarray) -> tuple[str, bytes]:
    """Whole-numbered doubles as (kind, bytes) in the smallest kind that holds them all."""
    most = np.abs(queries).max(initial=0.0)
    kind = next((k for k in ("int16", "int32") if most <= np.iinfo(k).max), "float64")
    return kind, queries.astype(kind).tobytes()


def _plan(queries: DataFrame, visits: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """One row for every ring and the queries of a slice that ``visits`` (rows of the slice, rings) sends there.

    A query's vector travels packed, with the score it has to beat (``kth``, NaN if none). Slices and frames are
    bounded, as a query may visit every ring.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), PLANNED_AT_ONCE):
                part = pdf.iloc[i : i + PLANNED_AT_ONCE]
                row, ring = visits(part)
                order = np.lexsort((row, ring))
                row, ring = row[order], ring[order]
                ids, rows, kth = (part[c].to_numpy() for c in ("query_id", "query_row", "kth"))
                vectors, out, size = part["query"].to_numpy(), [], 0
                starts = np.flatnonzero(np.diff(ring, prepend=-1))
                for s, e in zip(starts, np.append(starts[1:], len(ring))):
                    own = row[s:e]
                    kind, packed = _packed(np.stack(vectors[own]))
                    out.append((ring[s], ids[own].astype("int64").tobytes(), rows[own].astype("int64").tobytes(), kth[own].astype("float64").tobytes(), kind, packed))
                    size += len(packed)
                    if size > PLAN_BYTES:
                        yield pd.DataFrame(out, columns=PLAN)
                        out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=PLAN)

    return queries.mapInPandas(run, "ring int, query_id binary, query_row binary, kth binary, kind string, query binary")


PLAN = ["ring", "query_id", "query_row", "kth", "kind", "query"]


def _k_best(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest of every row of ``scores`` that reach ``least``; of equal ones the first columns."""
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def _search(plan: DataFrame, filed: DataFrame, batches: int, k: int) -> DataFrame:
    """Each query's k best within every part of a ring that ``plan`` sends it to, those only that reach the score it has to beat.

    Vectors and plans are never broadcast, however small their files: whole numbers pack well on disk only.
    """
    parts = small_side(filed.groupBy("ring").agg((F.max("part") + 1).alias("parts")))
    sent = plan.withColumn("batch", F.pmod(F.xxhash64("query_row"), F.lit(batches)).cast("int")).hint("merge").join(parts, "ring")
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visited = small_side(sent.select("ring", "part", "batch").distinct())
    placed = filed.select("ring", "part", "vec_id", "vector").hint("merge").join(visited, ["ring", "part"])

    def meet(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_row", "vec_id", "score")})
        if queries.empty or vectors.empty:
            return none
        ids = vectors["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, matrix = ids[by_id], np.stack(vectors["vector"].to_numpy())[by_id]
        out = [none]
        for q, rows, kth, kind, packed in zip(*(queries[c] for c in PLAN[1:])):
            q, rows, kth = np.frombuffer(q, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(kth, np.float64)
            scores = _products(np.frombuffer(packed, kind).reshape(len(q), -1).astype(float), matrix)
            low, high = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
            own = np.flatnonzero(low < high)
            least = np.full(len(q), np.iinfo(np.int64).min + 1)
            for i in own:  # a query's own rows take no part
                scores[i, low[i] : high[i]] = np.iinfo(np.int64).min
            known = ~np.isnan(kth)
            # beyond 53 bits a double may lie above the score it stands for
            least[known] = np.where(np.abs(kth[known]) < 2.0**53, kth[known], np.nextafter(kth[known], -np.inf)).astype(np.int64)
            if not known.all() and len(ids) > k:
                least[~known] = np.maximum(least[~known], np.partition(scores[~known], len(ids) - k, axis=1)[:, len(ids) - k])
            row, column = _k_best(scores, least, k)
            out.append(pd.DataFrame({"query_id": q[row], "query_row": rows[row], "vec_id": ids[column], "score": scores[row, column]}))
        return pd.concat(out)

    found = sent.groupBy("ring", "part", "batch").cogroup(placed.groupBy("ring", "part", "batch"))
    return found.applyInPandas(meet, "query_id long, query_row long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the greatest integer inner product for each query row."""
    usable = vectors.select(F.col(key).cast("long").alias("vec_id"), quantised(vector, scale).alias("vector")).filter("vec_id is not null and vector is not null")
    asked = queries.select(F.col(key).cast("long").alias("query_id"), quantised(vector, scale).alias("query")).filter("query_id is not null and query is not null")
    usable = materialize(usable, "vectors")
    numbered = asked.withColumn("query_row", F.monotonically_increasing_id())
    asked = materialize(numbered.withColumn("kth", F.lit(None).cast("double")), "queries")
    batches = max(1, math.ceil(asked.count() / QUERY_ROWS))
    lengths = usable.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("longest"))
    lengths = materialize(lengths, "lengths")
    sizes = lengths.orderBy(F.desc("n"), "size").limit(INDEXED_LENGTHS).collect()
    indexed = [size for size, _, _ in sizes]
    out = _by_length(usable.filter(~F.size("vector").isin(indexed)), asked.filter(~F.size("query").isin(indexed)), lengths, batches, k)
    for size, n, longest in sizes:
        own = usable.filter(F.size("vector") == size)
        out = out.unionByName(_top_k(own, asked.filter(F.size("query") == size), n, float(longest), batches, k))
    best = F.row_number().over(_by_score())
    return out.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _by_length(vectors: DataFrame, queries: DataFrame, lengths: DataFrame, batches: int, k: int) -> DataFrame:
    """Search among the vectors of lengths that have no directory: all of one length are one ring."""
    cut = lengths.select(F.col("size").alias("ring"), F.ceil(F.col("n") / PART_ROWS).alias("cut"))
    filed = vectors.withColumn("ring", F.size("vector")).join(cut, "ring").withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), "cut").cast("int")).drop("cut")

    def visits(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(part)), part["query"].map(len).to_numpy(dtype=int)

    return _search(_plan(queries, visits), materialize(filed, "rings"), batches, k)


def _by_score() -> WindowSpec:
    return Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")


def _top_k(vectors: DataFrame, queries: DataFrame, n: int, longest: float, batches: int, k: int) -> DataFrame:
    spark = vectors.sparkSession
    sample = lowest_hashes(vectors, "vec_id", SAMPLE_ROWS).select("vector").collect()
    pivots = max(1, min(MAX_PIVOTS, math.isqrt(n) // 8))
    shared = spark.sparkContext.broadcast(Directory(np.array([r["vector"] for r in sample]), longest, pivots))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                part = pdf.iloc[i : i + 4096]
                ring, distance = shared.value.file(np.stack(part["vector"].to_numpy()))
                yield part.assign(ring=ring.astype("int32"), distance=distance)

    filed = materialize(vectors.mapInPandas(file, "vec_id long, vector array<double>, ring int, distance double"), "rings")
    rings = filed.groupBy("ring").agg(F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.count("*").alias("n")).toPandas()  # bounded
    rings = rings.sort_values("ring").reset_index(drop=True)
    parts = F.create_map(*[x for r, c in zip(rings["ring"], rings["n"]) if c > PART_ROWS for x in (F.lit(int(r)), F.lit(math.ceil(c / PART_ROWS)))])
    cut = F.coalesce(parts[F.col("ring")], F.lit(1)) if (rings["n"] > PART_ROWS).any() else F.lit(1)
    filed = filed.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), cut).cast("int"))

    names, counts = rings["ring"].to_numpy(), rings["n"].to_numpy()

    def ordered(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least distance of every query to every ring, the rings by it, and how many vectors nearer rings hold."""
        bounds = _bounds(shared.value, q, rings)
        order = np.argsort(bounds, axis=1, kind="stable")
        return bounds, order, np.cumsum(counts[order], axis=1) - counts[order]

    def seeds(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        _, order, before = ordered(np.stack(part["query"].to_numpy()))
        row, place = np.nonzero(before < SEED_ROWS)
        return row, names[order[row, place]]

    queries = queries.repartition(spark.sparkContext.defaultParallelism, "query_row")
    first = _search(_plan(queries, seeds), filed, batches, k)
    first = materialize(first, "first")
    ranked = first.withColumn("place", F.row_number().over(_by_score())).filter(F.col("place") <= k)
    known = ranked.groupBy("query_row").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    # a query with fewer than k seeds has no score to beat and visits every ring

    def rest(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        q = np.stack(part["query"].to_numpy())
        bounds, order, before = ordered(q)
        visited = np.zeros_like(bounds, bool)
        np.put_along_axis(visited, order, before < SEED_ROWS, axis=1)
        kth = part["kth"].to_numpy(dtype=float)
        squared = longest + (q**2).sum(axis=1) - 2 * kth  # distance of a vector with that score
        reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(0.0, squared)) * (1 + 1e-9))
        row, place = np.nonzero((bounds <= reach[:, None]) & ~visited)
        return row, names[place]

    again = queries.drop("kth").hint("merge").join(known.withColumn("kth", F.col("kth").cast("double")), "query_row", "left")
    return ranked.drop("place").unionByName(_search(_plan(again, rest), filed, batches, k))
