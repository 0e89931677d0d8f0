"""Exact all-neighbour work on vectors without a cross join.

Unit vectors are assigned to the nearest of a few pivots (their cell). A vector can have
a neighbour in another cell only if it lies within the search radius of the plane halfway
between the two pivots, so it is sent along as a guest only to such cells. Cells that hold
many rows are divided once more in the same way, by pivots of their own. Cells are cut
into blocks of bounded size; one task compares two blocks, tile by tile with one matrix product
each, and returns only a reduced answer (a count, a minimum, a spanning forest) or the pairs found.

Every visit and every block of a cell is one more copy of a vector on its way, so both are kept
few: of all numbers of pivots that with the fewest copies is taken (vectors without structure get
one cell, cut into blocks), and blocks are as large as a task can hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motioncat.session import materialize, small_side

BLOCK_ROWS = 2048
MAX_PIVOTS = 1024
CANDIDATES = 4  # vectors looked at for each pivot wanted
VISITS, INNER_VISITS = 4, 2  # cells a vector goes to, on average over the candidates
# A cell with more rows gets pivots of its own, about one for every INNER_ROWS of them.
CELL_ROWS = 64 * BLOCK_ROWS
INNER_ROWS = 16 * BLOCK_ROWS
# A block holds so many bytes of vectors at most, and that part of all rows at least.
BLOCK_BYTES, BLOCK_SHARE = 64 << 20, 6
MERGED_TILES = 16
TASK_PAIRS = 1 << 19  # pairs a task hands on at most, a small part of the vectors it was sent
# Cosines are first looked at in single precision, in squares that a core's cache holds; so many close pairs are looked at again at once.
SQUARE, CLOSE_AT_ONCE = 512, 1 << 18
Reducer = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]
PairReducer = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def unit_rows(m: np.ndarray, epsilon: float = 0.0) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True) + epsilon
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def distinct_vectors(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (``id`` = first ord, ``copies``) and the (``ord``, ``id``) membership.

    Copies of one vector share all neighbours, so the heavy work sees them once. They are
    found by two independent 64-bit hashes, so that the vectors themselves move only once.
    """
    key = ["_h1", "_h2"]
    keyed = people.select("ord", F.xxhash64("embedding").alias("_h1"), F.xxhash64(F.reverse("embedding"), F.size("embedding")).alias("_h2"))
    groups = keyed.groupBy(*key).agg(F.min("ord").alias("id"), F.count("*").alias("copies"))
    members = materialize(keyed.join(groups, key).select("ord", "id", "copies"), "members")
    first = members.filter("ord = id").select("id", "copies")
    reps = materialize(first.join(people.select(F.col("ord").alias("id"), "embedding"), "id"), "vectors")
    return reps, members.select("ord", "id")


def _choose_pivots(reps: DataFrame, rows: int, reach: float) -> np.ndarray:
    """Some of the vectors with the smallest hash of their id; their number grows with the root of the table, up to a limit."""
    wanted = max(1, min(MAX_PIVOTS, int(math.sqrt(rows) / 20)))
    picked = reps.orderBy(F.xxhash64("id"), "id").limit(CANDIDATES * wanted).select("embedding").collect()
    candidates = unit_rows(np.array([r.embedding for r in picked], dtype=float))
    return _few_visits(candidates, wanted, reach, VISITS, rows / _block_rows(rows, candidates.shape[1], BLOCK_ROWS))


def _apart(candidates: np.ndarray, wanted: int, reach: float) -> np.ndarray:
    """The first ``wanted`` candidates of which no two are within ``reach``: a close group, which no cells can divide, gets one pivot."""
    kept = [0]
    for i in range(1, len(candidates)):
        if len(kept) == wanted:
            break
        if ((candidates[kept] - candidates[i]) ** 2).sum(axis=1).min() > reach * reach:
            kept.append(i)
    return candidates[kept]


def _few_visits(candidates: np.ndarray, wanted: int, reach: float, visits: int, blocks: float = 0.0) -> np.ndarray:
    """At most ``wanted`` pivots, so few that the candidates go to at most ``visits`` cells on average.

    With ``blocks``, the blocks that all rows fill, a row is sent once for every block of each cell it goes to: of the
    numbers of pivots tried, that with the fewest copies is taken.
    """
    pivots = _apart(candidates, wanted, reach)
    best, fewest = pivots[:1], math.ceil(blocks)
    while len(pivots) > 1:
        cell = _route(candidates, pivots, reach)[1]
        share = np.bincount(cell) / len(candidates)
        copies = float((share * np.ceil(share * blocks)).sum())
        if share.sum() <= visits and copies < fewest:
            best, fewest = pivots, copies
        if share.sum() <= visits and not blocks:
            return pivots
        pivots = pivots[: len(pivots) // 2]
    return best


def _route(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, at home) of every visit: each row goes to its nearest pivot, and as a guest to
    those numbered lower whose cells its neighbours within ``reach`` can belong to."""
    between = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ pivots.T)))
    squared = np.maximum(0.0, 1 + (vectors**2).sum(1, keepdims=True) - 2 * (vectors @ pivots.T))
    home = squared.argmin(axis=1)
    gap = squared - squared[np.arange(len(home)), home][:, None]
    near = gap <= 2 * between[home] * reach + 1e-9
    near &= np.arange(len(pivots))[None, :] <= home[:, None]
    row, cell = np.nonzero(near)
    return row, cell, cell == home[row]


def in_cells(reps: DataFrame, min_cosine: float, epsilon: float = 0.0) -> DataFrame:
    """Rows (cell, home, inner, id, unit vector, other columns): every pair above ``min_cosine`` shares
    exactly one cell in which at least one of the two is at home (on the first level) and at least
    one is at home on the second (``inner``)."""
    rows = reps.count()
    if rows == 0:
        return reps.select(F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), F.lit(True).alias("inner"), "*")
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine)) + 1e-6
    pivots = reps.sparkSession.sparkContext.broadcast(_choose_pivots(reps, rows, reach))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            vectors = unit_rows(matrix(pdf["embedding"]), epsilon)
            row, cell, home = _route(vectors, pivots.value, reach)
            out = pdf.iloc[row].reset_index(drop=True)
            out["embedding"] = list(vectors[row])
            out.insert(0, "cell", cell.astype("int64") * MAX_PIVOTS)
            out.insert(1, "home", home)
            out.insert(2, "inner", True)
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema.fields)
    cells = materialize(reps.mapInPandas(assign, f"cell long, home boolean, inner boolean, {fields}"), "cells")
    large = cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS).collect()  # at most MAX_PIVOTS rows
    return _divided(cells, {r.cell: r.n for r in large}, reach) if large else cells


def _divided(cells: DataFrame, sizes: dict[int, int], reach: float) -> DataFrame:
    """``cells`` with every cell of ``sizes`` divided by pivots among its own rows; the others as they are.

    A cell's rows are dealt over tasks by the hash of their id; every task gets the cell's pivots.
    """
    spark = cells.sparkSession
    plan = [(cell, min(MAX_PIVOTS, math.ceil(n / INNER_ROWS)), math.ceil(n / CELL_ROWS), n) for cell, n in sizes.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "cell long, _wanted long, _tasks long, _n long"))  # at most MAX_PIVOTS rows
    total = sum(sizes.values())
    rows = cells.join(plan, "cell")
    share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    usable = F.col("home") & F.exists("embedding", lambda x: x != 0)
    drawn = rows.filter(usable & (share * F.col("_n") < 2 * CANDIDATES * F.col("_wanted") + 20)).select("cell", "id", "_wanted", "_tasks", "_n", F.col("embedding").alias("pivot"))
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(1)), "id"))
    pivots = drawn.withColumn("nth", nth).filter(F.col("nth") <= CANDIDATES * F.col("_wanted")).select(F.col("cell").alias("at"), "nth", "pivot", "_wanted", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1)).alias("task"))
    dealt = rows.withColumn("_task", F.pmod(F.xxhash64("id"), F.col("_tasks"))).select("_task", *cells.columns)

    def divide(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.drop(columns="_task")
        if left.empty or right.empty:
            return out
        candidates, n = matrix(right.sort_values("nth")["pivot"]), int(right["_n"].iat[0])
        pivots = _few_visits(candidates, int(right["_wanted"].iat[0]), reach, INNER_VISITS, n / _block_rows(total, candidates.shape[1], BLOCK_ROWS))
        row, inner, home = _route(matrix(left["embedding"]), pivots, reach)
        out = out.iloc[row].reset_index(drop=True)
        out["cell"] += inner
        out["inner"] = home
        return out

    parts = dealt.groupBy("cell", "_task").cogroup(pivots.groupBy("at", "task")).applyInPandas(divide, cells.schema)
    kept = cells.join(plan, "cell", "left_anti")
    return materialize(kept.unionByName(parts), "inner-cells")


def _block_rows(rows: int, width: int, tile: int) -> int:
    """Rows of a block: ``BLOCK_BYTES`` of vectors, less for a small table, so that many tasks share its work."""
    return max(tile, min(BLOCK_BYTES // (8 * max(1, width)), math.ceil(rows / BLOCK_SHARE)))


def near_floor(eps: float) -> float:
    """A cosine that every pair within the distance ``eps`` reaches, whatever the rounding; cosines below 0 count as 0."""
    return 1 - eps - 1e-9 if eps < 1 else -math.inf


def _ones(hit: np.ndarray) -> np.ndarray:
    """Flat places of the few true entries of ``hit``, whose number is a multiple of 8: eight at a time are skipped at once."""
    words = np.flatnonzero(hit.reshape(-1).view(np.uint64))
    row, column = np.nonzero(hit.reshape(-1, 8)[words])
    return words[row] * 8 + column


def _close(left: np.ndarray, right: np.ndarray, floor: float, margin: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all rows of ``left`` and ``right`` (single precision) whose product may reach ``floor``; if ``same``, i < j only."""
    least = np.float32(floor - margin)
    product = np.empty((SQUARE, SQUARE), np.float32)
    for x in range(0, len(left), SQUARE):
        one = left[x : x + SQUARE]
        for y in range(x if same else 0, len(right), SQUARE):
            two = right[y : y + SQUARE]
            if len(one) == len(two) == SQUARE:
                np.matmul(one, two.T, out=product)
                hit = product >= least
            else:
                hit = np.zeros((len(one), -(-len(two) // 8) * 8), bool)
                np.greater_equal(one @ two.T, least, out=hit[:, : len(two)])
            if hit.any():
                i, j = np.divmod(_ones(hit), hit.shape[1])
                i, j = i + x, j + y
                if same and x == y:
                    i, j = i[i < j], j[i < j]
                yield i, j


def close_pairs(left: np.ndarray, right: np.ndarray, floor: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, product) of all pairs of rows whose product reaches ``floor``, in runs of bounded size; if ``same``, i < j only.

    Rows are no longer than 1. A look in single precision, less its greatest error, leaves the pairs whose product is
    then formed in double precision.
    """
    margin = (left.shape[1] + 8) * 2.0**-22 if left.ndim == 2 else 0.0
    one = left.astype(np.float32)
    two = one if same else right.astype(np.float32)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def exact() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        i, j = (np.concatenate([p[k] for p in kept]) for k in (0, 1))
        for s in range(0, len(i), CLOSE_AT_ONCE):
            x, y = i[s : s + CLOSE_AT_ONCE], j[s : s + CLOSE_AT_ONCE]
            sims = np.concatenate([np.einsum("ij,ij->i", left[x[t : t + 4096]], right[y[t : t + 4096]]) for t in range(0, len(x), 4096)])
            good = sims >= floor
            yield x[good], y[good], sims[good]

    for i, j in _close(one, two, floor, margin, same):
        kept.append((i, j))
        held += len(i)
        if held >= CLOSE_AT_ONCE:
            yield from exact()
            kept, held = [], 0
    if held:
        yield from exact()


def block_reduce(rows: DataFrame, key: str, schema: str, reducer: Reducer | PairReducer, block: int = BLOCK_ROWS, *, floor: float | None = None) -> DataFrame:
    """Compare the rows of each ``key`` block against block and apply ``reducer``.

    ``reducer(left, right, sims, valid)`` sees two tiles of ``block`` rows, their cosine matrix and
    which entries are pairs to look at (each unordered pair once, guests never with guests). With
    ``floor`` only pairs of at least that cosine are looked at: ``reducer(left, right, i, j, sims)`` sees
    the rows of two blocks and a run of their pairs, as places in them. A reducer's ``merge``, if it has
    one, joins what the tiles of a task gave. A key of any size is cut into blocks, so no task holds more
    than two of them; a row is sent once for each block of its key.
    """
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.size("embedding")).alias("_width"))
    total = counted.agg(F.sum("_n").alias("n"), F.max("_width").alias("width")).first()
    most = _block_rows(total.n or 0, total.width or 1, block)
    sizes = small_side(counted.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_blocks")))
    placed = rows.join(sizes, key).withColumn("_sub", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    spread = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    tasks = spread.select(
        *[c for c in rows.columns if c != key], key, "_sub",
        F.least("_sub", "_other").alias("_s"), F.greatest("_sub", "_other").alias("_t"),
    )
    merge = getattr(reducer, "merge", None)

    def tiles(pdf: pd.DataFrame, size: int) -> list[tuple[pd.DataFrame, np.ndarray]]:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        vectors, rest = matrix(pdf["embedding"]), pdf.drop(columns="embedding")
        return [(rest.iloc[i : i + size].reset_index(drop=True), vectors[i : i + size]) for i in range(0, len(pdf), size)]

    def meets(left: pd.DataFrame, right: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the entries (i, j), places that broadcast, are pairs of a row at home and any other, on both levels."""
        good = np.ones(np.broadcast(i, j).shape, bool)
        for level in ("home", "inner"):
            if level in left:
                good &= left[level].to_numpy()[i] | right[level].to_numpy()[j]
        return good

    def blocks_of(pdf: pd.DataFrame, size: int):
        s, t = pdf["_s"].iat[0], pdf["_t"].iat[0]
        lefts = tiles(pdf[pdf["_sub"] == s], size)
        return lefts, lefts if s == t else tiles(pdf[pdf["_sub"] == t], size)

    def compare(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lefts, rights = blocks_of(pdf, block)
        if not lefts or not rights:
            none = pdf.iloc[:0]
            yield reducer(none, none, np.zeros((0, 0)), np.zeros((0, 0), bool))
        for i, (left, one) in enumerate(lefts):
            for right, two in rights[i if lefts is rights else 0 :]:
                sims = one @ two.T
                valid = meets(left, right, np.arange(len(left))[:, None], np.arange(len(right))[None, :])
                if left is right:
                    valid = np.triu(valid, k=1)
                yield reducer(left, right, sims, valid)

    def compare_close(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lefts, rights = blocks_of(pdf, len(pdf))
        none = np.zeros(0, np.int64)
        if not lefts or not rights:
            yield reducer(pdf.iloc[:0], pdf.iloc[:0], none, none, np.zeros(0))
            return
        (left, one), (right, two) = lefts[0], rights[0]
        yield reducer(left, right, none, none, np.zeros(0))  # a task without close pairs has an answer too
        for i, j, sims in close_pairs(one, two, floor, left is right):
            good = meets(left, right, i, j)
            yield reducer(left, right, i[good], j[good], sims[good])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(parts), ignore_index=True)
        found = compare(whole) if floor is None else compare_close(whole)
        if merge is None:
            yield from found
            return
        kept: list[pd.DataFrame] = []
        for one in found:
            kept.append(one)
            if len(kept) > MERGED_TILES:
                kept = [merge(pd.concat([f for f in kept if len(f)] or kept[:1]))]
        yield merge(pd.concat([f for f in kept if len(f)] or kept[:1]))

    return tasks.groupBy(key, "_s", "_t").applyInPandas(run, schema)


# ---- reducers ----

def keep_pairs(accept: Callable[[np.ndarray], np.ndarray]) -> PairReducer:
    def reducer(left, right, i, j, sims):
        good = accept(sims)
        a, b = left["id"].to_numpy()[i[good]], right["id"].to_numpy()[j[good]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": sims[good]})

    return reducer


def counts_and_pairs(accept: Callable[[np.ndarray], np.ndarray], most: int = TASK_PAIRS) -> PairReducer:
    """(id, n), neighbours of each row counted with their copies, and the pairs (id, b) themselves; a task with
    more than ``most`` pairs hands none on and says so by one row without an id."""
    kinds = {"id": "Int64", "n": "Int64", "b": "Int64"}

    def bounded(pairs: pd.DataFrame, counts: pd.DataFrame, full: bool) -> pd.DataFrame:
        if full or len(pairs) > most:
            pairs = pd.DataFrame({"id": [None]})
        return pd.concat([pairs.astype({c: "Int64" for c in pairs}), counts.astype("Int64")]).reindex(columns=list(kinds)).astype(kinds)

    def reducer(left, right, i, j, sims):
        good = accept(sims)
        i, j = i[good], j[good]
        a, b = left["id"].to_numpy(np.int64)[i], right["id"].to_numpy(np.int64)[j]
        copies = np.concatenate([right["copies"].to_numpy(np.int64)[j], left["copies"].to_numpy(np.int64)[i]])
        counts = pd.DataFrame({"id": np.concatenate([a, b]), "n": copies}).groupby("id", as_index=False)["n"].sum()
        return bounded(pd.DataFrame({"id": a, "b": b}), counts, False)

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        counts = found[found["n"].notna()].groupby("id", as_index=False)["n"].sum()
        return bounded(found.loc[found["b"].notna(), ["id", "b"]], counts, bool(found["id"].isna().any()))

    reducer.merge = merge
    return reducer


def least_neighbour(accept: Callable[[np.ndarray], np.ndarray], later_only: bool = False) -> PairReducer:
    """Smallest ``key`` among flagged neighbours of each row; with ``later_only`` only smaller ids count."""

    def reducer(left, right, i, j, sims):
        good = accept(sims)
        i, j = i[good], j[good]
        a, b = left["id"].to_numpy(np.int64)[i], right["id"].to_numpy(np.int64)[j]
        to_left, to_right = right["flag"].to_numpy(bool)[j], left["flag"].to_numpy(bool)[i]
        if later_only:
            to_left, to_right = to_left & (b < a), to_right & (a < b)
        ids = np.concatenate([a[to_left], b[to_right]])
        keys = np.concatenate([right["key"].to_numpy(np.int64)[j[to_left]], left["key"].to_numpy(np.int64)[i[to_right]]])
        return merge(pd.DataFrame({"id": ids, "key": keys}))

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("id", as_index=False)["key"].min()

    reducer.merge = merge
    return reducer


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of ``n`` items' component over the links a[i]-b[i]."""
    label = np.arange(n)
    while True:
        before = label.copy()
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The links a[i]-b[i] as stars (a, b): every node but the least of its component hangs on that."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_labels(len(ids), place[: len(a)], place[len(a) :])
    hangs = label != np.arange(len(ids))
    return pd.DataFrame({"a": ids[label[hangs]], "b": ids[hangs]})


def spanning_forest(accept: Callable[[np.ndarray], np.ndarray]) -> PairReducer:
    """Each connected part of the neighbour graph of two blocks as a star on its least id.

    The stars connect the same rows as all the pairs, with fewer edges than rows.
    """

    def reducer(left, right, i, j, sims):
        good = accept(sims)
        if "flag" in left:
            good &= left["flag"].to_numpy(bool)[i] & right["flag"].to_numpy(bool)[j]
        return stars(left["id"].to_numpy(np.int64)[i[good]], right["id"].to_numpy(np.int64)[j[good]])

    reducer.merge = lambda found: stars(found["a"].to_numpy(np.int64), found["b"].to_numpy(np.int64))
    return reducer


def least_similarity(key: str) -> Reducer:
    def reducer(left, right, sims, valid):
        lowest = sims[valid].min() if valid.any() else np.nan
        name = left[key].iat[0] if len(left) else None
        return pd.DataFrame({key: [name], "min_similarity": [lowest]}).dropna()

    reducer.merge = lambda found: found.groupby(key, as_index=False)["min_similarity"].min()
    return reducer


# ---- operators ----

def similarity_pairs(people: DataFrame, min_cosine: float) -> DataFrame:
    """Pairs of distinct vectors with cosine at least ``min_cosine`` (a < b); copies count through
    ``copies_a`` and ``copies_b`` and are listed by :func:`distinct_vectors`."""
    reps, _ = distinct_vectors(people)
    cells = in_cells(reps, min_cosine, epsilon=1e-8)
    found = block_reduce(cells, "cell", "a long, b long, sim double", keep_pairs(lambda s: s >= min_cosine), floor=min_cosine)
    size = reps.select("id", "copies")
    return (
        found.join(size.withColumnsRenamed({"id": "a", "copies": "copies_a"}), "a")
        .join(size.withColumnsRenamed({"id": "b", "copies": "copies_b"}), "b")
        .select("a", "b", "sim", "copies_a", "copies_b")
    )
