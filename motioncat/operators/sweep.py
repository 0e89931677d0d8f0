"""Density clusters of many settings from one merge tree for each population and core size.

Settings differ in the least quality of their rows (their population), in eps and in the size
that makes a core. For one population and core size the clusters of every eps are cuts of one tree:
the least spanning forest of the mutual reachability distance, which is the largest of the
distance of two rows and their core distances. So the vectors are compared twice for all
settings together, once for core distances and once for forests, and each setting only cuts.

Copies of a vector are compared once; each population counts its own copies of it, and names a
vector by its own first row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motioncat.operators import blocks
from motioncat.operators.graph import connected_components
from motioncat.session import materialize


class Families:
    """The populations (least qualities) and families (population, core size, greatest eps) of some settings (name, quality, eps, samples)."""

    def __init__(self, settings: list[tuple[str, float, float, int]]) -> None:
        self.settings = settings
        self.qualities = sorted({quality for _, quality, _, _ in settings})
        reach: dict[tuple[int, int], float] = {}
        for _, quality, eps, samples in settings:
            key = (self.qualities.index(quality), samples)
            reach[key] = max(reach.get(key, 0.0), eps)
        self.families = [(population, samples, eps) for (population, samples), eps in sorted(reach.items())]
        self.reach = max(eps for _, _, eps in self.families)

    def of(self, quality: float, samples: int) -> int:
        key = (self.qualities.index(quality), samples)
        return [(p, s) for p, s, _ in self.families].index(key)


def _vectors(people: DataFrame, qualities: list[float]) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (id, copies and first row in each population, vector), and the (ord, id, quality) of every row."""
    reps, members = blocks.distinct_vectors(people)
    rated = materialize(members.join(people.select("ord", F.col("embedding_quality").alias("quality")), "ord"), "rated")
    inside = [F.col("quality") >= q for q in qualities]
    counted = rated.groupBy("id").agg(
        F.array(*[F.sum(c.cast("long")) for c in inside]).alias("n"), F.array(*[F.min(F.when(c, F.col("ord"))) for c in inside]).alias("first")
    )
    return materialize(reps.drop("copies").join(counted, "id"), "populations"), rated


def _distance(sims: np.ndarray) -> np.ndarray:
    return 1 - np.clip(sims, 0.0, 1.0)


def _of(frame: pd.DataFrame, column: str, rows: np.ndarray) -> np.ndarray:
    """The arrays in ``column`` of the given rows as a matrix, a row for each of ``rows``; missing entries are infinite."""
    some, place = np.unique(rows, return_inverse=True)
    found = [[np.inf if x is None or x != x else x for x in row] for row in frame[column].to_numpy()[some]]
    return np.array(found, float)[place] if found else np.zeros((0, 1))


def _nearest(wanted: dict[int, tuple[int, float]]) -> blocks.PairReducer:
    """The nearest rows of each row in the populations of ``wanted`` (population: how many, how far), with their copies."""
    columns = ["id", "population", "d", "copies"]

    def reducer(left, right, i, j, sims):
        d = _distance(sims)
        a, b = left["id"].to_numpy(np.int64)[i], right["id"].to_numpy(np.int64)[j]
        n, m = _of(left, "n", i), _of(right, "n", j)
        out = []
        for population, (_, eps) in wanted.items() if len(i) else ():
            near = (d <= eps) & (0 < n[:, population]) & (n[:, population] < np.inf) & (0 < m[:, population]) & (m[:, population] < np.inf)
            copies = np.concatenate([m[near, population], n[near, population]]).astype(np.int64)
            out.append(pd.DataFrame({"id": np.concatenate([a[near], b[near]]), "population": population, "d": np.tile(d[near], 2), "copies": copies}))
        return merge(pd.concat(out)) if out else pd.DataFrame({c: [] for c in columns})

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["population", "id", "d"])
        most = found["population"].map({p: m for p, (m, _) in wanted.items()})
        return found[found.groupby(["population", "id"]).cumcount() < most]

    reducer.merge = merge
    return reducer


def core_distances(reps: DataFrame, cells: DataFrame, plan: Families) -> DataFrame:
    """(id, core): for each family the distance within which a vector is a core, null if none up to the family's eps."""
    wanted: dict[int, tuple[int, float]] = {}
    for population, samples, eps in plan.families:
        if samples > 1:
            most, reach = wanted.get(population, (0, 0.0))
            wanted[population] = (max(most, samples - 1), max(reach, eps))
    if wanted:
        found = blocks.block_reduce(cells, "cell", "id long, population int, d double, copies long", _nearest(wanted), floor=blocks.near_floor(plan.reach))
        most = max(m for m, _ in wanted.values())
        # a row is met once in every pair of blocks; of each only its nearest few come back
        near = found.groupBy("id", "population").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "copies"))), 1, most).alias("near"))
        near = near.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("population", "near"))).alias("near"))
        rows = reps.select("id", "n").join(near, "id", "left")
    else:
        rows = reps.select("id", "n").withColumn("near", F.lit(None).cast("map<int,array<struct<d:double,copies:bigint>>>"))

    def core(population: int, samples: int, eps: float) -> Column:
        own = F.col("n")[population]
        start = F.struct(own.alias("have"), F.when(own >= samples, F.lit(0.0)).alias("d"))
        step = lambda s, x: F.struct((s["have"] + x["copies"]).alias("have"), F.coalesce(s["d"], F.when(s["have"] + x["copies"] >= samples, x["d"])).alias("d"))
        near = F.coalesce(F.col("near")[population], F.array().cast("array<struct<d:double,copies:bigint>>"))
        distance = F.aggregate(near, start, step)["d"]
        return F.when((own > 0) & (distance <= eps), distance)

    return materialize(rows.select("id", F.array(*[core(*f) for f in plan.families]).alias("core")), "core-distances")


def least_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges a[i]-b[i] of the least spanning forest of ``n`` nodes; of equal weights the first edge counts.

    In each turn every tree takes its least edge to another one (Boruvka's method).
    """
    order = np.argsort(w, kind="stable")
    a, b = a[order], b[order]
    taken, label, live = np.zeros(len(order), bool), np.arange(n), np.arange(len(order))
    while True:
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return order[taken]
        least = np.full(n, len(order))
        np.minimum.at(least, x, live)
        np.minimum.at(least, y, live)
        chosen = np.unique(least[least < len(order)])
        taken[chosen] = True
        label = blocks.least_labels(n, label[a[chosen]], label[b[chosen]])[label]


def spanning_tree(weight: np.ndarray) -> list[tuple[int, int, float]]:
    """Least spanning forest of a symmetric matrix of weights, infinite where there is no edge."""
    a, b = np.nonzero(np.triu(np.isfinite(weight), k=1))
    w = weight[a, b]
    return [(int(a[e]), int(b[e]), float(w[e])) for e in least_forest(len(weight), a, b, w)]


def _forests(families: list[tuple[int, int, float]]) -> blocks.PairReducer:
    """Edges (family, a, b, w) of each family's least spanning forest within two blocks."""

    def reducer(left, right, i, j, sims):
        d = _distance(sims)
        a, b = left["id"].to_numpy(np.int64)[i], right["id"].to_numpy(np.int64)[j]
        one, two = _of(left, "core", i), _of(right, "core", j)
        out = []
        for f, (_, _, eps) in enumerate(families) if len(i) else ():
            w = np.maximum(d, np.maximum(one[:, f], two[:, f]))
            near = w <= eps
            out.append(pd.DataFrame({"family": f, "a": a[near], "b": b[near], "w": w[near]}))
        return merge(pd.concat(out)) if out else pd.DataFrame({c: [] for c in ("family", "a", "b", "w")})

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        out = [found.iloc[:0]]
        for _, part in found.groupby("family"):
            ids, place = np.unique(np.concatenate([part["a"], part["b"]]), return_inverse=True)
            out.append(part.iloc[least_forest(len(ids), place[: len(part)], place[len(part) :], part["w"].to_numpy())])
        return pd.concat(out)

    reducer.merge = merge
    return reducer


def density_labels(people: DataFrame, settings: list[tuple[str, float, float, int]]) -> DataFrame:
    """(name, ord, cluster) of every setting (name, least quality, eps, samples); noise is left out.

    A row's cluster is that of its core, named by the cluster's first core row; a row that is no
    core itself takes the least name among the cores within eps.
    """
    plan = Families(settings)
    reps, members = _vectors(people, plan.qualities)
    cells = blocks.in_cells(reps, 1 - plan.reach)
    cores = core_distances(reps, cells, plan)
    reached = cells.join(cores, "id")
    forest = materialize(blocks.block_reduce(reached, "cell", "family int, a long, b long, w double", _forests(plan.families), floor=blocks.near_floor(plan.reach)), "forests")
    cuts = [(s, plan.of(quality, samples), plan.qualities.index(quality), eps, quality) for s, (_, quality, eps, samples) in enumerate(plan.settings)]
    each = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(family).alias("family"), F.lit(population).alias("population"), F.lit(eps).alias("eps")) for s, family, population, eps, _ in cuts])
    table = F.broadcast(people.sparkSession.createDataFrame(cuts, "s int, family int, population int, eps double, least double"))  # one row a setting
    kept = forest.join(table, "family").filter("w <= eps")
    linked = connected_components(kept.select(F.struct("s", F.col("a").alias("id")).alias("a"), F.struct("s", F.col("b").alias("id")).alias("b")))
    core = cores.join(reps.select("id", "first"), "id").withColumn("_cut", F.explode(F.filter(each, lambda c: F.col("core")[c["family"]] <= c["eps"])))
    core = core.select("_cut.s", "id", F.col("first")[F.col("_cut.population")].alias("own"))
    named = core.join(linked.select("id.s", "id.id", F.col("component.id").alias("component")), ["s", "id"], "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    names = named.groupBy("s", "component").agg(F.min("own").alias("cluster"))
    labels = materialize(named.join(names, ["s", "component"]).select("s", "id", "cluster"), "density-labels")
    border = [_border(cells, labels.filter(F.col("s") == s), population, eps).withColumn("s", F.lit(s)) for s, _, population, eps, _ in cuts if plan.settings[s][3] > 2]
    everyone = reduce(DataFrame.unionByName, border, labels)
    title = F.element_at(F.array(*[F.lit(name) for name, *_ in plan.settings]), F.col("s") + 1)
    out = everyone.join(table.select("s", "least"), "s").join(members, "id").filter(F.col("quality") >= F.col("least"))
    return out.select(title.alias("name"), "ord", "cluster")


def _border(cells: DataFrame, labels: DataFrame, population: int, eps: float) -> DataFrame:
    """(id, cluster) of the vectors that are near a core of one setting and none themselves.

    Only settings in which a core needs more than a vector and one neighbour have such rows.
    """
    accept = lambda s: _distance(s) <= eps
    own = cells.filter(F.col("n")[population] > 0).join(labels.select("id", F.col("cluster").alias("key")), "id", "left")
    keyed = own.withColumns({"flag": F.col("key").isNotNull(), "key": F.coalesce("key", F.lit(0))})
    touched = blocks.block_reduce(keyed, "cell", "id long, key long", blocks.least_neighbour(accept), floor=blocks.near_floor(eps))
    return touched.join(labels, "id", "left_anti").groupBy("id").agg(F.min("key").alias("cluster"))
