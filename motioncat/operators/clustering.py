"""Clusters of embeddings: density based, greedy leader and complete linkage, all exact."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.functions import vectors as V
from motioncat.operators import blocks
from motioncat.operators.graph import connected_components
from motioncat.operators.sweep import density_labels
from motioncat.operators.tracks import collapse_renames
from motioncat.session import materialize

# ---- fixed values ----
MIN_CONFIDENCE, MIN_SPREAD, MIN_CLUSTER_QUALITY = 0.3, 0.01, 0.3
# name, similarity threshold, quality threshold, density based, eps, min_samples, min_cluster_size
PARAMETER_SETS = [
    ("ultra_conservative", 0.95, 0.8, True, 0.05, 1, 2),
    ("very_conservative", 0.93, 0.7, True, 0.07, 1, 2),
    ("conservative", 0.91, 0.6, True, 0.09, 1, 2),
    ("moderate", 0.88, 0.5, True, 0.12, 2, 2),
    ("permissive", 0.85, 0.4, True, 0.15, 2, 3),
    ("hierarchical_conservative", 0.91, 0.6, False, 0.09, 1, 2),
    ("dbscan_samples_1", 0.90, 0.6, True, 0.10, 1, 2),
    ("dbscan_samples_2", 0.90, 0.6, True, 0.10, 2, 2),
    ("dbscan_samples_3", 0.90, 0.6, True, 0.10, 3, 2),
    ("similarity_0.87", 0.87, 0.6, True, 0.13, 1, 2),
    ("similarity_0.89", 0.89, 0.6, True, 0.11, 1, 2),
    ("similarity_0.90", 0.90, 0.6, True, 0.10, 1, 2),
    ("similarity_0.92", 0.92, 0.6, True, 0.08, 1, 2),
    ("similarity_0.94", 0.94, 0.6, True, 0.06, 1, 2),
]


def filter_quality(people: DataFrame, threshold: float, check_spread: bool = True) -> DataFrame:
    """Embeddings good enough to cluster; ``check_spread`` drops nearly constant vectors."""
    ok = (F.col("embedding_quality") >= threshold) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.size("embedding") > 0)
    if check_spread:
        ok = ok & (F.sqrt(V.variance(F.col("embedding"))) > MIN_SPREAD)
    return people.filter(ok)


def cluster_dbscan(people: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(ord, cluster) for rows in a cluster, noise left out; a cluster is named by its first core row.

    One comparison of the vectors counts neighbours and hands on the pairs. Where tasks find too many
    pairs to hand on, two more comparisons give forest edges and least labels instead.
    """
    reps, members = blocks.distinct_vectors(people)
    accept = lambda s: 1 - np.clip(s, 0.0, 1.0) <= eps
    cells = blocks.in_cells(reps, 1 - eps)
    found = materialize(blocks.block_reduce(cells, "cell", "id long, n long, b long", blocks.counts_and_pairs(accept, blocks.TASK_PAIRS), floor=blocks.near_floor(eps)), "neighbours")
    near = found.filter("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    cores = materialize(
        reps.select("id", "copies").join(near, "id", "left")
        .filter(F.col("copies") + F.coalesce("n", F.lit(0)) >= min_samples).select("id"),
        "cores",
    )
    pairs = found.filter("b IS NOT NULL").select(F.col("id").alias("a"), "b") if found.filter("id IS NULL").isEmpty() else None
    if pairs is not None:
        ends = [cores.select(F.col("id").alias(c)) for c in ("a", "b")]
        forest = pairs.join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi").select("a", "b")
    else:
        flagged = cells.join(cores.withColumn("flag", F.lit(True)), "id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
        forest = blocks.block_reduce(flagged, "cell", "a long, b long", blocks.spanning_forest(accept), floor=blocks.near_floor(eps))
    linked = connected_components(forest)
    labels = materialize(
        cores.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("cluster")), "core-labels"
    )
    if pairs is not None:
        sides = pairs.select(F.col("a").alias("id"), F.col("b").alias("by")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("by")))
        touched = sides.join(labels.select(F.col("id").alias("by"), F.col("cluster").alias("key")), "by").select("id", "key")
    else:
        keyed = flagged.drop("flag").join(labels, "id", "left").select(
            *cells.columns, F.col("cluster").isNotNull().alias("flag"), F.coalesce("cluster", F.lit(0)).alias("key")
        )
        touched = blocks.block_reduce(keyed, "cell", "id long, key long", blocks.least_neighbour(accept), floor=blocks.near_floor(eps))
    border = touched.join(cores, "id", "left_anti").groupBy("id").agg(F.min("key").alias("cluster"))
    return members.join(labels.unionByName(border), "id").select("ord", "cluster")


def _by_parts(
    cells: DataFrame, accept: Callable[[np.ndarray], np.ndarray], floor: float, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], beyond: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(id, cluster) of the rows that have a neighbour, cluster by connected part of the neighbour graph.

    Clusters never reach over parts. A part that fits a block is folded in one task, many parts to
    a task: ``fold(ids, cosines)`` names each row's cluster. The cells of larger parts go to ``beyond``.
    """
    linked = materialize(connected_components(blocks.block_reduce(cells, "cell", "a long, b long", blocks.spanning_forest(accept), floor=floor)), "parts")
    sizes = linked.groupBy("component").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("n").alias("most")).first()
    buckets = max(1, -(-total.rows // blocks.BLOCK_ROWS))
    large = sizes.filter(F.col("n") > blocks.BLOCK_ROWS) if total.rows and total.most > blocks.BLOCK_ROWS else None
    small = linked if large is None else linked.join(large, "component", "left_anti")
    own = cells.filter("home and inner").select("id", "embedding").join(small, "id")
    dealt = own.select(F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("_bucket"), "component", "id", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("component"):
            part = part.sort_values("id")
            ids, vectors = part["id"].to_numpy(), blocks.matrix(part["embedding"])
            out.append(pd.DataFrame({"id": ids, "cluster": fold(ids, vectors @ vectors.T)}))
        return pd.concat(out)

    folded = dealt.groupBy("_bucket").applyInPandas(run, "id long, cluster long")
    if large is None:
        return folded
    rest = linked.join(large, "component", "left_semi").select("id")
    return folded.unionByName(beyond(cells.join(rest, "id", "left_semi")))


def cluster_greedy(people: DataFrame, min_cosine: float) -> DataFrame:
    """(ord, cluster): in input order each unassigned row leads, taking later rows similar enough."""
    reps, members = blocks.distinct_vectors(people)
    accept = lambda s: s >= min_cosine
    cells = blocks.in_cells(reps, min_cosine, epsilon=V.EPSILON)

    def fold(ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        near, label = accept(sims), np.full(len(ids), -1)
        for i in range(len(ids)):
            if label[i] < 0:
                taken = near[i, i:] & (label[i:] < 0)
                taken[0] = True
                label[i:][taken] = ids[i]
        return label

    labels = _by_parts(cells, accept, min_cosine, fold, lambda rest: _greedy_rounds(rest, accept, min_cosine))
    return members.join(labels, "id", "left").select("ord", F.coalesce("cluster", "id").alias("cluster"))


def _greedy_rounds(cells: DataFrame, accept: Callable[[np.ndarray], np.ndarray], floor: float) -> DataFrame:
    """(id, cluster) of greedy leading, in rounds.

    A row leads once no undecided earlier row is similar to it, and rows similar to a leader are
    settled; each round returns one number per row.
    """
    reps = cells.filter("home and inner").select("id")

    def nearest(rows: DataFrame, flags: DataFrame) -> DataFrame:
        """Least flagged earlier neighbour of each row of ``rows``."""
        keyed = rows.join(flags, "id", "left").withColumn("flag", F.coalesce("flag", F.lit(False))).withColumn("key", F.col("id"))
        found = blocks.block_reduce(keyed, "cell", "id long, key long", blocks.least_neighbour(accept, later_only=True), floor=floor)
        return found.groupBy("id").agg(F.min("key").alias("key"))

    undecided, leaders, rows = reps.select("id"), None, cells
    while True:
        waiting = nearest(rows, undecided.withColumn("flag", F.lit(True)))
        found = materialize(undecided.join(waiting, "id", "left_anti"), "leaders")
        leaders = found if leaders is None else leaders.unionByName(found)
        settled = nearest(rows, found.withColumn("flag", F.lit(True))).select("id")
        undecided = materialize(
            undecided.join(found, "id", "left_anti").join(settled, "id", "left_anti"), "undecided"
        )
        if undecided.isEmpty():
            break
        rows = cells.join(undecided, "id", "left_semi")
    taken = nearest(cells, leaders.withColumn("flag", F.lit(True))).join(leaders, "id", "left_anti")
    return leaders.select("id", F.col("id").alias("cluster")).unionByName(taken.select("id", F.col("key").alias("cluster")))


def cluster_complete_link(people: DataFrame, threshold: float) -> DataFrame:
    """(ord, cluster) of agglomerative clustering with complete linkage, merging below distance 1 - threshold.

    Copies of a vector merge at distance 0 and are combined first. Two clusters merge once they
    are each other's nearest (by distance, then by first ids): with complete linkage a merge never
    brings two others closer, so this gives the tree of one-by-one merging. The distance of merged
    clusters is the largest of its parts and exists only while every part pair is below the limit.
    Parts of the graph of close pairs are merged inside a task; only those too large for a block
    have their pairs stored.
    """
    reps, members = blocks.distinct_vectors(people)
    limit = 1 - threshold
    cells = blocks.in_cells(reps, threshold)
    close = lambda s: 1 - np.clip(s, 0.0, 1.0) < limit

    def fold(ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        return ids[nearest_neighbour_chain(np.where(close(sims), 1 - np.minimum(sims, 1.0), np.inf))]

    labels = _by_parts(cells, close, blocks.near_floor(limit), fold, lambda rest: _complete_link_rounds(rest, close, blocks.near_floor(limit)))
    return members.join(labels, "id", "left").select("ord", F.coalesce("cluster", "id").alias("cluster"))


def nearest_neighbour_chain(distance: np.ndarray) -> np.ndarray:
    """First member of every row's cluster under complete linkage of ``distance`` (symmetric, infinite where two must not meet).

    A chain of nearest neighbours is followed until two are each other's nearest; these merge.
    Of equal distances the first row counts, which makes the nearest pair unique.
    """
    d, n = distance.copy(), len(distance)
    np.fill_diagonal(d, np.inf)
    first, chain = np.arange(n), []
    for start in range(n):
        if first[start] != start:
            continue
        chain.append(start)
        while chain:
            x = chain[-1]
            y = int(d[x].argmin())
            if d[x, y] == np.inf:
                chain.pop()
            elif len(chain) > 1 and chain[-2] == y:
                del chain[-2:]
                keep, gone = min(x, y), max(x, y)
                first[gone] = keep
                d[keep] = np.maximum(d[keep], d[gone])
                d[:, keep] = d[keep]
                d[keep, keep] = np.inf
                d[gone], d[:, gone] = np.inf, np.inf
                if not chain:
                    chain.append(keep)
            else:
                chain.append(y)
    while not np.array_equal(first, first[first]):
        first = first[first]
    return first


def _complete_link_rounds(cells: DataFrame, close: Callable[[np.ndarray], np.ndarray], floor: float) -> DataFrame:
    """(id, cluster) of complete linkage on stored pairs: all mutually nearest clusters merge in the same round."""
    pairs = blocks.block_reduce(cells, "cell", "a long, b long, sim double", blocks.keep_pairs(close), floor=floor)
    links = materialize(pairs.select("a", "b", (1 - F.least("sim", F.lit(1.0))).alias("d")), "links")
    merges = None
    while not links.isEmpty():
        edge = F.struct("d", "a", "b")
        ends = links.select(F.col("a").alias("x"), edge.alias("e")).unionByName(links.select(F.col("b").alias("x"), edge.alias("e")))
        nearest = ends.groupBy("x").agg(F.min("e").alias("e"))
        mutual = nearest.groupBy("e").count().filter("count = 2").select(F.col("e.a").alias("keep"), F.col("e.b").alias("gone"))
        merged = materialize(mutual, "merged")
        step = merged.select(F.col("gone").alias("source"), F.col("keep").alias("target"))
        merges = step if merges is None else merges.unionByName(step)
        moved = merged.select(F.col("gone").alias("x"), F.col("keep").alias("to"), F.lit(2).alias("parts")).unionByName(
            merged.select(F.col("keep").alias("x"), F.col("keep").alias("to"), F.lit(2).alias("parts"))
        )
        for end in ("a", "b"):
            side = moved.withColumnsRenamed({"x": end, "to": f"{end}_to", "parts": f"{end}_parts"})
            links = links.join(side, end, "left")
        renamed = links.select(
            F.coalesce("a_to", "a").alias("p"), F.coalesce("b_to", "b").alias("q"), "d",
            (F.coalesce("a_parts", F.lit(1)) * F.coalesce("b_parts", F.lit(1))).alias("needed"),
        ).filter("p <> q")
        links = materialize(
            renamed.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .agg(F.max("d").alias("d"), F.count("*").alias("have"), F.max("needed").alias("needed"))
            .filter("have = needed").select("a", "b", "d"),
            "links",
        )
    return collapse_renames(merges).select(F.col("source").alias("id"), F.col("target").alias("cluster"))


# ---- quality ----

def _least_in_small(rows: DataFrame, total: int) -> DataFrame:
    """Least pair cosine of clusters that fit a block; many clusters share one task."""
    buckets = max(1, -(-total // blocks.BLOCK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        names, starts = np.unique(pdf["cluster"].to_numpy(), return_index=True)
        vectors = blocks.matrix(pdf["embedding"])
        out = []
        for part in np.split(vectors, starts[1:]):
            sims = part @ part.T
            out.append(sims[np.triu_indices(len(part), k=1)].min() if len(part) > 1 else 1.0)
        return pd.DataFrame({"cluster": names, "min_similarity": out})

    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64("cluster"), F.lit(buckets)))
    kind = rows.schema["cluster"].dataType.simpleString()
    return spread.select("_bucket", "cluster", "embedding").groupBy("_bucket").applyInPandas(run, f"cluster {kind}, min_similarity double")


def cluster_quality(people: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, similarities, score, span and representative of each cluster.

    The mean pair cosine follows from the length of the summed unit vectors, so it takes one
    pass; only the minimum compares members, block by block.
    """
    unit = people.join(labels, "ord").withColumn("embedding", V.unit(F.col("embedding")))
    unit = materialize(unit.withColumn("id", F.col("ord")), "cluster-members")
    score = F.struct(-(F.col("embedding_quality") * F.col("confidence")), F.col("ord"))
    per_cluster = unit.groupBy("cluster").agg(
        F.count("*").alias("cluster_size"),
        vector_to_array(Summarizer.sum(array_to_vector("embedding"))).alias("_sum"),
        F.sum(V.dot(F.col("embedding"), F.col("embedding"))).alias("_own"),
        F.avg("embedding_quality").alias("_quality"), F.avg("confidence").alias("_confidence"),
        F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"),
        F.min_by(F.struct("ord", "embedding_quality"), score).alias("_best"),
    )
    per_cluster = materialize(per_cluster, "cluster-sums")
    videos = unit.select("cluster", "video_filename").distinct().groupBy("cluster").agg(F.count("*").alias("videos"))
    large = per_cluster.filter(F.col("cluster_size") > blocks.BLOCK_ROWS).select("cluster")
    rows = unit.select("cluster", "id", "embedding")
    if large.isEmpty():
        least = _least_in_small(rows, rows.count())
    else:
        small = rows.join(large, "cluster", "left_anti")
        big = rows.join(large, "cluster", "left_semi")
        reduced = blocks.block_reduce(big, "cluster", f"cluster {rows.schema['cluster'].dataType.simpleString()}, min_similarity double", blocks.least_similarity("cluster"))
        least = _least_in_small(small, small.count()).unionByName(
            reduced.groupBy("cluster").agg(F.min("min_similarity").alias("min_similarity"))
        )
    n = F.col("cluster_size")
    avg = F.when(n > 1, (V.dot(F.col("_sum"), F.col("_sum")) - F.col("_own")) / F.nullif(n * (n - 1), F.lit(0))).otherwise(1.0)
    quality = F.when(
        n > 1, 0.4 * F.col("avg_similarity") + 0.3 * F.col("min_similarity") + 0.2 * F.col("_quality") + 0.1 * F.col("_confidence")
    ).otherwise(F.col("_best.embedding_quality"))
    joined = per_cluster.join(least, "cluster").join(videos, "cluster").withColumn("avg_similarity", avg)
    return joined.select(
        "cluster", "cluster_size", "avg_similarity", "min_similarity", quality.alias("quality_score"), "videos",
        "first_frame", "last_frame", F.col("_best.ord").alias("representative"),
    )


def filter_clusters(clusters: DataFrame, min_size: int) -> DataFrame:
    """Clusters large and good enough, best first."""
    keep = (F.col("cluster_size") >= min_size) & (F.col("quality_score") > MIN_CLUSTER_QUALITY)
    return clusters.filter(keep).orderBy(F.col("quality_score").desc(), "cluster")


def cluster_report(clusters: DataFrame) -> DataFrame:
    """Totals over all clusters."""
    return clusters.agg(
        F.count("*").alias("clusters"),
        F.sum("cluster_size").alias("embeddings"),
        F.avg("cluster_size").alias("avg_size"),
        F.avg("quality_score").alias("avg_quality"),
        F.avg(F.when(F.col("cluster_size") > 1, F.col("avg_similarity"))).alias("avg_similarity"),
        F.min("cluster_size").alias("smallest"),
        F.max("cluster_size").alias("largest"),
        F.max("quality_score").alias("best_quality"),
        F.min("quality_score").alias("worst_quality"),
    )


def top_clusters(clusters: DataFrame, k: int) -> DataFrame:
    """The ``k`` best clusters of the report."""
    return clusters.orderBy(F.col("quality_score").desc(), "cluster").limit(k)


def quality_bands(clusters: DataFrame) -> DataFrame:
    band = F.when(F.col("quality_score") > 0.9, "high").when(F.col("quality_score") > 0.7, "medium").otherwise("low")
    return clusters.groupBy(band.alias("band")).agg(F.count("*").alias("clusters"), F.sum("cluster_size").alias("embeddings"))


# ---- parameter sweep ----

def parameter_clusters(people: DataFrame, specs: list[tuple] | None = None) -> DataFrame:
    """Clusters of every parameter set (``name``) with their quality, those large and good enough.

    All density based sets come from common merge trees. The quality of all sets' clusters is
    measured in one pass; clusters too small for their set are left out before it.
    """
    specs = specs or PARAMETER_SETS
    good = materialize(filter_quality(people, min(s[2] for s in specs)), "good-embeddings")
    found = [
        cluster_complete_link(good.filter(F.col("embedding_quality") >= quality), similarity).select(F.lit(name).alias("name"), "ord", "cluster")
        for name, similarity, quality, density, *_ in specs if not density
    ]
    settings = [(name, quality, eps, samples) for name, _, quality, density, eps, samples, _ in specs if density]
    if settings:
        found.append(density_labels(good, settings))
    least = F.broadcast(people.sparkSession.createDataFrame([(s[0], s[6]) for s in specs], "name string, least int"))  # one row a set
    labels = materialize(reduce(DataFrame.unionByName, found), "labels")
    large = labels.groupBy("name", "cluster").count().join(least, "name").filter(F.col("count") >= F.col("least")).select("name", "cluster")
    labels = labels.join(large, ["name", "cluster"]).select("ord", F.concat_ws(":", "cluster", "name").alias("cluster"))
    rated = cluster_quality(good, materialize(labels, "labels")).filter(F.col("quality_score") > MIN_CLUSTER_QUALITY)
    place = F.instr("cluster", ":")
    return rated.withColumns({"name": F.expr("substring(cluster, instr(cluster, ':') + 1)"), "cluster": F.col("cluster").substr(F.lit(1), place - 1).cast("long")})


def tuning_summary(people: DataFrame, specs: list[tuple] | None = None) -> DataFrame:
    """One row per parameter set: number, sizes and qualities of its clusters."""
    specs = specs or PARAMETER_SETS
    sums = parameter_clusters(people, specs).groupBy("name").agg(
        F.count("*").alias("n"), F.avg("cluster_size").alias("avg_cluster_size"), F.avg("quality_score").alias("avg_quality"),
        F.min("quality_score").alias("min_quality"), F.max("quality_score").alias("max_quality"),
        F.max("cluster_size").alias("largest"), F.min("cluster_size").alias("smallest"),
    )
    names = people.sparkSession.createDataFrame([(s[0],) for s in specs], "name string")
    none = F.lit(0).cast("long")
    return names.join(materialize(sums, "tuning"), "name", "left").select(
        "name", F.coalesce("n", none).alias("num_clusters"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_cluster_size", "avg_quality", "min_quality", "max_quality")],
        F.coalesce("largest", none).alias("largest_cluster"), F.coalesce("smallest", none).alias("smallest_cluster"),
    )


def best_runs(summary: DataFrame) -> DataFrame:
    """Recommended runs: high precision (best worst cluster) and balanced (best mean quality)."""
    precise = summary.filter((F.col("num_clusters") > 0) & (F.col("avg_quality") > 0.9) & (F.col("largest_cluster") < 100))
    balanced = summary.filter(F.col("num_clusters").between(10, 50))

    def pick(rows: DataFrame, kind: str, by: str) -> DataFrame:
        best = rows.agg(F.min_by(F.struct("name", "num_clusters", by), F.struct(-F.col(by), F.col("name"))).alias("b"))
        return best.filter("b IS NOT NULL").select(
            F.lit(kind).alias("kind"), F.col("b.name").alias("name"), F.col("b.num_clusters").alias("num_clusters"), F.col(f"b.{by}").alias("score")
        )

    return pick(precise, "high_precision", "min_quality").unionByName(pick(balanced, "balanced", "avg_quality"))


def representatives(people: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the best embedding by quality times confidence, and by their weighted sum; the first among equals."""
    q, c = F.col("embedding_quality"), F.col("confidence")
    return people.groupBy(*keys).agg(
        F.min_by("ord", F.struct(-(q * c), F.col("ord"))).alias("by_product"), F.min_by("ord", F.struct(-(q * 0.5 + c * 0.3 + 0.2), F.col("ord"))).alias("by_weights")
    )
