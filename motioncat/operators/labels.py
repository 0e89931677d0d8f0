"""Labels, mega-clusters (persons), training pairs, profiles and auto-labelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motioncat.functions import vectors as V
from motioncat.operators import blocks
from motioncat.operators.ordered import running
from motioncat.session import materialize, small_side

# ---- fixed values ----
MIN_THRESHOLD, HIGH_CONFIDENCE = 0.7, 0.8
NEGATIVES_PER_PERSON = 5
# profiles scored at once, rows scored at once, and profiles in a broadcast as a multiple of the first
COLLECTED_PROFILES, SCORED_ROWS, CHUNK_TILES = 4096, 512, 16
GRAM_ROWS = 4  # rows for each coordinate from which a person's vectors are dealt over buckets
# Pairs that the learned similarity is fitted on at most (about), partners of a row in them, and rows summed in each first branch.
LABELLED_PAIRS, PARTNERS, BRANCHES = 500_000, 8, 16


def vector_stats(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Elementwise mean and population deviation per key, combined before the shuffle."""
    m = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vector)))
    got = rows.groupBy(*keys).agg(m.alias("s"))
    n = F.col("s.count")
    share = F.when(n > 1, (n - 1) / n).otherwise(0.0)
    out = got.select(*keys, n.alias("n"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("_v"), share.alias("_k"))
    return out.withColumn("std", F.transform("_v", lambda v: F.sqrt(v * F.col("_k")))).drop("_v", "_k")


# ---- label and membership events ----

def assign_labels(events: DataFrame) -> DataFrame:
    """Current label per cluster: the last event wins, verified unless it says otherwise."""
    last = events.groupBy("cluster_id").agg(F.max_by(F.struct("label", "notes", "verified"), "seq").alias("e"))
    return last.select("cluster_id", F.col("e.label").alias("label"), F.col("e.notes").alias("notes"), F.coalesce("e.verified", F.lit(True)).alias("verified"))


def mega_membership(events: DataFrame) -> DataFrame:
    """Current mega-cluster of each cluster from create/add/remove events; the last event wins."""
    last = events.groupBy("cluster_id").agg(F.max_by(F.struct("action", "mega_id"), "seq").alias("e"))
    return last.filter(F.col("e.action") != "remove").select("cluster_id", F.col("e.mega_id").alias("mega_id"))


def surviving_megas(events: DataFrame) -> DataFrame:
    """Mega-clusters with their member count.

    A mega-cluster that lost its last member to a create or remove event is gone; one whose
    last member was moved away by an add event stays, empty.
    """
    along = Window.partitionBy("cluster_id").orderBy("seq")
    moved = events.withColumn("_old", F.lag(F.when(F.col("action") != "remove", F.col("mega_id"))).over(along))
    left = moved.filter(F.col("_old").isNotNull()).groupBy(F.col("_old").alias("mega_id")).agg(F.max_by("action", "seq").alias("last_leave"))
    members = mega_membership(events).groupBy("mega_id").agg(F.count("*").alias("members"))
    made = events.filter("action <> 'remove'").select("mega_id").distinct()
    out = made.join(members, "mega_id", "left").join(left, "mega_id", "left")
    return out.filter(F.col("members").isNotNull() | (F.col("last_leave") == "add")).select(
        "mega_id", F.coalesce("members", F.lit(0).cast("bigint")).alias("members")
    )


def clusters_with_labels(clusters: DataFrame, labels: DataFrame, megas: DataFrame) -> DataFrame:
    return clusters.join(labels, "cluster_id", "left").join(megas, "cluster_id", "left")


def unclustered(clusters: DataFrame, megas: DataFrame) -> DataFrame:
    return clusters.join(megas, "cluster_id", "left_anti")


def mega_summary(clusters: DataFrame, labels: DataFrame, megas: DataFrame) -> DataFrame:
    """Clusters, embeddings and verified labels per mega-cluster."""
    joined = clusters.join(megas, "cluster_id").join(labels, "cluster_id", "left")
    verified = F.sum(F.coalesce(F.col("verified"), F.lit(False)).cast("bigint"))
    return joined.groupBy("mega_id").agg(
        F.count("*").alias("clusters"), F.sum("cluster_size").alias("embeddings"), verified.alias("verified"),
        F.min("cluster_id").alias("first_cluster"), F.max("cluster_id").alias("last_cluster"),
    )


def labeling_status(clusters: DataFrame, labels: DataFrame, megas: DataFrame) -> DataFrame:
    """How many clusters are labelled, verified and in a mega-cluster, with percents."""
    all_in = clusters_with_labels(clusters, labels, megas)
    hit = lambda c: F.sum(c.cast("bigint"))
    t = all_in.agg(
        F.count("*").alias("clusters"), hit(F.col("label").isNotNull()).alias("labeled"),
        hit(F.coalesce(F.col("verified"), F.lit(False))).alias("verified"), hit(F.col("mega_id").isNotNull()).alias("in_mega"),
    )
    pct = lambda c: F.when(F.col("clusters") > 0, F.col(c) * 100 / F.col("clusters")).alias(f"{c}_pct")
    return t.select("*", pct("labeled"), pct("verified"), pct("in_mega"))


# ---- training pairs ----

def _positions(rows: DataFrame, mega: str) -> DataFrame:
    """1-based position of each row within its mega-cluster, in input order, for groups of any size."""
    return running(rows, [mega], ["ord"], {"pos": F.lit(1)})


def positive_pairs(rows: DataFrame, mega: str = "mega_id") -> DataFrame:
    """Pairs within a mega-cluster, run-length coded: each row pairs with the ``partners`` rows after it.

    The list of pairs grows with the square of a group, so it is never written out: row
    ``pos`` of a group stands for its pairs with positions pos + 1 .. pos + partners, and
    ``pair_offset`` is the number of pairs of the group that come before.
    """
    placed = _positions(rows.select(mega, "ord"), mega)
    size = rows.groupBy(mega).agg(F.count("*").alias("n"))
    p, n = F.col("pos"), F.col("n")
    return placed.join(size, mega).select(
        mega, "ord", "pos", (n - p).alias("partners"), ((p - 1) * n - (p - 1) * p / 2).cast("bigint").alias("pair_offset")
    )


def negative_pairs(rows: DataFrame, mega: str = "mega_id", first: int = NEGATIVES_PER_PERSON) -> DataFrame:
    """Pairs between mega-clusters: the first rows of each, in order, cut to twice the positive pairs.

    Groups are numbered; the pairs an earlier group opens are counted first, and only as
    many partner groups are generated as the limit can use.
    """
    counts = rows.groupBy(mega).agg(F.count("*").alias("n"))
    total_positive = counts.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).alias("p")).first().p
    limit = int(2 * total_positive)
    by_order = Window.partitionBy(mega).orderBy("ord")
    head = rows.select(mega, "ord").withColumn("rank", F.row_number().over(by_order)).filter(F.col("rank") <= first)
    head = materialize(head, "heads")
    sizes = head.groupBy(mega).agg(F.count("*").alias("c")).withColumn("_all", F.lit(0))
    groups = materialize(running(sizes, ["_all"], [mega], {"g": F.lit(1), "upto": F.col("c")}).drop("_all"), "groups")
    top = groups.agg(F.max("g").alias("g"), F.max("upto").alias("rows")).first()
    if top.g is None or top.g < 2 or limit == 0:
        return head.select(F.col(mega).alias("mega1"), F.col(mega).alias("mega2"), F.col("ord").alias("ord1"), F.col("ord").alias("ord2")).limit(0)
    # a group opens c * (rows of all later groups) pairs
    opened = groups.withColumn("opens", F.col("c") * (F.lit(top.rows) - F.col("upto"))).withColumn("_all", F.lit(0))
    opened = running(opened.select(mega, "g", "c", "upto", "opens", "_all"), ["_all"], ["g"], {"after": F.col("opens")})
    useful = opened.withColumn("before", F.col("after") - F.col("opens")).filter(F.col("before") < limit)
    # every later group opens at least c pairs, so no more of them than this can be of use
    last = F.greatest(F.col("g") + 1, F.least(F.lit(top.g), F.col("g") + F.ceil((F.lit(limit) - F.col("before")) / F.col("c"))))
    pairs = useful.select(F.col(mega).alias("mega1"), "g", "c", "upto", "before", F.explode(F.sequence(F.col("g") + 1, last)).alias("g2"))
    later = groups.select(F.col(mega).alias("mega2"), F.col("g").alias("g2"), F.col("c").alias("c2"), F.col("upto").alias("upto2"))
    pairs = pairs.join(later, "g2")
    # place of the first pair of two groups in the whole list
    start = F.col("before") + F.col("c") * (F.col("upto2") - F.col("c2") - F.col("upto"))
    pairs = pairs.withColumn("start", start).filter(F.col("start") < limit)
    one = head.select(F.col(mega).alias("mega1"), F.col("ord").alias("ord1"), F.col("rank").alias("r1"))
    two = head.select(F.col(mega).alias("mega2"), F.col("ord").alias("ord2"), F.col("rank").alias("r2"))
    full = pairs.join(one, "mega1").join(two, "mega2")
    place = F.col("start") + (F.col("r1") - 1) * F.col("c2") + F.col("r2") - 1
    return full.filter(place < limit).select("mega1", "mega2", "ord1", "ord2")


# ---- profiles ----

def _pair_sums(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, s, q): number of unit vectors, and the sum of v.w and of (v.w)^2 over all pairs of them, (v, v) included.

    A key's rows meet in one task, many keys to a task, where the smaller of two products is formed:
    of the n vectors with each other, or of their d coordinates (the Gram matrix; both have the same
    squared sum). A key of more than ``GRAM_ROWS`` * d rows is dealt over as many buckets as it needs,
    and hands on a Gram matrix for each, a ``1 / GRAM_ROWS`` of its rows. So the rows are shuffled once.
    """
    known = rows.filter(F.col(key).isNotNull()).select(key, "ord", "embedding")
    sizes = known.groupBy(key).agg(F.ceil(F.count("*") / (GRAM_ROWS * F.max(F.size("embedding")))).cast("int").alias("buckets"))
    dealt = known.join(small_side(sizes.filter("buckets > 1")), key, "left")
    dealt = dealt.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("ord"), F.col("buckets")), F.lit(-1))).select(key, "bucket", "embedding")
    kind = rows.schema[key].dataType.simpleString()

    def closed(name: object, bucket: int, parts: list[np.ndarray]) -> tuple:
        v = np.concatenate(parts)
        total = v.sum(axis=0)
        if bucket >= 0:
            return name, len(v), None, None, total, (v.T @ v).ravel()
        products = v @ v.T if len(v) < v.shape[1] else v.T @ v
        return name, len(v), float(total @ total), float((products**2).sum()), None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "n", "s", "q", "total", "gram"]
        group, parts = None, []
        for pdf in batches:
            if pdf.empty:
                continue
            vectors = blocks.unit_rows(blocks.matrix(pdf["embedding"]))
            names, buckets, out = pdf[key].to_numpy(), pdf["bucket"].to_numpy(), []
            starts = [0, *(np.nonzero((names[1:] != names[:-1]) | (buckets[1:] != buckets[:-1]))[0] + 1), len(pdf)]
            for at, end in zip(starts, starts[1:]):
                own = names[at], int(buckets[at])
                if own != group:
                    if parts:
                        out.append(closed(*group, parts))
                    group, parts = own, []
                parts.append(vectors[at:end])
            yield pd.DataFrame(out, columns=columns)
        if parts:
            yield pd.DataFrame([closed(*group, parts)], columns=columns)

    schema = f"`{key}` {kind}, n long, s double, q double, total array<double>, gram array<double>"
    sums = materialize(dealt.repartition(key, "bucket").sortWithinPartitions(key, "bucket").mapInPandas(run, schema), "pair-sums")
    add = lambda c: vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    split = sums.filter("gram IS NOT NULL").groupBy(key).agg(F.sum("n").alias("n"), add("total"), add("gram"))
    return sums.filter("gram IS NULL").select(key, "n", "s", "q").unionByName(split.select(key, "n", square("total").alias("s"), square("gram").alias("q")))


def person_profiles(rows: DataFrame, person: str = "person") -> DataFrame:
    """Profile per person with at least two embeddings: mean and deviation vectors and a threshold.

    The threshold is max(0.7, mean - 2 deviations) of the pair similarities over the list of
    pair members, in which each of n vectors stands n - 1 times: a pair of two vectors counts
    (n - 1)^2 times and a vector meets its own copies with similarity 1. Rows need ``ord``.
    """
    stats = vector_stats(rows, [person])
    moments = _pair_sums(rows, person)
    n = F.col("n").cast("double")
    pair_sum, pair_square = (F.col("s") - n) / 2, (F.col("q") - n) / 2
    weight, own = (n - 1) * (n - 1), n * (n - 1) * (n - 2) / 2
    all_pairs = weight * n * (n - 1) / 2 + own
    sim = moments.filter("n >= 2").select(
        person, ((weight * pair_sum + own) / all_pairs).alias("_m"), ((weight * pair_square + own) / all_pairs).alias("_q"),
        (n * (n - 1)).cast("bigint").alias("samples"),
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("_m") * F.col("_m")))
    threshold = F.greatest(F.lit(MIN_THRESHOLD), F.col("_m") - 2 * spread)
    return stats.join(sim, person).select(person, F.col("mean").alias("profile"), "std", "samples", threshold.alias("threshold"))


class _Tile:
    """At most ``COLLECTED_PROFILES`` profiles as unit vectors, in single precision too for a first look."""

    def __init__(self, profiles: np.ndarray, thresholds: np.ndarray, names: np.ndarray) -> None:
        self.unit, self.thresholds, self.names = blocks.unit_rows(profiles, V.EPSILON), thresholds, names
        self.rough, self.margin = self.unit.T.astype(np.float32), (profiles.shape[1] + 8) * 2.0**-23
        self.low = np.nextafter((thresholds - self.margin).astype(np.float32), np.float32(-np.inf))

    def above(self, unit: np.ndarray, tops: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, profile, similarity) in double precision of all pairs above the profile's threshold, and among them
        each row's ``tops`` highest; single precision, whose error stays within the margin, only leaves out pairs."""
        sims = unit.astype(np.float32) @ self.rough
        wanted = ~(sims <= self.low[None, :])
        if tops:
            rows, kth, found = np.arange(len(sims)), np.full(len(sims), -2, np.float32), []
            for _ in range(tops if sims.shape[1] > tops else 0):
                at = sims.argmax(axis=1)
                kth = sims[rows, at]
                found.append((at, kth))
                sims[rows, at] = -np.inf
            for at, value in found:
                sims[rows, at] = value
            wanted |= ~(sims < (kth - 2 * self.margin)[:, None])
        i, j = np.nonzero(wanted)
        if len(i) > sims.size // 16:  # too many to look at one by one
            return i, j, (unit @ self.unit.T)[i, j]
        return i, j, np.einsum("ij,ij->i", unit[i], self.unit[j])


def _best(ids: np.ndarray, unit: np.ndarray, tile: _Tile) -> pd.DataFrame:
    """Two highest similarities and the best profile above its own threshold, per embedding."""
    i, j, sims = tile.above(unit, 2)
    order = np.lexsort((j, -sims, i))
    i, j, sims = i[order], j[order], sims[order]
    starts = np.searchsorted(i, np.arange(len(ids)))
    second = np.where(np.append(starts[1:], len(i)) - starts > 1, sims[np.minimum(starts + 1, len(i) - 1)], np.nan)
    hit = np.flatnonzero((sims > tile.thresholds[j]) & (sims > 0))
    row, first = np.unique(i[hit], return_index=True)
    person, best = np.full(len(ids), None, dtype=object), np.zeros(len(ids))
    person[row], best[row] = tile.names[j[hit[first]]], sims[hit[first]]
    return pd.DataFrame({"ord": ids, "top1": sims[starts], "top2": second, "person": person, "best": best})


def _best_of_tiles(found: list[pd.DataFrame]) -> pd.DataFrame:
    tops = np.sort(-np.column_stack([f[c].to_numpy() for f in found for c in ("top1", "top2")]), axis=1)  # highest first, NaN last
    best = np.column_stack([f["best"].to_numpy() for f in found])
    at, rows = best.argmax(axis=1), np.arange(len(best))
    person = np.column_stack([f["person"].to_numpy(dtype=object) for f in found])[rows, at]
    return pd.DataFrame({"ord": found[0]["ord"], "top1": -tops[:, 0], "top2": -tops[:, 1], "person": person, "best": best[rows, at]})


def _matches(ids: np.ndarray, unit: np.ndarray, tile: _Tile) -> pd.DataFrame:
    i, j, sims = tile.above(unit, 0)
    keep = sims > tile.thresholds[j]
    return pd.DataFrame({"ord": ids[i[keep]], "person": tile.names[j[keep]], "similarity": sims[keep]})


def _matches_of_tiles(found: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat([f for f in found if len(f)] or found[:1])


def _against_profiles(rows: DataFrame, profiles: DataFrame, person: str, reduce, join, schema: str) -> DataFrame:
    """Apply ``reduce`` to the similarities of embeddings with all profiles, chunk by chunk of profiles.

    A chunk of profiles travels to every task, so the embeddings are never shuffled. With more than
    ``COLLECTED_PROFILES`` one chunk after another, ``CHUNK_TILES`` times as large, is broadcast and taken back,
    and each leaves its few values per embedding in a written table; ``reduce`` sees ``COLLECTED_PROFILES``
    at a time, and ``join`` makes one answer of those of a chunk.
    """
    wanted = profiles.select(F.col(person).cast("string").alias("person"), "profile", "threshold")
    some = wanted.orderBy("person").limit(COLLECTED_PROFILES + 1).collect()
    if not some:
        return rows.sparkSession.createDataFrame([], schema)
    rows, size = rows.select("ord", "embedding"), COLLECTED_PROFILES

    def against(chunk: list) -> tuple[DataFrame, Broadcast]:
        packed = rows.sparkSession.sparkContext.broadcast((
            np.array([r.profile for r in chunk], dtype=float), np.array([r.threshold for r in chunk]), np.array([r.person for r in chunk], dtype=object),
        ))

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vectors, thresholds, names = packed.value
            tiles = [_Tile(vectors[i : i + size], thresholds[i : i + size], names[i : i + size]) for i in range(0, len(names), size)]
            for pdf in batches:
                for at in range(0, len(pdf), SCORED_ROWS):
                    part = pdf.iloc[at : at + SCORED_ROWS]
                    ids, unit = part["ord"].to_numpy(), blocks.unit_rows(blocks.matrix(part["embedding"]), V.EPSILON)
                    yield join([reduce(ids, unit, tile) for tile in tiles])

        return rows.mapInPandas(stream, schema), packed

    if len(some) <= COLLECTED_PROFILES:
        return against(some)[0]
    rows = materialize(rows, "embeddings")
    placed = running(wanted.withColumn("_all", F.lit(0)), ["_all"], ["person"], {"nth": F.lit(1)})
    placed = materialize(placed.withColumn("chunk", F.floor((F.col("nth") - 1) / (COLLECTED_PROFILES * CHUNK_TILES))), "profiles")
    written = []
    for c in range(placed.agg(F.max("chunk")).first()[0] + 1):
        found, packed = against(placed.filter(F.col("chunk") == c).orderBy("person").collect())
        written.append(materialize(found, "scores")._scratch)
        packed.destroy()
    return rows.sparkSession.read.schema(found.schema).parquet(*written)


def profile_matches(rows: DataFrame, profiles: DataFrame, person: str = "person") -> DataFrame:
    """(ord, person, similarity) for every profile whose own threshold the embedding exceeds."""
    return _against_profiles(rows, profiles, person, _matches, _matches_of_tiles, "ord long, person string, similarity double")


def auto_label(rows: DataFrame, profiles: DataFrame, person: str = "person") -> DataFrame:
    """Best person per embedding (null when none) with confidence min(1, best + lead over the runner-up)."""
    part = _against_profiles(rows, profiles, person, _best, _best_of_tiles, "ord long, top1 double, top2 double, person string, best double")
    tops = F.array("top1", "top2")
    merged = part.groupBy("ord").agg(
        F.sort_array(F.filter(F.flatten(F.collect_list(tops)), lambda x: x.isNotNull() & ~F.isnan(x)), asc=False).alias("t"),
        F.min_by(F.struct("person", "best"), F.struct(-F.col("best"), F.col("person"))).alias("b"),
    )
    lead = F.get("t", F.lit(0)) - F.get("t", F.lit(1))
    confidence = F.when(F.size("t") >= 2, F.least(F.lit(1.0), F.col("b.best") + lead)).otherwise(F.col("b.best"))
    return merged.select("ord", F.col("b.person").alias("person"), F.col("b.best").alias("similarity"), confidence.alias("confidence"))


def auto_label_summary(labeled: DataFrame) -> DataFrame:
    hit = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return labeled.agg(
        F.count("*").alias("total"), hit(F.col("person").isNotNull()).alias("labeled"), hit(F.col("confidence") > HIGH_CONFIDENCE).alias("high_confidence")
    )


# ---- learned pair similarity ----

def _pair_features(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hstack([np.abs(a - b), a * b])


def labelled_pairs(rows: DataFrame, mega: str = "mega_id", limit: int = LABELLED_PAIRS) -> DataFrame:
    """(ord1, ord2, same): pairs to learn from, about ``limit`` at most, without forming all pairs of a group.

    Positive: every row with the ``PARTNERS`` rows after it in its mega-cluster. Negative: the listed
    pairs between mega-clusters, and rows of different ones among those whose hashes fall together,
    which spreads over all mega-clusters. Of more pairs those with the lowest hashes are taken.
    """
    placed = materialize(_positions(rows.select(mega, "ord"), mega), "positions")
    ahead = placed.select(mega, F.col("ord").alias("ord1"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + PARTNERS)).alias("pos"))
    same = ahead.join(placed, [mega, "pos"]).select("ord1", F.col("ord").alias("ord2"), F.lit(True).alias("same"))
    groups = max(1, placed.count() // PARTNERS)
    dealt = placed.select(mega, "ord", F.pmod(F.xxhash64("ord"), F.lit(groups)).alias("deal"))
    other = dealt.select(F.col(mega).alias("_mega"), F.col("ord").alias("ord2"), "deal")
    spread = dealt.withColumnRenamed("ord", "ord1").join(other, "deal").filter((F.col("ord1") < F.col("ord2")) & (F.col(mega) != F.col("_mega"))).select("ord1", "ord2")
    apart = negative_pairs(rows, mega).select("ord1", "ord2").union(spread).distinct().withColumn("same", F.lit(False))
    pairs = materialize(same.unionByName(apart), "labelled-pairs")
    n = pairs.count()
    share = F.pmod(F.xxhash64("ord1", "ord2"), F.lit(1 << 30)) < int((1 << 30) * limit / max(n, 1))
    return pairs.filter(share) if n > limit else pairs


def _loss_terms(features: np.ndarray, same: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, its gradient and its Hessian over some pairs."""
    z = features @ weights
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return float(np.logaddexp(0, np.where(same, -z, z)).sum()), features.T @ (p - same), (features * (p * (1 - p))[:, None]).T @ features


def _summed_terms(pairs: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss terms over all pairs: one row from each task, added up in two levels."""
    size, shared = len(weights), pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, gradient, hessian = 0.0, np.zeros(size), np.zeros((size, size))
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                features = np.hstack([_pair_features(blocks.matrix(part["e1"]), blocks.matrix(part["e2"])), np.ones((len(part), 1))])
                terms = _loss_terms(features, part["same"].to_numpy(bool), shared.value)
                loss, gradient, hessian = loss + terms[0], gradient + terms[1], hessian + terms[2]
        yield pd.DataFrame({"terms": [np.concatenate([[loss], gradient, hessian.ravel()])]})

    rows = pairs.select("e1", "e2", "same").mapInPandas(run, "terms array<double>").withColumn("branch", F.spark_partition_id() % BRANCHES)
    add = vector_to_array(Summarizer.sum(array_to_vector("terms"))).alias("terms")
    total = np.array(rows.groupBy("branch").agg(add).agg(add).first().terms)
    shared.unpersist()
    return float(total[0]), total[1 : size + 1], total[size + 1 :].reshape(size, size)


def fit_pair_model(rows: DataFrame, mega: str = "mega_id", ridge: float = 1e-3, tolerance: float = 1e-7, rounds: int = 60, limit: int = LABELLED_PAIRS) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic similarity on [|a - b|, a * b], by Newton steps over labelled pairs.

    A round adds up loss, gradient and Hessian over all tasks; the driver solves for the step. A
    step that does not lower the loss is halved. It ends when the expected gain falls below
    ``tolerance`` of the loss. ``ridge`` holds the weights (not the offset) finite where the classes can be separated.
    """
    unit = materialize(rows.select("ord", V.unit(F.col("embedding"), V.EPSILON).alias("e")), "pair-vectors")
    side = lambda i: unit.select(F.col("ord").alias(f"ord{i}"), F.col("e").alias(f"e{i}"))
    pairs = materialize(labelled_pairs(rows, mega, limit).join(side(1), "ord1").join(side(2), "ord2").select("e1", "e2", "same"), "pair-features")
    kinds = {r.same: r for r in pairs.groupBy("same").agg(F.max(F.size("e1")).alias("dim")).collect()}
    if len(kinds) < 2:
        raise ValueError("both positive and negative pairs are needed")
    weights = np.zeros(2 * kinds[True].dim + 1)
    held = np.full(len(weights), ridge)
    held[-1] = 0.0

    def terms(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, hessian = _summed_terms(pairs, at)
        return loss + 0.5 * float(held @ at**2), gradient + held * at, hessian + np.diag(held)

    loss, gradient, hessian = terms(weights)
    for _ in range(rounds):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if gradient @ step <= tolerance * max(loss, tolerance):
            break
        found = terms(weights - step)
        while found[0] >= loss and np.abs(step).max() > 1e-12:
            step = step / 2
            found = terms(weights - step)
        weights = weights - step
        loss, gradient, hessian = found
    return weights[:-1], float(weights[-1])


def classify_pairs(pairs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Add ``similarity`` and ``same`` (above .5) to pairs with vectors ``e1`` and ``e2``."""
    weights, offset = model
    dim = len(weights) // 2
    lit = lambda w: F.array(*[F.lit(float(x)) for x in w])
    a, b = V.unit(F.col("e1"), V.EPSILON), V.unit(F.col("e2"), V.EPSILON)
    gap, both = F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y)
    z = V.dot(gap, lit(weights[:dim])) + V.dot(both, lit(weights[dim:])) + F.lit(offset)
    scored = pairs.withColumn("similarity", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return scored.withColumn("same", F.col("similarity") > 0.5)


def classify_neighbours(rows: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Score each row against the next one in input order."""
    one = rows.select("ord", F.col("embedding").alias("e1"))
    two = rows.select((F.col("ord") - 1).alias("ord"), F.col("embedding").alias("e2"))
    return classify_pairs(one.join(two, "ord"), model).select("ord", "similarity", "same")
