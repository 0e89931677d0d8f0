"""Cells of two levels and folds by parts: every pair once, flat copies, and the same clusters as one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import SCHEMA, cosines, labels_of, same_partition, sample

from motioncat.functions import vectors as V
from motioncat.operators import blocks
from motioncat.operators import clustering as cl


def frame(spark, vectors):
    rows = [(i, [float(x) for x in v], "v", str(i % 9), i % 50, 0.9, 0.9) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def two_levels(monkeypatch):
    monkeypatch.setattr(blocks, "CELL_ROWS", 100)
    monkeypatch.setattr(blocks, "INNER_ROWS", 20)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    monkeypatch.setattr(blocks.block_reduce, "__defaults__", (64,))


def test_second_level_divides_and_finds_every_pair_once(spark, two_levels):
    vectors = sample(n_groups=10, copies=30, hot=5)
    people, sims = frame(spark, vectors), cosines(vectors)
    reps, _ = blocks.distinct_vectors(people)
    cells = blocks.in_cells(reps, 0.85)
    assert cells.select("cell").distinct().count() > 8
    assert cells.filter("home and inner").count() == reps.count() == cells.filter("home and inner").select("id").distinct().count()
    rows = blocks.similarity_pairs(people, 0.85).collect()
    _, first = np.unique(vectors, axis=0, return_index=True)
    want = {(i, j) for i in first for j in first if i < j and sims[i, j] >= 0.85}
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_dbscan_over_two_levels(spark, two_levels, monkeypatch):
    people = frame(spark, sample(n_groups=8, copies=30, hot=10))
    divided = labels_of(cl.cluster_dbscan(people, 0.1, 3))
    monkeypatch.setattr(blocks, "CELL_ROWS", 1 << 30)
    assert divided == labels_of(cl.cluster_dbscan(people, 0.1, 3))


def test_copies_per_row_stay_flat(spark, two_levels):
    """Ten times the rows in ten times the groups: more cells, not more visits by each row."""
    visits = []
    for groups in (6, 60):
        rng = np.random.default_rng(groups)
        base = rng.normal(size=(groups, 24))
        vectors = np.repeat(base, 25, axis=0) + rng.normal(scale=0.03, size=(groups * 25, 24))
        reps, _ = blocks.distinct_vectors(frame(spark, vectors))
        cells = blocks.in_cells(reps, 0.95)
        visits.append(cells.count() / len(vectors))
    assert visits[1] < 1.5 * visits[0], visits


def one_by_one(sims, limit):
    d = 1 - np.clip(sims, 0, 1)
    d[d >= limit] = np.inf
    np.fill_diagonal(d, np.inf)
    first = np.arange(len(d))
    while np.isfinite(d).any():
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        first[first == j] = i
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
    return first


@pytest.mark.parametrize("seed", range(20))
def test_chain_is_one_by_one_merging(seed):
    """Rounded distances, so that many are equal."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(40, 3)).round(1)
    sims = cosines(v + 1e-9).round(2 if seed % 2 else 12)
    d = 1 - np.clip(sims, 0, 1)
    got = cl.nearest_neighbour_chain(np.where(d < 0.2, d, np.inf))
    assert got.tolist() == one_by_one(sims, 0.2).tolist()


def test_parts_beyond_a_block_give_the_same_clusters(spark, monkeypatch):
    vectors = sample(n_groups=5, copies=60, hot=20)
    people = frame(spark, vectors)
    complete, greedy = labels_of(cl.cluster_complete_link(people, 0.9)), labels_of(cl.cluster_greedy(people, 0.9))
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)  # now parts of over 40 rows go through rounds, smaller ones are folded
    same_partition(labels_of(cl.cluster_complete_link(people, 0.9)), complete)
    assert labels_of(cl.cluster_greedy(people, 0.9)) == greedy


def test_no_pair_is_stored_for_small_parts(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(cl, "_complete_link_rounds", lambda *a: stored.append(a))
    cl.cluster_complete_link(frame(spark, sample(n_groups=4, copies=30, hot=20)), 0.9).collect()
    assert not stored


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cl.cluster_complete_link(none, 0.9).collect() == cl.cluster_greedy(none, 0.9).collect() == []
    assert blocks.in_cells(none.withColumn("id", F.col("ord")).select("id", V.unit(F.col("embedding")).alias("embedding")), 0.9).count() == 0


def test_copies_of_a_vector_on_their_way_are_few():
    """Vectors without structure reach every cell: pivots are dropped rather than sending each vector to all of them."""
    rng = np.random.default_rng(3)
    vectors = blocks.unit_rows(rng.normal(size=(400, 16)))
    pivots = blocks._few_visits(vectors, 100, 0.6, blocks.VISITS)
    assert len(blocks._route(vectors, pivots, 0.6)[0]) <= blocks.VISITS * len(vectors)
    assert blocks._block_rows(400_000, 64, blocks.BLOCK_ROWS) * blocks.BLOCK_SHARE >= 400_000
    assert blocks._block_rows(1 << 40, 64, blocks.BLOCK_ROWS) * 64 * 8 <= blocks.BLOCK_BYTES


def test_links_as_stars():
    found = blocks.stars(np.array([5, 9, 7, 2]), np.array([9, 7, 3, 4]))
    assert sorted(zip(found["a"], found["b"])) == [(2, 4), (3, 5), (3, 7), (3, 9)]


def test_pivots_are_kept_only_while_they_save_copies():
    """A row is sent once for each block of every cell it goes to: without structure one cell of all blocks is the least."""
    rng = np.random.default_rng(3)
    loose = blocks.unit_rows(rng.normal(size=(400, 64)))
    assert len(blocks._few_visits(loose, 32, 0.49, blocks.VISITS, 8.0)) == 1
    base = rng.normal(size=(8, 64))
    tight = blocks.unit_rows(np.repeat(base, 50, axis=0) + rng.normal(scale=0.01, size=(400, 64)))
    pivots = blocks._few_visits(tight[rng.permutation(400)], 8, 0.1, blocks.VISITS, 8.0)
    assert len(pivots) > 4


def test_dbscan_compares_once_unless_pairs_are_many(spark, monkeypatch):
    people = frame(spark, sample(n_groups=8, copies=30, hot=10))
    passes, reduce_ = [], blocks.block_reduce

    def counted(*a, **k):
        passes.append(a[2])
        return reduce_(*a, **k)

    monkeypatch.setattr(blocks, "block_reduce", counted)
    for samples in (1, 3, 29):
        passes.clear()
        monkeypatch.setattr(blocks, "TASK_PAIRS", 1 << 19)
        once = labels_of(cl.cluster_dbscan(people, 0.1, samples))
        assert len(passes) == 1
        monkeypatch.setattr(blocks, "TASK_PAIRS", 5)
        assert once == labels_of(cl.cluster_dbscan(people, 0.1, samples)) and len(passes) == 4
