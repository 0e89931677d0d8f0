"""Labels of many density settings at once against one setting at a time, and forests against a plain search."""

import numpy as np
import pytest
from test_vectors import SCHEMA, labels_of, sample

from motioncat.operators import blocks, sweep
from motioncat.operators import clustering as cl

SETTINGS = [("a", 0.2, 0.05, 1), ("b", 0.2, 0.12, 1), ("c", 0.5, 0.09, 2), ("d", 0.5, 0.15, 3), ("e", 0.5, 0.05, 5), ("f", 0.8, 0.12, 2), ("g", 0.2, 0.02, 4)]


@pytest.fixture(scope="module")
def people(spark):
    """Copies of a vector differ in quality, so that populations differ in their copies and first rows."""
    vectors = sample(n_groups=9, copies=25, hot=30)
    rows = [(i, [float(x) for x in v], f"v{i % 5}", str(i % 9), i % 50, 0.3 + (i % 7) / 10, 0.2 + (i * 7 % 8) / 10) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    monkeypatch.setattr(blocks.block_reduce, "__defaults__", (64,))


def test_settings_together_are_settings_one_by_one(people):
    rows = sweep.density_labels(people, SETTINGS).collect()
    for name, quality, eps, samples in SETTINGS:
        want = labels_of(cl.cluster_dbscan(people.filter(people.embedding_quality >= quality), eps, samples))
        got = {r.ord: r.cluster for r in rows if r["name"] == name}
        assert got == want, name
        assert len(got) == sum(r["name"] == name for r in rows)


def test_thresholds_decide(people):
    specs = [("tight", 0.95, 0.2, True, 0.03, 2, 2), ("wide", 0.9, 0.2, True, 0.15, 2, 2), ("linked", 0.9, 0.2, False, 0.1, 1, 3), ("none", 0.9, 0.95, True, 0.1, 1, 2)]
    found = {r["name"]: r for r in cl.tuning_summary(people, specs).collect()}
    assert set(found) == {s[0] for s in specs} and found["none"]["num_clusters"] == found["none"]["largest_cluster"] == 0
    for name, similarity, quality, density, eps, samples, least in specs[:3]:
        good = cl.filter_quality(people, quality)
        labels = cl.cluster_dbscan(good, eps, samples) if density else cl.cluster_complete_link(good, similarity)
        rows = cl.filter_clusters(cl.cluster_quality(good, labels), least).collect()
        assert (found[name]["num_clusters"], found[name]["largest_cluster"]) == (len(rows), max(r.cluster_size for r in rows))
        assert found[name]["avg_quality"] == pytest.approx(np.mean([r.quality_score for r in rows]), abs=1e-9)
    assert found["tight"]["num_clusters"] != found["wide"]["num_clusters"]


def test_empty(spark):
    assert sweep.density_labels(spark.createDataFrame([], SCHEMA), SETTINGS).collect() == []
    assert {r["num_clusters"] for r in cl.tuning_summary(spark.createDataFrame([], SCHEMA), cl.PARAMETER_SETS[:3]).collect()} == {0}


@pytest.mark.parametrize("seed", range(15))
def test_spanning_tree_cuts(seed):
    """At every cut the forest connects what the matrix connects."""
    rng = np.random.default_rng(seed)
    n = 25
    w = np.where(rng.random((n, n)) < 0.15, rng.integers(1, 6, (n, n)) / 10, np.inf)
    w = np.minimum(w, w.T)
    np.fill_diagonal(w, np.inf)
    edges = sweep.spanning_tree(w)
    for cut in (0.1, 0.3, 0.5):
        def parts(pairs):
            label = list(range(n))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return {frozenset(i for i in range(n) if label[i] == v) for v in label}

        assert parts([(a, b) for a, b, x in edges if x <= cut]) == parts(list(zip(*np.nonzero(w <= cut))))
    assert len(edges) < n
