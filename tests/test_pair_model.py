"""The learned pair similarity against Newton's method in one place, and its labelled pairs."""

import numpy as np
import pytest

from motioncat.functions import vectors as V
from motioncat.operators import labels as lb

SCHEMA = "ord long, mega_id long, embedding array<double>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(15, 6))
    members = [(g, base[g] + rng.normal(scale=0.7, size=6)) for g in range(15) for _ in range([3, 8, 30][g % 3])]
    return [(i, g, v.tolist()) for i, (g, v) in enumerate(members)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_labelled_pairs(frame, rows):
    mega = {i: g for i, g, _ in rows}
    pairs = [(r.ord1, r.ord2, r.same) for r in lb.labelled_pairs(frame).collect()]
    assert len({(min(a, b), max(a, b)) for a, b, _ in pairs}) == len(pairs)
    assert all((mega[a] == mega[b]) == same and a != b for a, b, same in pairs)
    place = {i: [j for j, g, _ in rows if g == mega[i]].index(i) for i in mega}
    assert {(a, b) for a, b, same in pairs if same} == {(i, j) for i in mega for j in mega if mega[i] == mega[j] and 0 < place[j] - place[i] <= lb.PARTNERS}
    assert {mega[x] for a, b, same in pairs if not same for x in (a, b)} == set(mega.values())
    some = lb.labelled_pairs(frame, limit=100).collect()
    assert 50 < len(some) < 160 and {(r.ord1, r.ord2, r.same) for r in some} <= set(pairs)


def newton(features, same, ridge):
    weights, held = np.zeros(features.shape[1]), np.full(features.shape[1], ridge)
    held[-1] = 0
    for _ in range(200):
        p = 1 / (1 + np.exp(-features @ weights))
        weights = weights - np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + np.diag(held), features.T @ (p - same) + held * weights)
    return weights


def test_fit_is_the_minimum(frame, rows):
    weights, offset = lb.fit_pair_model(frame, ridge=0.5, tolerance=1e-14)
    unit = {r.ord: np.array(r.e) for r in frame.select("ord", V.unit(frame.embedding, V.EPSILON).alias("e")).collect()}
    pairs = lb.labelled_pairs(frame).collect()
    a, b = (np.array([unit[r[c]] for r in pairs]) for c in ("ord1", "ord2"))
    features = np.hstack([np.abs(a - b), a * b, np.ones((len(a), 1))])
    want = newton(features, np.array([r.same for r in pairs], float), 0.5)
    assert np.allclose(np.append(weights, offset), want, atol=1e-6)


def test_one_class_is_refused(spark):
    alone = spark.createDataFrame([(i, 1, [1.0, float(i)]) for i in range(5)], SCHEMA)
    with pytest.raises(ValueError):
        lb.fit_pair_model(alone)
    with pytest.raises(ValueError):
        lb.fit_pair_model(alone.limit(0))
