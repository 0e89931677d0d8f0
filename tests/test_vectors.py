"""Similarity, clustering and profiles against brute force, with hot groups and many blocks."""

import numpy as np
import pytest

from motioncat.operators import blocks
from motioncat.operators import clustering as cl
from motioncat.operators import labels as lb

SCHEMA = "ord long, embedding array<double>, video_filename string, track_id string, frame_number int, confidence double, embedding_quality double"


def sample(n_groups=12, copies=40, hot=150, dim=8, seed=3):
    """Groups of near copies, one hot group of exact copies, and loose vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n_groups):
        base = rng.normal(size=dim)
        rows += [base + rng.normal(scale=0.12, size=dim) for _ in range(copies)]
    rows += [rows[0]] * hot
    rows += list(rng.normal(size=(60, dim)))
    order = rng.permutation(len(rows))
    return np.array([rows[i] for i in order])


@pytest.fixture(scope="module")
def vectors():
    return sample()


@pytest.fixture(scope="module")
def people(spark, vectors):
    rows = [(i, [float(x) for x in v], f"v{i % 5}", str(i % 9), i % 50, 0.3 + (i % 7) / 10, 0.2 + (i % 8) / 10) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks and pivots small enough that cells split and vectors travel as guests."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 128)
    monkeypatch.setattr(blocks.block_reduce, "__defaults__", (128,))
    original = blocks._choose_pivots
    monkeypatch.setattr(blocks, "_choose_pivots", lambda reps, rows, reach: original(reps, 400 * 16, reach))


def cosines(vectors):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return u @ u.T


def labels_of(df):
    return {r.ord: r.cluster for r in df.collect()}


def same_partition(a, b):
    assert a.keys() == b.keys()
    pairs = {(a[k], b[k]) for k in a}
    assert len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})


def test_pairs(people, vectors):
    sims = cosines(vectors)
    _, first = np.unique(vectors, axis=0, return_index=True)
    ids = sorted(first)
    want = {(i, j) for i in ids for j in ids if i < j and sims[i, j] >= 0.9}
    rows = blocks.similarity_pairs(people, 0.9).collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)
    assert max(r.copies_a for r in rows) > 100 or max(r.copies_b for r in rows) > 100


@pytest.mark.parametrize("eps, samples", [(0.05, 3), (0.12, 5), (0.02, 1)])
def test_dbscan(people, vectors, eps, samples):
    near = 1 - np.clip(cosines(vectors), 0, 1) <= eps
    np.fill_diagonal(near, True)
    core = near.sum(1) >= samples
    label = np.full(len(vectors), -1)
    for i in range(len(vectors)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], i
        while stack:
            x = stack.pop()
            if core[x]:
                for y in np.flatnonzero(near[x] & (label == -1)):
                    label[y] = i
                    stack.append(y)
    assert labels_of(cl.cluster_dbscan(people, eps, samples)) == {i: v for i, v in enumerate(label) if v != -1}


@pytest.mark.parametrize("threshold", [0.85, 0.95])
def test_greedy(people, vectors, threshold):
    sims, label = cosines(vectors), {}
    for i in range(len(vectors)):
        if i in label:
            continue
        label[i] = i
        for j in range(i + 1, len(vectors)):
            if j not in label and sims[i, j] >= threshold:
                label[j] = i
    assert labels_of(cl.cluster_greedy(people, threshold)) == label


@pytest.mark.parametrize("threshold", [0.88, 0.96])
def test_complete_link(people, vectors, threshold):
    uniq, back = np.unique(vectors, axis=0, return_inverse=True)
    d = 1 - np.clip(cosines(uniq), 0, 1)
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(uniq))}
    while True:
        i, j = np.unravel_index(d.argmin(), d.shape)
        if not d[i, j] < 1 - threshold:
            break
        groups[i] += groups.pop(j)
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
    of = {m: g for g, ms in groups.items() for m in ms}
    same_partition(labels_of(cl.cluster_complete_link(people, threshold)), {i: of[b] for i, b in enumerate(back.ravel())})


def test_cluster_quality_small_and_large(people, vectors):
    labels = people.selectExpr("ord", "if(ord < 300, 0L, if(ord < 310, 1L, ord)) AS cluster")
    got = {r.cluster: r for r in cl.cluster_quality(people, labels).collect()}
    sims = cosines(vectors)
    for name, index in ((0, np.arange(300)), (1, np.arange(300, 310))):
        part = sims[np.ix_(index, index)][np.triu_indices(len(index), k=1)]
        assert got[name].avg_similarity == pytest.approx(part.mean(), abs=1e-9)
        assert got[name].min_similarity == pytest.approx(part.min(), abs=1e-9)
    assert got[400].min_similarity == got[400].avg_similarity == 1.0
    assert len(got) == 2 + len(vectors) - 310


def test_profiles_and_auto_label(spark, people, vectors, monkeypatch):
    rows = people.selectExpr("*", "concat('p', ord % 7) AS person")
    got = {r.person: r for r in lb.person_profiles(rows).collect()}
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for k in range(7):
        index = np.arange(k, len(vectors), 7)[:12]
        few = rows.filter(rows.ord.isin([int(i) for i in index]))
        expanded = np.repeat(index, len(index) - 1)
        part = (u[expanded] @ u[expanded].T)[np.triu_indices(len(expanded), k=1)]
        r = lb.person_profiles(few).first()
        assert r.threshold == pytest.approx(max(0.7, part.mean() - 2 * part.std()), abs=1e-9)
        assert r.samples == len(expanded)
        assert np.allclose(r.profile, vectors[index].mean(0)) and np.allclose(r.std, vectors[index].std(0))
    profiles = spark.createDataFrame([(p, r.profile, 0.2) for p, r in got.items()], "person string, profile array<double>, threshold double")
    one = {r.ord: (r.person, round(r.confidence, 9)) for r in lb.auto_label(people, profiles).collect()}
    m = np.array([got[p].profile for p in sorted(got)])
    sims = u @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    for i, row in enumerate(sims):
        best = row.argmax()
        name = sorted(got)[best] if row[best] > 0.2 else None
        assert one[i][0] == name
        top = np.sort(row)
        assert one[i][1] == pytest.approx(min(1.0, max(row[best] if name else 0.0, 0.0) + top[-1] - top[-2]), abs=1e-6)
    matches = {(r.ord, r.person) for r in lb.profile_matches(people, profiles).collect()}
    monkeypatch.setattr(lb, "COLLECTED_PROFILES", 3)
    assert {r.ord: (r.person, round(r.confidence, 9)) for r in lb.auto_label(people, profiles).collect()} == one
    assert {(r.ord, r.person) for r in lb.profile_matches(people, profiles).collect()} == matches


def test_profiles_of_split_persons(spark, people, vectors, monkeypatch):
    """Persons dealt over many buckets, persons with fewer and more vectors than coordinates, and rows without a person."""
    rows = people.selectExpr("*", "CASE WHEN ord % 3 = 0 THEN 'hot' WHEN ord % 3 = 1 THEN concat('p', ord % 40) WHEN ord % 2 = 0 THEN concat('one', ord) END AS person")
    whole = {r.person: r for r in lb.person_profiles(rows).collect()}
    monkeypatch.setattr(lb, "GRAM_ROWS", 1)
    split = {r.person: r for r in lb.person_profiles(rows).collect()}
    assert set(split) == set(whole) and "hot" in whole and not any(p.startswith("one") for p in whole)
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    names = {r.ord: r.person for r in rows.select("ord", "person").collect()}
    for person, r in whole.items():
        v = u[[o for o, p in names.items() if p == person]]
        n, sims = len(v), (v @ v.T)[np.triu_indices(len(v), k=1)]
        times, own = (n - 1) ** 2, n * (n - 1) * (n - 2) / 2  # in the list each vector stands n - 1 times
        weight = times * len(sims) + own
        mean, square = (times * sims.sum() + own) / weight, (times * (sims**2).sum() + own) / weight
        want = max(0.7, mean - 2 * np.sqrt(max(0.0, square - mean**2)))
        assert r.threshold == pytest.approx(want, abs=1e-9) and split[person].threshold == pytest.approx(want, abs=1e-9)
        assert r.samples == n * (n - 1) == split[person].samples


def test_ten_thousand_profiles(spark, people, vectors):
    """More profiles than one broadcast: whole results, and no embedding in a shuffle."""
    rng = np.random.default_rng(3)
    made = rng.standard_normal((10_000, vectors.shape[1]))
    made[::100] = vectors[rng.integers(0, len(vectors), 100)]
    profiles = spark.createDataFrame([(f"p{i:05d}", v.tolist(), 0.95) for i, v in enumerate(made)], "person string, profile array<double>, threshold double")
    few = people.filter("ord % 5 = 0")
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = u @ (made / np.linalg.norm(made, axis=1, keepdims=True)).T
    labeled = lb.auto_label(few, profiles)
    exchanged = [line for line in labeled._jdf.queryExecution().toString().splitlines() if "Exchange" in line]
    assert exchanged and not any("embedding" in line for line in exchanged)
    got = {r.ord: r for r in labeled.collect()}
    assert set(got) == set(range(0, len(vectors), 5))
    for o, r in got.items():
        best = sims[o].argmax()
        top = np.sort(sims[o])
        found = top[-1] > 0.95
        assert r.person == (f"p{best:05d}" if found else None) or sims[o][int(r.person[1:])] == pytest.approx(top[-1], abs=1e-12)
        assert r.confidence == pytest.approx(min(1.0, (top[-1] if found else 0.0) + top[-1] - top[-2]), abs=1e-6)
    matches = {(r.ord, r.person) for r in lb.profile_matches(few, profiles).collect()}
    clear = {(o, f"p{j:05d}") for o in got for j in np.nonzero(sims[o] > 0.95 + 1e-6)[0]}
    edge = {(o, f"p{j:05d}") for o in got for j in np.nonzero(sims[o] > 0.95 - 1e-6)[0]}
    assert clear <= matches <= edge


def test_negative_pairs_against_listing(spark):
    sizes = [3, 1, 7, 2, 6, 4]
    rows = [(m, o) for o, m in enumerate(m for m, n in enumerate(sizes) for _ in range(n))]
    groups = [[o for m2, o in rows if m2 == m][:5] for m in range(len(sizes))]
    want = [(a, b, i, j) for a in range(6) for b in range(a + 1, 6) for i in groups[a] for j in groups[b]]
    limit = 2 * sum(n * (n - 1) // 2 for n in sizes)
    got = lb.negative_pairs(spark.createDataFrame(rows, "mega_id long, ord long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want[:limit])


def test_learned_similarity_separates(spark, people, vectors):
    rows = people.selectExpr("*", "if(ord % 2 = 0, 0L, 1L) AS mega_id").filter("ord < 80")
    shifted = rows.selectExpr("ord", "mega_id", "transform(embedding, (x, i) -> x * 0.1 + if(i % 2 = mega_id, 1.0D, 0.0D)) AS embedding")
    scored = lb.classify_neighbours(shifted, lb.fit_pair_model(shifted)).collect()
    assert scored and not any(r.same for r in scored)


def test_quality_filter_and_report_defaults(people):
    kept = cl.filter_quality(people, 0.5)
    assert 0 < kept.count() < people.count()
    assert cl.filter_quality(people.selectExpr("* except(embedding)", "array_repeat(0.5D, 8) AS embedding"), 0.0).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 500])
def test_scores_look_twice_only_at_close_pairs(width):
    """Single precision leaves pairs out, double precision decides: the same answers as all pairs in double precision."""
    rng = np.random.default_rng(width)
    v = np.concatenate([rng.normal(size=(200, 32)), np.zeros((2, 32))])
    profiles = np.concatenate([v[:width] * (1 + 1e-7 * rng.normal(size=(min(width, 202), 32))), rng.normal(size=(max(0, width - 202), 32))])
    unit, thresholds = lb.blocks.unit_rows(v, lb.V.EPSILON), rng.uniform(0.3, 0.9, width)
    thresholds[0] = (unit @ lb.blocks.unit_rows(profiles, lb.V.EPSILON).T)[0, 0]  # not above itself
    names = np.array([f"p{i:03}" for i in range(width)], dtype=object)
    sims = unit @ lb.blocks.unit_rows(profiles, lb.V.EPSILON).T
    size = 7 if width > 7 else width
    tiles = [lb._Tile(profiles[i : i + size], thresholds[i : i + size], names[i : i + size]) for i in range(0, width, size)]
    whole = lb._Tile(profiles, thresholds, names)
    looked = len(whole.above(unit, 0)[0])
    assert width < 500 or looked < sims.size / 16
    ids = np.arange(len(v))
    above = sims > thresholds + 1e-15
    found = lb._matches_of_tiles([lb._matches(ids, unit, t) for t in tiles])
    assert {(o, p) for o, p in zip(found["ord"], found["person"]) if (o, p) != (0, "p000")} == {(i, names[j]) for i, j in zip(*np.nonzero(above)) if (i, j) != (0, 0)}
    best = lb._best_of_tiles([lb._best(ids, unit, t) for t in tiles])
    top = np.sort(sims, axis=1)
    assert np.allclose(best["top1"], top[:, -1], atol=1e-12)
    assert best["top2"].isna().all() if width == 1 else np.allclose(best["top2"], top[:, -2], atol=1e-12)
    masked = np.where(above & (sims > 0), sims, 0.0)
    assert np.allclose(best["best"][1:], masked.max(axis=1)[1:], atol=1e-12)
    assert [p for p in best["person"][1:]] == [names[r.argmax()] if r.max() > 0 else None for r in masked[1:]]
