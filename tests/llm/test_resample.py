"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter
from random import Random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from motioncat.llm import resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = ["the", "Of", "ÄRGER", "日本", "x1", "2024", "river", "stone", "İ", "a", "Bb", "longer" * 9]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plainly(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    rated = []
    for key, text in docs:
        n, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rated.append((key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long_enough = sorted((r for r in rated if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = long_enough[: 25 * len(long_enough) // 100]
    return rated, [(k + 1, r[0], r[4]) for k, r in enumerate(drawn)]


def text(seed, n):
    rng = Random(seed)
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", ".", "!", ", "]) for _ in range(n))


DOCS = [(k, text(k, [0, 5, 19, 20, 60][k % 5])) for k in range(400)]
DOCS += [(None, text(1, 40)), (500, None), (501, "w" * 100_000 + " b"), (502, "word " * 30_000), (503, "\x00\x7f,.-")] + [(600, text(9, 50))] * 7


@pytest.mark.parametrize("slice_bytes", [300, resample.SLICE_BYTES])
def test_against_plain_version(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(resample, "SLICE_BYTES", slice_bytes)
    target = [text(k + 9000, 30).replace("river", "stone") for k in range(40)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in DOCS], "doc_id long, text string, rank string, part string, key string").repartition(5)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    rated, drawn = plainly(DOCS, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == sorted(((k, n, w, s) for k, _, n, w, s in rated), key=repr)
    assert sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"]) == drawn
    assert sum(r.doc_id == 600 for r in got) == 7


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(DOCS[:50], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    rated, drawn = plainly(DOCS[:50], [])
    assert sorted((r["rank"], r.doc_id, r.score) for r in resample.resample(some, none).collect() if r["rank"]) == drawn


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), max_size=60))
def test_crc_matrices(found):
    assert resample.crc_columns(found).tolist() == [zlib.crc32(f) for f in found]


def test_more_frequent_in_target_is_drawn(spark):
    docs = spark.createDataFrame([(k, " ".join([("apple pear plum" if k % 4 == 0 else "iron zinc lead")] * 10)) for k in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("apple pear plum " * 5,)] * 50, "text string")
    drawn = resample.resample(docs, target).filter("rank is not null").collect()
    assert len(drawn) == 100 and sum(r.doc_id % 4 == 0 for r in drawn) > 80
