"""Track paths stored once, histories from chunks with halo, overlap removal beside boxes without area."""

import random

import pytest
from pyspark.sql import functions as F

from motioncat.operators import tags as tg

SCHEMA = "ord string, filename string, frame_number int, type string, value string, confidence double, track_id long, x1 int, y1 int, x2 int, y2 int"


def points(n, seed=0):
    """One track holds a third of all points; some tags have no track, some no file."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        track = 1 if i % 3 == 0 else rng.choice([2, 3, None])
        x, y = rng.randrange(900), rng.randrange(500)
        rows.append((f"{i:06d}", rng.choice(["a.mp4", None]) if track == 3 else "a.mp4", rng.randrange(40), "T", "person", 0.5, track, x, y, x + 20, y + 10))
    return rows


def brute(rows, keep):
    tracks, out = {}, {}
    for r in sorted((r for r in rows if r[6] is not None), key=lambda r: (r[2], r[0])):
        line = tracks.setdefault((r[1], r[6]), [])
        line.append(((r[7] + r[9]) // 2, (r[8] + r[10]) // 2))
        out[r[0]] = (len(line), line[-keep:])
    return tracks, out


@pytest.mark.parametrize("keep, chunk", [(1, 1), (5, 5), (7, 20), (2000, 4096), (30, 7)])
def test_history_is_a_slice_of_one_chunk(spark, keep, chunk):
    rows = points(700)
    _, want = brute(rows, keep)
    got = tg.track_history(spark.createDataFrame(rows, SCHEMA), keep, chunk).collect()
    assert len(got) == len(want)
    assert {r.ord: (r.points, [tuple(p) for p in r.path]) for r in got} == {o: (len(p), p) for o, (_, p) in want.items()}


@pytest.mark.parametrize("chunk", [1, 6, 1000])
def test_paths_and_index_say_the_same(spark, chunk):
    rows = points(500, seed=1)
    tracks, want = brute(rows, 9)
    tags = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    parts = tg.track_paths(tags, chunk).collect()
    assert all(len(p.path) <= chunk for p in parts)
    for p in sorted(parts, key=lambda p: p.first_pos):
        line = lines.setdefault((p.filename, p.track_id), [])
        assert p.first_pos == len(line) + 1
        line.extend(tuple(q) for q in p.path)
    assert lines == tracks
    for r in tg.track_path_index(tags, 9).collect():
        assert lines[r.filename, r.track_id][r.first_pos - 1 : r.last_pos] == want[r.ord][1]


def test_paths_of_no_tags(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tg.track_paths(none).count() == tg.track_path_index(none).count() == tg.track_history(none).count() == 0


def test_one_long_track_is_spread_over_tasks(spark):
    tags = spark.range(20_000).selectExpr(
        "lpad(CAST(id AS STRING), 8, '0') AS ord", "'a.mp4' AS filename", "CAST(id AS INT) AS frame_number", "'T' AS type", "'person' AS value",
        "0.5D AS confidence", "1L AS track_id", "CAST(id % 90 AS INT) AS x1", "0 AS y1", "CAST(id % 90 AS INT) + 10 AS x2", "10 AS y2")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = tg.track_history(tags, keep=50, chunk=500).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sum(r["count"] for r in sizes) == 20_000
    assert len(sizes) > 2 and max(r["count"] for r in sizes) <= 8_000


@pytest.mark.parametrize("limit", [256, 3])
def test_boxes_without_area_all_stay(spark, limit):
    flat = [(f"f{i}", "a.mp4", 1, "T", "person", 0.5, i % 2 or None, 5, 5, 5, 40) for i in range(4)]
    unknown = [("n0", "a.mp4", 1, "T", "person", 0.5, 1, None, 5, 9, 40)]
    solid = [(f"s{i}", "a.mp4", 1, "T", "person", 0.5, i, 0, 0, 100, 100) for i in range(5)]
    got = tg.nms_dedup(spark.createDataFrame(flat + unknown + solid, SCHEMA), 0.8, crowd=limit).collect()
    assert sorted(r.ord for r in got) == ["f0", "f1", "f2", "f3", "n0", "s1"]


def test_limit_that_nothing_exceeds(spark):
    tags = spark.createDataFrame(points(60), SCHEMA)
    assert tg.nms_dedup(tags, 1.0).count() == 60


def test_length_of_tags_without_a_track_is_that_of_id_0(spark):
    rows = [(f"{i}", "a.mp4", i, "T", "person", 0.5, t, 0, 0, 9, 9) for i, t in enumerate([0, 0, None, None, None, 5])]
    got = {r.ord: r.track_len for r in tg.with_track_length(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"0": 2, "1": 2, "2": 2, "3": 2, "4": 2, "5": 1}
    assert {r.track_len for r in tg.with_track_length(spark.createDataFrame(rows[2:], SCHEMA)).collect()} == {0, 1}
