"""Overlap removal, stitching, sessions and running values against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from motioncat.operators import tags as tg
from motioncat.operators import tracks as tr
from motioncat.operators.ordered import running

TAG_SCHEMA = "ord string, filename string, frame_number int, type string, value string, confidence double, track_id long, x1 int, y1 int, x2 int, y2 int"


def iou(a, b):
    w, h = min(a[9], b[9]) - max(a[7], b[7]), min(a[10], b[10]) - max(a[8], b[8])
    if w < 0 or h < 0:
        return 0.0
    area = lambda r: (r[9] - r[7]) * (r[10] - r[8])
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0.0


def crowd(seed, n=900):
    """One frame holds a third of all boxes, many of them equal or nearly so."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        x, y = rng.choice([0, 300, 620]) + rng.randrange(12), rng.choice([0, 250]) + rng.randrange(12)
        rows.append((f"{i:05d}", "hot.mp4" if hot else f"f{i % 7}.mp4", 5 if hot else rng.randrange(6) * 5, "TRACKED_OBJECT",
                     rng.choice(["person", "car"]), rng.random(), rng.choice([None, *range(1, 30)]), x, y, x + 60 + rng.randrange(10), y + 90))
    return rows


def brute_nms(rows, above):
    lengths = {}
    for r in rows:
        if r[6] is not None:
            lengths[r[6]] = lengths.get(r[6], 0) + 1
    length = lambda r: lengths.get(r[6] if r[6] is not None else 0, 0)
    groups, kept = {}, set()
    for r in sorted(rows):
        groups.setdefault((r[1], r[2], r[4]), []).append(r)
    for left in groups.values():
        while left:
            anchor = left.pop(0)
            same = [r for r in left if iou(anchor, r) > above]
            left = [r for r in left if not iou(anchor, r) > above]
            best = anchor
            for r in same:
                if length(r) > length(best):
                    best = r
            kept.add(best[0])
    return kept


@pytest.mark.parametrize("above, limit", [(0.8, 256), (0.8, 3), (0.5, 5)])
def test_nms(spark, above, limit):
    rows = crowd(1)
    tags = spark.createDataFrame(rows, TAG_SCHEMA)
    assert {r.ord for r in tg.nms_dedup(tags, above, crowd=limit).collect()} == brute_nms(rows, above)


def test_nms_without_tracks_keeps_all(spark):
    tags = spark.createDataFrame(crowd(2, 60), TAG_SCHEMA).withColumn("track_id", F.lit(None).cast("long"))
    assert tg.nms_dedup(tags).count() == 60


def test_overlap_join_meets_each_pair_once(spark):
    rows = crowd(3, 240)
    tags = spark.createDataFrame(rows, TAG_SCHEMA)
    found = tg.overlap_join(tags, tags, ["value"], 0.1, cell=50).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b")).collect()
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[4] == q[4] and iou(p, q) > 0.1)
    assert sorted((r.a, r.b) for r in found) == want


def tag(ord_, frame, track, x, file="f.mp4", value="person"):
    return (ord_, file, frame, "TRACKED_OBJECT", value, 0.9, track, x, 0, x + 100, 100)


def test_broken_track_is_stitched_through_a_chain(spark):
    """Track 3 ends where 7 starts, 7 ends where 12 starts: all become 3; 20 shares frames and stays."""
    rows = [tag(f"a{f}", f, 3, 0) for f in (0, 5, 10)] + [tag(f"b{f}", f, 7, 1) for f in (15, 20)] + [tag(f"c{f}", f, 12, 2) for f in (25, 30)]
    rows += [tag(f"d{f}", f, 20, 500) for f in (0, 5, 10, 15, 20, 25, 30)] + [tag(f"e{f}", f, 30, 0, value="car") for f in (15,)]
    tags = spark.createDataFrame(rows, TAG_SCHEMA)
    votes = {(r.rename, r["keep"]): (r.votes, r.first_frame) for r in tr.merge_candidates(tags, 0.9).collect()}
    assert votes == {(7, 3): (1, 10), (12, 7): (1, 20)}
    merged = tr.merge_tracks(tags, 0.9, 1)
    assert {r.track_id for r in merged.collect()} == {3, 20, 30}
    assert {r.track_id for r in tr.merge_tracks(tags, 0.9, 10).collect()} == {3, 7, 12, 20, 30}


def test_tracks_sharing_a_frame_are_not_merged(spark):
    rows = [tag("a0", 0, 1, 0), tag("a1", 5, 1, 0), tag("b0", 10, 2, 0), tag("x0", 20, 1, 300), tag("x1", 20, 2, 300), tag("z", 15, 9, 0)]
    pairs = {(r.rename, r["keep"]) for r in tr.merge_candidates(spark.createDataFrame(rows, TAG_SCHEMA), 0.9).collect()}
    assert (2, 1) not in pairs


def test_collapse_long_chain(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 70)], "source long, target long")
    assert {r.target for r in tr.collapse_renames(chain).collect()} == {0}


def test_last_tag_wins_per_track_and_frame(spark):
    tags = spark.createDataFrame([tag("a", 0, 1, 0), tag("b", 0, 1, 50), tag("c", 5, None, 0)], TAG_SCHEMA)
    got = tr.tags_to_tracks(tags).collect()
    assert [(r.ord, r.x1) for r in got] == [("b", 50)]


def test_merge_sides(spark):
    one = spark.createDataFrame([tag("a", 0, 1, 0), tag("b", 5, 1, 0)], TAG_SCHEMA)
    two = one.filter("ord = 'a'").withColumn("confidence", F.lit(0.1)).union(spark.createDataFrame([tag("n", 9, 2, 0)], TAG_SCHEMA))
    right = {r.ord: r.confidence for r in tg.merge_tags(one, two).collect()}
    assert right == {"a": 0.1, "b": 0.9, "n": 0.9}
    left = {r.ord: (r.confidence, r.added) for r in tg.merge_new_tags(one, two).collect()}
    assert left == {"a": (0.9, False), "b": (0.9, False), "n": (0.9, True)}
    clips = spark.createDataFrame([("f.mp4",)], "filename string")
    assert tg.attach_tags(one, two, clips, "replace").count() == 2
    assert tg.attach_tags(one, two, clips).count() == 3
    with pytest.raises(ValueError):
        tg.attach_tags(one, two, clips, "SWAP")


def test_sessions_split_only_above_the_gap(spark):
    rows = [("v", f) for f in (0, 60, 60, 121, 122)]
    got = tr.gap_sessions(spark.createDataFrame(rows, "v string, frame_number int"), "v", 60).orderBy("first_frame").collect()
    assert [(r["size"], r.first_frame, r.last_frame) for r in got] == [(3, 0, 60), (2, 121, 122)]


def test_running_over_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, id, -1) AS k", "id AS o", "id % 5 AS v")
    got = {(r.k, r.o): r.s for r in running(rows, ["k"], ["o"], {"s": F.col("v")}).collect()}
    total = 0
    for i in range(3000):
        if i % 3:
            total += i % 5
            assert got[(-1, i)] == total
        else:
            assert got[(i, i)] == i % 5
    assert len(got) == 3000


@pytest.fixture(scope="module")
def long_tracks(spark):
    """Tracks over 400 tagged frames of two files, in runs of many lengths, so that runs cross the borders of bit sets."""
    rng, rows = random.Random(8), []
    for file in ("f.mp4", "g.mp4"):
        for track in range(12):
            frame = rng.randrange(40)
            while frame < 400:
                for f in range(frame, min(400, frame + rng.choice([1, 2, 30, 64, 130]))):
                    rows.append(tag(f"{track}-{f}", f * 5 + f // 100, track, 10 * track + f // 50, file))
                    frame = f
                frame += rng.choice([2, 3, 65, 128])
    return spark.createDataFrame(rows, TAG_SCHEMA)


def test_moves_from_bit_sets_are_moves_by_point(long_tracks):
    points = tr.tags_to_tracks(long_tracks).select(*tr.TRACK, "frame_number", "value", "x1", "y1", "x2", "y2")
    chunks = tr.frame_sets(points.join(tr.numbered_frames(long_tracks), tr.FRAME))
    assert chunks.selectExpr("max(size(points)) AS n").first().n == 64 and chunks.filter("frames < 0").count() > 0
    columns = ["filename", "track_id", "kind", "frame_number", "next_frame", "value", "x1", "y1", "x2", "y2"]
    want = tr._moves(points, long_tracks).select(*columns).collect()
    assert sorted(map(tuple, tr._chunk_moves(chunks).select(*columns).collect())) == sorted(map(tuple, want))


def test_votes_leave_out_tracks_that_share_a_frame(long_tracks):
    rows = [r.asDict() for r in long_tracks.collect()]
    held = {(r["filename"], r["track_id"], r["frame_number"]): r for r in rows}
    frames = {f: sorted({r["frame_number"] for r in rows if r["filename"] == f}) for f in ("f.mp4", "g.mp4")}
    votes = {}
    for (file, a, at), left in held.items():
        place = frames[file].index(at) + 1
        if place == len(frames[file]) or (file, a, frames[file][place]) in held:
            continue
        for b in range(12):
            right = held.get((file, b, frames[file][place]))
            if right is None or (file, b, at) in held:
                continue
            overlap = max(0, min(left["x2"], right["x2"]) - max(left["x1"], right["x1"])) * 100
            if overlap / (20000 - overlap) > 0.5 and not any((file, b, f) in held for f in frames[file] if (file, a, f) in held):
                votes[max(a, b), min(a, b)] = votes.get((max(a, b), min(a, b)), 0) + 1
    got = {(r.rename, r["keep"]): r.votes for r in tr.merge_candidates(long_tracks, 0.5).collect()}
    assert got == votes


def test_sessions_of_one_long_video(spark):
    """One video holds nearly all frames and spans every partition; gaps fall anywhere."""
    rng = random.Random(5)
    frames = sorted(rng.sample(range(60_000), 20_000))
    rows = [("long", f) for f in frames] + [("long", frames[0])] * 500 + [("short", 3), ("short", 90), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "v string, frame_number int").repartition(6)
    want, session = {}, 0
    for a, b in zip(frames, frames[1:]):
        want[a] = session
        session += b - a > 7
    want[frames[-1]] = session
    got = tr.frame_sessions(df, "v", 7)
    held = {r.frame_number: (r.session, r.n) for r in got.filter("v = 'long'").collect()}
    assert {f: s for f, (s, _) in held.items()} == want and held[frames[0]][1] == 501
    assert {(r.v, r.frame_number, r.session) for r in got.filter("v IS NULL OR v = 'short'").collect()} == {("short", 3, 0), ("short", 90, 1), (None, 1, 0), (None, 2, 0)}
    assert tr.session_members(df, "v", 7, 2).filter("v IS NULL").count() == 2
    members = tr.session_members(df, "v", 7, 3).collect()
    sizes = {}
    for f in frames + [frames[0]] * 500:
        sizes[want[f]] = sizes.get(want[f], 0) + 1
    assert len(members) == sum(n for n in sizes.values() if n >= 3) and {r.session for r in members} == {s for s, n in sizes.items() if n >= 3}
