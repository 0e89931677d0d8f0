"""Tracks: summaries, sessions, stitching of broken tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motioncat.functions.boxes import BOX, iou, named, tag_hash
from motioncat.operators.ordered import sessions
from motioncat.operators.tags import FRAME, consecutive_frames, overlap_join
from motioncat.session import forget, materialize

# ---- fixed values ----
FRAMES_PER_SECOND = 30
MIN_SIZES = [1, 2, 3, 5, 10]
TRACK = ["filename", "track_id"]


def filter_person_tracks(tags: DataFrame, min_confidence: float = 0.3, min_area: int = 1000, suffix: str | None = None) -> DataFrame:
    """Tracked persons with a usable box."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ok = (
        (F.col("value") == "person")
        & (F.col("type") == "TRACKED_OBJECT")
        & (F.col("confidence").cast("double") >= min_confidence)
        & F.col("track_id").isNotNull()
        & (w > 0)
        & (h > 0)
        & (w * h >= min_area)
    )
    return tags.filter(ok if suffix is None else ok & F.col("filename").endswith(suffix))


def track_lengths(tags: DataFrame) -> DataFrame:
    return tags.filter("track_id IS NOT NULL").groupBy("track_id").agg(F.count("*").alias("length"))


def track_summary(crops: DataFrame) -> DataFrame:
    """Per track: crops, mean confidence, frame span and the most confident crop."""
    best = F.min_by(F.struct("frame_number", "confidence"), F.struct(-F.col("confidence"), F.col("ord")))
    out = crops.groupBy(*TRACK).agg(
        F.count("*").alias("crops"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("frame_number").alias("first_frame"),
        F.max("frame_number").alias("last_frame"),
        best.alias("best"),
    )
    return out.select(
        *TRACK, "crops", "avg_confidence", "first_frame", "last_frame",
        (F.col("last_frame") - F.col("first_frame") + 1).alias("duration"),
        F.col("best.frame_number").alias("best_frame"), F.col("best.confidence").alias("best_confidence"),
    )


def top_k_crops(crops: DataFrame, k: int = 10) -> DataFrame:
    """Most confident ``k`` crops per track; the rank filter trims each task before the shuffle."""
    by_confidence = Window.partitionBy(*TRACK).orderBy(F.col("confidence").desc(), "ord")
    return crops.withColumn("rank", F.row_number().over(by_confidence)).filter(F.col("rank") <= k)


def tags_to_tracks(tags: DataFrame) -> DataFrame:
    """One row per (file, track, frame), the last tag winning; tags without a track are dropped."""
    rest = [c for c in tags.columns if c not in (*TRACK, "frame_number")]
    last = tags.filter("track_id IS NOT NULL").groupBy(*TRACK, "frame_number").agg(F.max_by(F.struct(*rest), "ord").alias("r"))
    return last.select(*TRACK, "frame_number", *[F.col(f"r.{c}").alias(c) for c in rest])


def tracks_to_tags(tracks: DataFrame) -> DataFrame:
    """The inverse: tags keyed by (file, frame, hash) with their track id."""
    rest = [c for c in tracks.columns if c not in ("filename", "frame_number", "track_id")]
    return tracks.select("filename", "frame_number", tag_hash().alias("hash"), "track_id", *rest)


def _moves(points: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of ``points`` whose track vanishes before the next, or appeared after the previous, tagged frame.

    ``points`` has one row per (file, track, frame). Neighbouring frames come from the
    table of distinct frames, so a file with very many tags is never sorted as a whole.
    """
    steps = consecutive_frames(tags)
    before = steps.select("filename", F.col("next_frame").alias("frame_number"), F.col("frame_number").alias("_from"))
    frames = steps.join(before, FRAME, "full").select(*FRAME, F.col("next_frame").alias("_to"), "_from")
    own = Window.partitionBy(*TRACK).orderBy("frame_number")
    seen = points.withColumn("_next", F.lead("frame_number").over(own)).withColumn("_prev", F.lag("frame_number").over(own))
    placed = seen.join(frames, FRAME)
    here = F.col("frame_number")
    lost = F.when(F.col("_to").isNotNull() & ~F.col("_next").eqNullSafe(F.col("_to")), F.struct(F.lit("lost").alias("kind"), here.alias("at"), F.col("_to").alias("next_frame")))
    new = F.when(F.col("_from").isNotNull() & ~F.col("_prev").eqNullSafe(F.col("_from")), F.struct(F.lit("new").alias("kind"), F.col("_from").alias("at"), here.alias("next_frame")))
    moved = placed.withColumn("_move", F.explode(F.array_compact(F.array(lost, new))))
    kept = [c for c in points.columns if c != "frame_number"]
    return moved.select(*kept, F.col("_move.kind").alias("kind"), F.col("_move.at").alias("frame_number"), F.col("_move.next_frame").alias("next_frame"))


def lost_and_new(tags: DataFrame) -> DataFrame:
    """Tracks that vanish after, or appear after, each pair of consecutive tagged frames."""
    seen = tags.filter("track_id IS NOT NULL").select(*TRACK, "frame_number").distinct()
    return _moves(seen, tags).select("filename", "frame_number", "next_frame", "kind", "track_id")


def numbered_frames(tags: DataFrame) -> DataFrame:
    """Tagged frames of each file, numbered from 0, with the tagged frames before and after."""
    along = Window.partitionBy("filename").orderBy("frame_number")
    return tags.select(*FRAME).distinct().select(
        *FRAME, (F.row_number().over(along) - 1).alias("nth"), F.lead("frame_number").over(along).alias("next_frame"), F.lag("frame_number").over(along).alias("last_frame")
    )


def frame_sets(points: DataFrame) -> DataFrame:
    """A track's tagged frames as bit sets: (file, track, chunk, frames, points) for every 64 numbered frames it is seen in.

    ``points`` has one row per (file, track, frame) with ``nth``. A chunk holds 64 points at most.
    """
    rest = [c for c in points.columns if c not in TRACK]
    bit = F.expr("shiftleft(1L, CAST(nth % 64 AS INT))")
    return points.groupBy(*TRACK, F.floor(F.col("nth") / 64).alias("chunk")).agg(F.bit_or(bit).alias("frames"), F.collect_list(F.struct(*rest)).alias("points"))


def _chunk_moves(chunks: DataFrame) -> DataFrame:
    """The points of ``chunks`` at which a track vanishes (``kind`` lost) or appears (new), as ``_moves`` finds them point by point.

    Only the chunks next to a chunk are looked up, for the frames at its edges.
    """
    edge = chunks.select(*TRACK, "chunk", (F.col("frames") < 0).alias("last"), (F.col("frames").bitwiseAND(1) != 0).alias("first"))
    before = edge.select(*TRACK, (F.col("chunk") + 1).alias("chunk"), F.col("last").alias("_before"))
    after = edge.select(*TRACK, (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("_after"))
    placed = chunks.join(before.hint("merge"), [*TRACK, "chunk"], "left").join(after.hint("merge"), [*TRACK, "chunk"], "left")
    place = "CAST(p.nth % 64 AS INT)"
    seen_next = f"if({place} = 63, coalesce(_after, false), (shiftrightunsigned(frames, {place} + 1) & 1) = 1)"
    seen_last = f"if({place} = 0, coalesce(_before, false), (shiftrightunsigned(frames, {place} - 1) & 1) = 1)"
    lost = F.expr(f"transform(filter(points, p -> p.next_frame IS NOT NULL AND NOT {seen_next}), p -> struct('lost' AS kind, p.frame_number AS at, p.next_frame AS next_frame, p AS point))")
    new = F.expr(f"transform(filter(points, p -> p.last_frame IS NOT NULL AND NOT {seen_last}), p -> struct('new' AS kind, p.last_frame AS at, p.frame_number AS next_frame, p AS point))")
    moved = placed.select(*TRACK, F.explode(F.concat(lost, new)).alias("m"))
    return moved.select(*TRACK, "m.kind", F.col("m.at").alias("frame_number"), "m.next_frame", "m.point.value", *[f"m.point.{c}" for c in BOX])


def merge_candidates(tags: DataFrame, above: float = 0.9) -> DataFrame:
    """Votes for joining a vanished and an appearing track of the same value and place.

    Pairs that share a frame anywhere in the file are left out, which is seen from the bit sets
    of their frames. Each meeting is a vote to rename the larger id to the smaller.

    Tags move once, to their frame, for both the last tag of a track and the frame's number. What is written here packs
    so well on disk that a small file may hold more rows than the driver can: these joins never broadcast.
    """
    slim = materialize(tags.select(*TRACK, "frame_number", "value", *BOX, "ord"), "slim-tags")
    frames = materialize(numbered_frames(slim), "frames")
    points = tags_to_tracks(slim.repartition(*FRAME)).drop("ord").join(frames.hint("merge"), FRAME)
    chunks = materialize(frame_sets(points), "track-chunks")
    moves = materialize(_chunk_moves(chunks), "track-moves")
    lost, new = moves.filter("kind = 'lost'"), moves.filter("kind = 'new'")
    met = overlap_join(lost, new, [*FRAME, "value"], above)
    pairs = materialize(
        met.select(
            F.col("a.filename").alias("filename"), F.col("a.frame_number").alias("frame_number"),
            F.col("a.track_id").alias("lost"), F.col("b.track_id").alias("new"), iou(named("a."), named("b.")).alias("iou"),
        ),
        "track-pairs",
    )
    one, two = (chunks.select("filename", F.col("track_id").alias(side), "chunk", F.col("frames").alias(f"{side}_frames")).hint("merge") for side in ("lost", "new"))
    both = pairs.select("filename", "lost", "new").distinct().join(one, ["filename", "lost"]).join(two, ["filename", "new", "chunk"])
    clash = both.filter(F.col("lost_frames").bitwiseAND(F.col("new_frames")) != 0).select("filename", "lost", "new").distinct()
    votes = pairs.join(clash, ["filename", "lost", "new"], "left_anti")
    first = F.struct("filename", "frame_number")
    return votes.groupBy(F.greatest("lost", "new").alias("rename"), F.least("lost", "new").alias("keep")).agg(
        F.count("*").alias("votes"), F.min(first).alias("first"), F.min("iou").alias("min_iou"), F.max("iou").alias("max_iou")
    ).select(
        "rename", "keep", "votes", F.col("first.filename").alias("first_file"), F.col("first.frame_number").alias("first_frame"),
        "min_iou", "max_iou",
    )


def collapse_renames(renames: DataFrame) -> DataFrame:
    """Follow (source, target) chains to their end; targets are smaller ids, so chains end.

    Each round points a source at its target's target, so a chain of length n takes about
    log2(n) rounds.
    """
    current = materialize(renames.select("source", "target"), "renames")
    while True:
        onward = current.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        jumped = materialize(
            current.join(onward, "target", "left").select("source", F.coalesce("_next", "target").alias("target"), F.col("_next").isNotNull().alias("moved")),
            "renames",
        )
        forget(current)
        if jumped.filter("moved").isEmpty():
            return jumped.select("source", "target")
        current = jumped


def merge_tracks(tags: DataFrame, above: float = 0.9, min_votes: int = 10) -> DataFrame:
    """Rewrite track ids by the votes; per source the pairing first seen last wins."""
    votes = merge_candidates(tags, above).filter(F.col("votes") >= min_votes)
    latest = F.struct("first_file", "first_frame", "keep")
    renames = votes.groupBy(F.col("rename").alias("source")).agg(F.max_by("keep", latest).alias("target"))
    final = collapse_renames(renames).select(F.col("source").alias("track_id"), "target")
    out = tags.join(final, "track_id", "left")
    return out.withColumn("track_id", F.coalesce("target", "track_id")).drop("target").select(*tags.columns)


def frame_sessions(rows: DataFrame, video: str, max_gap_frames: int) -> DataFrame:
    """(video, frame_number, n, session): runs of frames of one video without a gap above ``max_gap_frames``.

    Rows are first counted per frame; a video of any length spans many partitions.
    """
    frames = rows.groupBy(video, "frame_number").agg(F.count("*").alias("n"))
    return sessions(frames, [video], "frame_number", max_gap_frames)


def gap_sessions(rows: DataFrame, video: str, max_gap_frames: int, min_size: int = 1) -> DataFrame:
    """Size and span of each session of at least ``min_size`` rows."""
    return _session_sizes(frame_sessions(rows, video, max_gap_frames), video, min_size).drop("session")


def _session_sizes(frames: DataFrame, video: str, min_size: int) -> DataFrame:
    out = frames.groupBy(video, "session").agg(
        F.sum("n").alias("size"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame")
    )
    span = (F.col("last_frame") - F.col("first_frame")) / F.lit(float(FRAMES_PER_SECOND))
    return out.filter(F.col("size") >= min_size).select(video, "session", "size", "first_frame", "last_frame", span.alias("span_s"))


def session_members(rows: DataFrame, video: str, max_gap_frames: int, min_size: int = 1) -> DataFrame:
    """``rows`` of sessions with at least ``min_size`` rows, with the ``session`` number within their video."""
    frames = materialize(frame_sessions(rows, video, max_gap_frames), "frame-sessions")
    large = _session_sizes(frames, video, min_size).select(video, "session")
    place = F.struct(video, "frame_number").alias("_place")  # also equal where the video is null
    kept = frames.withColumn("_run", F.struct(video, "session")).join(large.select(F.struct(video, "session").alias("_run")), "_run", "left_semi")
    return rows.withColumn("_place", place).join(kept.select(place, "session"), "_place").drop("_place")


# ---- structure of tracks over embeddings ----
VIDEO_TRACK = ["video_filename", "track_id"]


def _sizes(people: DataFrame) -> DataFrame:
    return people.groupBy(*VIDEO_TRACK).agg(F.count("*").alias("size"))


def _histogram(people: DataFrame) -> DataFrame:
    return _sizes(people).groupBy("size").agg(F.count("*").alias("tracks"))


def track_structure(people: DataFrame) -> DataFrame:
    """Totals and exact median of embeddings per track, from the histogram of sizes."""
    hist = _histogram(people)
    total = F.sum(F.col("size") * F.col("tracks"))
    stats = hist.agg(
        total.alias("embeddings"), F.sum("tracks").alias("tracks"), (total / F.sum("tracks")).alias("mean_size"),
        F.percentile("size", 0.5, F.col("tracks")).alias("median_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
    )
    videos = people.select("video_filename").distinct().agg(F.count("*").alias("videos"))
    return stats.withColumn("_one", F.lit(1)).join(videos.withColumn("_one", F.lit(1)), "_one").drop("_one")


def track_size_histogram(people: DataFrame) -> DataFrame:
    """Tracks per size with their share, and tracks of at least each size in ``MIN_SIZES``."""
    hist = materialize(_histogram(people), "sizes")
    total = hist.agg(F.sum("tracks").alias("total"))
    exact = hist.select(F.lit("size").alias("kind"), "size", "tracks")
    floors = hist.select(F.explode(F.array(*[F.lit(s).cast("bigint") for s in MIN_SIZES])).alias("floor"), "size", "tracks")
    enough = floors.groupBy(F.col("floor").alias("size")).agg(
        F.coalesce(F.sum(F.when(F.col("size") >= F.col("floor"), F.col("tracks"))), F.lit(0)).alias("tracks")
    ).select(F.lit("at_least").alias("kind"), "size", "tracks")
    both = exact.unionByName(enough).withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    return both.select("kind", "size", "tracks", (F.col("tracks") * 100 / F.col("total")).alias("percent"))


def video_track_stats(people: DataFrame) -> DataFrame:
    per_video = _sizes(people).groupBy("video_filename").agg(F.count("*").alias("tracks"), F.sum("size").alias("embeddings"))
    return per_video.withColumn("per_track", F.col("embeddings") / F.col("tracks"))


def cluster_by_track(people: DataFrame, min_size: int = 1) -> DataFrame:
    """One cluster per (video, track); ids follow first appearance among clusters kept."""
    from motioncat.operators.ordered import running

    groups = people.groupBy(*VIDEO_TRACK).agg(
        F.count("*").alias("size"), F.min("ord").alias("first_ord"), F.avg("confidence").alias("avg_confidence"),
        F.avg("embedding_quality").alias("avg_quality"),
    ).filter(F.col("size") >= min_size)
    # one running count over all clusters: spread by ranges of first appearance, not by key
    numbered = running(groups.withColumn("_all", F.lit(0)), ["_all"], ["first_ord"], {"n": F.lit(1)}).drop("_all")
    base = F.regexp_replace("video_filename", r"\.mp4", "")
    name = F.concat(F.format_string("track_%04d_", F.col("n") - 1), base, F.lit("_"), F.col("track_id"))
    return numbered.select((F.col("n") - 1).alias("cluster_id"), name.alias("cluster_name"), *VIDEO_TRACK, "size", "avg_confidence", "avg_quality")
