"""Tracks: summaries, sessions and stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.operators import tracks as ops
from motioncat.registry import query
from motioncat.registry.common import rounded
from motioncat.registry.tags import HASH, ROW, ROW_SQL, iou_sql

PERSON = """SELECT ord, filename, frame_number, 'TRACKED_OBJECT' AS type, value, confidence, track_id, x1, y1, x2, y2 FROM tags
  WHERE value = 'person' AND confidence >= 0.3 AND track_id IS NOT NULL AND x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) >= 6000"""


@query("filter_person_tracks", with_ctes("tags", PERSON + " AND track_id % 3 <> 0"))
def filter_person_tracks(spark, sf):
    """Tracks count as tracked but for every third, so that the kind decides too."""
    kind = F.when(F.col("track_id") % 3 != 0, "TRACKED_OBJECT").otherwise("DETECTED_OBJECT")
    tracked = fx.tags(spark, sf).withColumn("type", kind)
    return ops.filter_person_tracks(tracked, 0.3, 6000).select("ord", *ROW)


@query("track_lengths", with_ctes("tags", "SELECT track_id, count(*) AS length FROM tags GROUP BY track_id"))
def track_lengths(spark, sf):
    return ops.track_lengths(fx.tags(spark, sf))


@query("track_summary", with_ctes("tags", """SELECT filename, track_id, count(*) AS crops, round(avg(confidence), 6) AS avg_confidence, min(frame_number) AS first_frame,
  max(frame_number) AS last_frame, max(frame_number) - min(frame_number) + 1 AS duration,
  arg_min(frame_number, struct_pack(c := -confidence, o := ord)) AS best_frame, max(confidence) AS best_confidence FROM tags GROUP BY 1, 2"""))
def track_summary(spark, sf):
    return rounded(ops.track_summary(fx.tags(spark, sf)), "avg_confidence")


@query("top_k_crops", with_ctes("tags", """SELECT * FROM (SELECT filename, track_id, frame_number, confidence, ord, CAST(row_number() OVER (PARTITION BY filename, track_id ORDER BY confidence DESC, ord) AS INT) AS rank FROM tags) WHERE rank <= 3"""))
def top_k_crops(spark, sf):
    return ops.top_k_crops(fx.tags(spark, sf), 3).select("filename", "track_id", "frame_number", "confidence", "ord", "rank")


TRACKS = """tk AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY filename, track_id, frame_number ORDER BY ord DESC) AS rn FROM tags) WHERE rn = 1)"""


@query("tags_to_tracks", with_ctes("tags", f"WITH {TRACKS} SELECT ord, {ROW_SQL} FROM tk"))
def tags_to_tracks(spark, sf):
    return ops.tags_to_tracks(fx.tags(spark, sf)).select("ord", *ROW)


@query("tracks_to_tags", with_ctes("tags", f"WITH {TRACKS} SELECT ord, {HASH} AS hash, {ROW_SQL} FROM tk"))
def tracks_to_tags(spark, sf):
    """Tags to tracks and back: one tag per track and frame is left."""
    return ops.tracks_to_tags(ops.tags_to_tracks(fx.tags(spark, sf))).select("ord", "hash", *ROW)


MOVES = f"""{TRACKS}, fr AS (SELECT filename, frame_number, lead(frame_number) OVER (PARTITION BY filename ORDER BY frame_number) AS next_frame
    FROM (SELECT DISTINCT filename, frame_number FROM tags)),
  seen AS (SELECT DISTINCT filename, frame_number, track_id FROM tags),
  lost AS (SELECT s.filename, s.frame_number, next_frame, s.track_id FROM seen s JOIN fr USING (filename, frame_number) WHERE next_frame IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM seen o WHERE o.filename = s.filename AND o.track_id = s.track_id AND o.frame_number = fr.next_frame)),
  new AS (SELECT fr.filename, fr.frame_number, next_frame, s.track_id FROM fr JOIN seen s ON s.filename = fr.filename AND s.frame_number = fr.next_frame
    WHERE NOT EXISTS (SELECT 1 FROM seen o WHERE o.filename = s.filename AND o.track_id = s.track_id AND o.frame_number = fr.frame_number))"""


@query("tracks_lost_new", with_ctes("tags", f"WITH {MOVES} SELECT filename, frame_number, next_frame, 'lost' AS kind, track_id FROM lost UNION ALL SELECT filename, frame_number, next_frame, 'new', track_id FROM new"))
def tracks_lost_new(spark, sf):
    return ops.lost_and_new(fx.tags(spark, sf))


VOTES = f"""{MOVES}, pr AS (SELECT l.filename, l.frame_number, l.track_id AS lost, n.track_id AS new, {iou_sql('a', 'b')} AS iou
    FROM lost l JOIN new n USING (filename, frame_number)
    JOIN tk a ON a.filename = l.filename AND a.track_id = l.track_id AND a.frame_number = l.frame_number
    JOIN tk b ON b.filename = n.filename AND b.track_id = n.track_id AND b.frame_number = n.next_frame AND a.value = b.value),
  ok AS (SELECT * FROM pr p WHERE iou > 0.5 AND NOT EXISTS (SELECT 1 FROM tk x JOIN tk y ON x.filename = y.filename AND x.frame_number = y.frame_number
    WHERE x.filename = p.filename AND x.track_id = p.lost AND y.track_id = p.new)),
  votes AS (SELECT greatest(lost, new) AS rename, least(lost, new) AS keep, count(*) AS votes, min(struct_pack(f := filename, n := frame_number)) AS first,
    min(iou) AS min_iou, max(iou) AS max_iou FROM ok GROUP BY 1, 2)"""


@query("track_merge_candidates", with_ctes("tags", f"WITH {VOTES} SELECT rename, keep, votes, first.f AS first_file, first.n AS first_frame, round(min_iou, 9) AS min_iou, round(max_iou, 9) AS max_iou FROM votes"))
def track_merge_candidates(spark, sf):
    return rounded(ops.merge_candidates(fx.tags(spark, sf), 0.5), "min_iou", "max_iou", digits=9)


@query("track_merge_apply", with_ctes("tags", f"""WITH {VOTES}, rn AS (SELECT rename AS source, arg_max(keep, struct_pack(f := first.f, n := first.n, k := keep)) AS target FROM votes WHERE votes >= 1 GROUP BY 1),
  walk AS (SELECT source, target, 0 AS depth FROM rn UNION ALL SELECT w.source, r.target, depth + 1 FROM walk w JOIN rn r ON r.source = w.target),
  fin AS (SELECT source, arg_max(target, depth) AS target FROM walk GROUP BY source)
  SELECT ord, filename, frame_number, value, coalesce(target, track_id) AS track_id FROM tags LEFT JOIN fin ON source = track_id""", recursive=True))
def track_merge_apply(spark, sf):
    return ops.merge_tracks(fx.tags(spark, sf), 0.5, 1).select("ord", "filename", "frame_number", "value", "track_id")


SESSIONS = """g AS (SELECT video_filename, frame_number, frame_number - lag(frame_number) OVER (PARTITION BY video_filename ORDER BY frame_number, ord) AS gap, ord FROM people),
  s AS (SELECT *, CAST(sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY video_filename ORDER BY frame_number, ord) AS BIGINT) AS session FROM g)"""


@query("gap_session_members", with_ctes("people", f"WITH {SESSIONS} SELECT ord, video_filename, session FROM s QUALIFY count(*) OVER (PARTITION BY video_filename, session) >= 2"))
def gap_session_members(spark, sf):
    return ops.session_members(fx.people(spark, sf), "video_filename", 2, 2).select("ord", "video_filename", "session")


@query("gap_sessions", with_ctes("people", f"""WITH {SESSIONS}
  SELECT video_filename, count(*) AS size, min(frame_number) AS first_frame, max(frame_number) AS last_frame,
    round((max(frame_number) - min(frame_number)) / CAST(30 AS DOUBLE), 6) AS span_s FROM s GROUP BY video_filename, session HAVING count(*) >= 2"""))
def gap_sessions(spark, sf):
    return rounded(ops.gap_sessions(fx.people(spark, sf), "video_filename", 2, 2), "span_s")


def tagged(spark, sf):
    """Detections seen as embeddings rows: tracks of many sizes."""
    return fx.tags(spark, sf).withColumnRenamed("filename", "video_filename")


SZ = "sz AS (SELECT filename AS video_filename, track_id, count(*) AS size FROM tags GROUP BY 1, 2)"


@query("track_structure", with_ctes("tags", f"""WITH {SZ} SELECT CAST(sum(size) AS BIGINT) AS embeddings, count(*) AS tracks, round(avg(size), 6) AS mean_size,
  median(size) AS median_size, min(size) AS min_size, max(size) AS max_size, count(DISTINCT video_filename) AS videos FROM sz"""))
def track_structure(spark, sf):
    return rounded(ops.track_structure(tagged(spark, sf)), "mean_size")


@query("track_size_histogram", with_ctes("tags", f"""WITH {SZ}, h AS (SELECT size, count(*) AS tracks FROM sz GROUP BY size), t AS (SELECT count(*) AS total FROM sz),
  f AS (SELECT unnest([1, 2, 3, 5, 10]) AS size)
  SELECT 'size' AS kind, size, tracks, round(tracks * 100 / total, 6) AS percent FROM h, t
  UNION ALL SELECT 'at_least', f.size, CAST(coalesce(sum(h.tracks), 0) AS BIGINT), round(coalesce(sum(h.tracks), 0) * 100 / max(total), 6) FROM f CROSS JOIN t LEFT JOIN h ON h.size >= f.size GROUP BY f.size"""))
def track_size_histogram(spark, sf):
    return rounded(ops.track_size_histogram(tagged(spark, sf)), "percent")


@query("video_track_stats", with_ctes("tags", f"WITH {SZ} SELECT video_filename, count(*) AS tracks, CAST(sum(size) AS BIGINT) AS embeddings, round(sum(size) / count(*), 6) AS per_track FROM sz GROUP BY 1"))
def video_track_stats(spark, sf):
    return rounded(ops.video_track_stats(tagged(spark, sf)), "per_track")


@query("cluster_by_track", with_ctes("people", """WITH g AS (SELECT video_filename, track_id, count(*) AS size, min(ord) AS first_ord, avg(confidence) AS c, avg(embedding_quality) AS q FROM people GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (ORDER BY first_ord) - 1 AS i FROM g)
  SELECT i AS cluster_id, concat(printf('track_%04d_', i), replace(video_filename, '.mp4', ''), '_', track_id) AS cluster_name, video_filename, track_id, size,
    round(c, 6) AS avg_confidence, round(q, 6) AS avg_quality FROM n"""))
def cluster_by_track(spark, sf):
    return rounded(ops.cluster_by_track(fx.people(spark, sf)), "avg_confidence", "avg_quality")
