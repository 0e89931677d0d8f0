"""Tags: filters, merges, statistics, overlap removal, boxes and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.functions import boxes as B
from motioncat.operators import tags as ops
from motioncat.registry import query
from motioncat.registry.common import clipd, rounded
from motioncat.session import scratch_path
from motioncat.sources import tag_store as store

HASH = "md5(concat_ws('|', filename, frame_number, value, x1, x2, y1, y2))"
ROW = ["filename", "frame_number", "type", "value", "confidence", "track_id", "x1", "y1", "x2", "y2"]
ROW_SQL = ", ".join(ROW)


def sides_by_part(spark, sf):
    """Two overlapping halves that together hold every tag."""
    tags = fx.tags(spark, sf)
    part = F.substring("ord", -1, 1).cast("int")
    left = tags.filter(part <= 6)
    return left, tags.filter(part >= 5).withColumn("confidence", F.col("confidence") + 0.01)


SIDES = f"""l AS (SELECT *, {HASH} AS hash FROM tags WHERE CAST(right(ord, 1) AS INT) <= 6),
  r AS (SELECT * REPLACE (confidence + CAST(0.01 AS DOUBLE) AS confidence), {HASH} AS hash FROM tags WHERE CAST(right(ord, 1) AS INT) >= 5),
  b AS (SELECT 0 AS side, * FROM l UNION ALL SELECT 1 AS side, * FROM r)"""


@query("filter_tag_values", with_ctes("tags", f"SELECT {ROW_SQL} FROM tags WHERE value IN ('person', 'dog')"))
def filter_tag_values(spark, sf):
    return ops.filter_tag_values(fx.tags(spark, sf), ["person", "dog"]).select(*ROW)


@query("tag_stats", with_ctes("tags", """SELECT count(*) AS num_tags, (SELECT count(*) FROM (SELECT DISTINCT filename, frame_number FROM tags)) AS num_tagged_frames,
  count(DISTINCT filename) AS num_tagged_videos FROM tags"""))
def tag_stats(spark, sf):
    return ops.tag_stats(fx.tags(spark, sf))


@query("merge_tags", with_ctes("tags", f"WITH {SIDES} SELECT hash, {ROW_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY filename, frame_number, hash ORDER BY side DESC, ord DESC) AS rn FROM b) WHERE rn = 1"))
def merge_tags(spark, sf):
    return ops.merge_tags(*sides_by_part(spark, sf)).select("hash", *ROW)


@query("merge_new_tags", with_ctes("tags", f"""WITH {SIDES}, w AS (SELECT *, row_number() OVER (PARTITION BY filename, frame_number, hash ORDER BY side, ord) AS rn FROM b)
  SELECT filename, count(*) AS tags_after, count(*) FILTER (WHERE side = 1) AS tags_added, round(sum(confidence), 6) AS sum_confidence FROM w WHERE rn = 1 GROUP BY filename"""))
def merge_new_tags(spark, sf):
    merged = ops.merge_new_tags(*sides_by_part(spark, sf))
    out = merged.groupBy("filename").agg(
        F.count("*").alias("tags_after"), F.sum(F.col("added").cast("bigint")).alias("tags_added"), F.sum("confidence").alias("sum_confidence")
    )
    return rounded(out, "sum_confidence")


def tag_clips(spark, sf):
    """Catalog for tags: one clip per supplier with a positive balance."""
    return fx.table(spark, sf, "supplier").filter("s_acctbal > 0").selectExpr("concat('V', s_suppkey) AS filename", "s_acctbal AS duration_s")


CAT = "cat AS (SELECT concat('V', s_suppkey) AS filename, s_acctbal AS duration_s FROM supplier WHERE s_acctbal > 0)"
ATTACH = f"""WITH {SIDES}, {CAT}, m AS (SELECT * FROM b WHERE side = 1 AND filename IN (SELECT filename FROM cat)),
  k AS (SELECT * FROM b WHERE side = 0{{extra}}), u AS (SELECT * FROM k UNION ALL SELECT * FROM m)
  SELECT hash, {ROW_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY filename, frame_number, hash ORDER BY side, ord) AS rn FROM u) WHERE rn = 1"""


@query("attach_tags_add", with_ctes("tags", ATTACH.format(extra="")))
def attach_tags_add(spark, sf):
    return ops.attach_tags(*sides_by_part(spark, sf), tag_clips(spark, sf), "ADD").select("hash", *ROW)


@query("attach_tags_replace", with_ctes("tags", ATTACH.format(extra=" AND filename NOT IN (SELECT filename FROM m)")))
def attach_tags_replace(spark, sf):
    return ops.attach_tags(*sides_by_part(spark, sf), tag_clips(spark, sf), "REPLACE").select("hash", *ROW)


def stores(spark, sf):
    """The two sides as stores: written once, then merged without moving a row."""
    buckets = store.buckets_for(fx.tags(spark, sf).count())
    return [store.write_store(side, scratch_path(spark, "tags"), buckets) for side in sides_by_part(spark, sf)]


def named_hash(merged):
    return merged.withColumn("hash", F.lower(F.hex("hash"))).select("hash", *ROW)


STORED = f"""{SIDES}, s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY side, filename, frame_number, hash ORDER BY ord DESC) AS rn FROM b) WHERE rn = 1)"""


@query("tag_store_merge", with_ctes("tags", f"WITH {STORED} SELECT hash, {ROW_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY filename, frame_number, hash ORDER BY side DESC) AS rn FROM s) WHERE rn = 1"))
def tag_store_merge(spark, sf):
    return named_hash(store.merge_stores(stores(spark, sf)))


@query("tag_store_merge_new", with_ctes("tags", f"""WITH {STORED} SELECT hash, {ROW_SQL}, side = 1 AS added
  FROM (SELECT *, row_number() OVER (PARTITION BY filename, frame_number, hash ORDER BY side) AS rn FROM s) WHERE rn = 1"""))
def tag_store_merge_new(spark, sf):
    merged = store.merge_stores(stores(spark, sf), later_wins=False)
    return merged.select(F.lower(F.hex("hash")).alias("hash"), *ROW, (F.col("side") == 1).alias("added"))


STORE_ATTACH = f"""WITH {STORED}, {CAT}, m AS (SELECT * FROM s WHERE side = 1 AND filename IN (SELECT filename FROM cat)),
  k AS (SELECT * FROM s WHERE side = 0 AND filename NOT IN (SELECT filename FROM m)) SELECT hash, {ROW_SQL} FROM (SELECT * FROM k UNION ALL SELECT * FROM m)"""


@query("tag_store_replace", with_ctes("tags", STORE_ATTACH))
def tag_store_replace(spark, sf):
    return named_hash(store.attach_store(*stores(spark, sf), tag_clips(spark, sf), "REPLACE"))


@query("collect_clip_tags", with_ctes("tags", f"WITH {CAT} SELECT {ROW_SQL} FROM tags WHERE filename IN (SELECT filename FROM cat)"))
def collect_clip_tags(spark, sf):
    return ops.collect_clip_tags(fx.tags(spark, sf), tag_clips(spark, sf)).select(*ROW)


@query("clear_tags", with_ctes("tags", f"WITH {CAT} SELECT {ROW_SQL} FROM tags WHERE filename NOT IN (SELECT filename FROM cat)"))
def clear_tags(spark, sf):
    return ops.clear_tags(fx.tags(spark, sf), tag_clips(spark, sf)).select(*ROW)


@query("join_tags_clips", with_ctes("tags", f"WITH {CAT} SELECT filename, duration_s, value, confidence, frame_number FROM tags JOIN cat USING (filename)"))
def join_tags_clips(spark, sf):
    return ops.join_tags_clips(fx.tags(spark, sf), tag_clips(spark, sf)).select("filename", "duration_s", "value", "confidence", "frame_number")


def iou_sql(a: str, b: str) -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {w} * {h})"
    return f"(CASE WHEN {w} < 0 OR {h} < 0 OR {union} <= 0 THEN CAST(0 AS DOUBLE) ELSE CAST({w} * {h} AS DOUBLE) / {union} END)"


NMS_SQL = f"""tl AS (SELECT track_id, count(*) AS n FROM tags GROUP BY track_id),
  it AS (SELECT filename, frame_number, value, list([struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, len := n, best := ord)] ORDER BY ord) AS items
    FROM tags JOIN tl USING (track_id) GROUP BY ALL),
  fold AS (SELECT filename, frame_number, value, list_reduce(items, lambda acc, x:
    CASE WHEN list_contains(list_transform(acc, lambda l: {iou_sql('l', 'x[1]')} > {{thr}}), true)
    THEN list_transform(acc, lambda l, i: CASE WHEN i = list_position(list_transform(acc, lambda m: {iou_sql('m', 'x[1]')} > {{thr}}), true) AND x[1].len > l.len
      THEN struct_pack(x1 := l.x1, y1 := l.y1, x2 := l.x2, y2 := l.y2, len := x[1].len, best := x[1].best) ELSE l END)
    ELSE list_concat(acc, x) END) AS kept FROM it),
  win AS (SELECT unnest(kept).best AS ord FROM fold)"""


@query("nms_dedup_tags", with_ctes("tags", f"WITH {NMS_SQL.format(thr=0.8)} SELECT ord, {ROW_SQL} FROM tags WHERE ord IN (SELECT ord FROM win)"))
def nms_dedup_tags(spark, sf):
    return ops.nms_dedup(fx.tags(spark, sf), 0.8).select("ord", *ROW)


@query("nms_dedup_crowded", with_ctes("tags", f"WITH {NMS_SQL.format(thr=0.5)} SELECT ord, {ROW_SQL} FROM tags WHERE ord IN (SELECT ord FROM win)"))
def nms_dedup_crowded(spark, sf):
    """A low crowd limit sends the fuller frames through the join rounds."""
    return ops.nms_dedup(fx.tags(spark, sf), 0.5, crowd=6).select("ord", *ROW)


@query("nms_detection_mode", with_ctes("tags", "SELECT ord, filename, frame_number, value FROM tags"))
def nms_detection_mode(spark, sf):
    """Without any track id nothing is removed."""
    bare = fx.tags(spark, sf).withColumn("track_id", F.lit(None).cast("bigint"))
    return ops.nms_dedup(bare).select("ord", "filename", "frame_number", "value")


@query("first_seen_track", with_ctes("tags", "SELECT ord, filename, track_id, frame_number, frame_number = min(frame_number) OVER (PARTITION BY filename, track_id) AS is_new_track FROM tags"))
def first_seen_track(spark, sf):
    return ops.first_seen(fx.tags(spark, sf)).select("ord", "filename", "track_id", "frame_number", "is_new_track")


@query("consecutive_frames", with_ctes("tags", """SELECT * FROM (SELECT filename, frame_number, lead(frame_number) OVER (PARTITION BY filename ORDER BY frame_number) AS next_frame
  FROM (SELECT DISTINCT filename, frame_number FROM tags)) WHERE next_frame IS NOT NULL"""))
def consecutive_frames(spark, sf):
    return ops.consecutive_frames(fx.tags(spark, sf))


@query("track_history", with_ctes("tags", """SELECT filename, track_id, frame_number, ord, CAST(least(row_number() OVER w, 5) AS INT) AS points,
  array_to_string(list((((x1 + x2) // 2)::VARCHAR) || ':' || (((y1 + y2) // 2)::VARCHAR)) OVER (PARTITION BY filename, track_id ORDER BY frame_number, ord ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' ') AS path
  FROM tags WINDOW w AS (PARTITION BY filename, track_id ORDER BY frame_number, ord)"""))
def track_history(spark, sf):
    text = F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["x"], p["y"])), " ")
    return ops.track_history(fx.tags(spark, sf), keep=5).withColumn("path", text)


NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY filename, track_id ORDER BY frame_number, ord) AS pos FROM tags)"


@query("track_paths", with_ctes("tags", f"""WITH {NUMBERED} SELECT filename, track_id, min(pos) AS first_pos,
  string_agg(((x1 + x2) // 2) || ':' || ((y1 + y2) // 2), ' ' ORDER BY pos) AS path FROM n GROUP BY filename, track_id, (pos - 1) // 4"""))
def track_paths(spark, sf):
    text = F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["x"], p["y"])), " ")
    return ops.track_paths(fx.tags(spark, sf), chunk=4).withColumn("path", text)


@query("track_path_index", with_ctes("tags", f"WITH {NUMBERED} SELECT filename, track_id, frame_number, ord, greatest(pos - 4, 1) AS first_pos, pos AS last_pos FROM n"))
def track_path_index(spark, sf):
    return ops.track_path_index(fx.tags(spark, sf), keep=5)


@query("tag_hash", with_ctes("tags", f"SELECT ord, {HASH} AS hash FROM tags"))
def tag_hash(spark, sf):
    return fx.tags(spark, sf).select("ord", B.tag_hash().alias("hash"))


@query("global_track_id", with_ctes("tags", "SELECT DISTINCT filename, value, track_id, md5(concat_ws('|', 'run-1', filename, value, track_id)) AS global_id FROM tags"))
def global_track_id(spark, sf):
    return fx.tags(spark, sf).select("filename", "value", "track_id", B.global_track_id("run-1").alias("global_id")).distinct()


@query("iou", with_ctes("tags", f"""WITH o AS (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY filename, frame_number, value ORDER BY ord) = 1)
  SELECT n.ord, round({iou_sql('n', 'o')}, 9) AS iou FROM tags n JOIN o USING (filename, frame_number, value)"""))
def iou(spark, sf):
    """Overlap of every tag with the first one of its frame and value."""
    tags = fx.tags(spark, sf)
    first = tags.groupBy(*ops.GROUP).agg(F.min_by(F.struct(*B.BOX), "ord").alias("o"))
    paired = tags.join(first, ops.GROUP)
    return paired.select("ord", F.round(B.iou({c: F.col(c) for c in B.BOX}, B.of_struct(F.col("o"))), 9).alias("iou"))


@query("bbox_geometry", with_ctes("tags", "SELECT ord, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) // 2 AS center_x, (y1 + y2) // 2 AS center_y FROM tags"))
def bbox_geometry(spark, sf):
    return fx.tags(spark, sf).select("ord", *[c.alias(n) for n, c in B.geometry().items()])


# ---- crop names, from the embeddings ----
IDENT = "CASE WHEN ord % 11 = 0 THEN concat('det_', frame_number, '_7_', track_id) ELSE track_id END"
NAME_SQL = f"""concat(regexp_replace(video_filename, '\\.[^.]*$', ''), printf('_frame-%06d_', frame_number),
  CASE WHEN ord % 11 = 0 THEN concat('detect-', frame_number, '_7_', track_id) ELSE concat('track-', track_id) END, '.jpg')"""


def crop_names(spark, sf):
    return fx.people(spark, sf).withColumn("ident", F.expr(IDENT)).withColumn(
        "crop", B.crop_name(F.col("video_filename"), F.col("frame_number"), F.col("ident"))
    )


@query("crop_name", with_ctes("people", f"SELECT ord, {NAME_SQL} AS crop FROM people"))
def crop_name(spark, sf):
    return crop_names(spark, sf).select("ord", "crop")


@query("parse_crop_name", with_ctes("people", """SELECT ord, regexp_replace(video_filename, '\\.[^.]*$', '') AS video, frame_number,
  CASE WHEN ord % 11 = 0 THEN 'detect' ELSE 'track' END AS kind, CASE WHEN ord % 11 = 0 THEN concat(frame_number, '_7_', track_id) ELSE track_id END AS ident,
  CAST(track_id AS BIGINT) AS track_number FROM people"""))
def parse_crop_name(spark, sf):
    return crop_names(spark, sf).select("ord", *[c.alias(n) for n, c in B.parse_crop_name(F.col("crop")).items()])


@query("embedding_id", with_ctes("people", "SELECT ord, concat_ws('_', video_filename, frame_number, track_id) AS embedding_id FROM people"))
def embedding_id(spark, sf):
    return fx.people(spark, sf).select("ord", F.concat_ws("_", "video_filename", "frame_number", "track_id").alias("embedding_id"))


MORE = "SELECT * REPLACE (confidence + CAST({more} AS DOUBLE) AS confidence), {side} AS side FROM tags WHERE track_id % {step} = 0"
DATABASE = f"""WITH b AS ({MORE.format(more=0, side=0, step=1)} UNION ALL {MORE.format(more=0.25, side=1, step=2)} UNION ALL {MORE.format(more=0.5, side=2, step=3)}),
  merged AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY filename, frame_number, {HASH} ORDER BY side DESC, ord DESC) AS rn FROM b) WHERE rn = 1),
  {NMS_SQL.format(thr=0.8).replace('tags', 'merged')}, {CAT} SELECT ord, {ROW_SQL} FROM merged WHERE ord IN (SELECT ord FROM win) AND filename IN (SELECT filename FROM cat)"""


@query("tag_database", with_ctes("tags", DATABASE))
def tag_database(spark, sf):
    """Three tag files, each with some of the earlier one's tags at another confidence."""
    tags = fx.tags(spark, sf)
    sides = [tags.filter(F.col("track_id") % step == 0).withColumn("confidence", F.col("confidence") + more) for step, more in ((1, 0.0), (2, 0.25), (3, 0.5))]
    return ops.tag_database(sides, tag_clips(spark, sf)).select("ord", *ROW)
