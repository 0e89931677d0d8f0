"""Selectors, devices, catalog rows and scalar functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.functions import clips as C
from motioncat.operators import catalog as ops
from motioncat.operators import devices as dev
from motioncat.operators import rollup
from motioncat.plans.run import Analysis, run_analysis, run_stories
from motioncat.plans.selectors import Selector, select_clips, with_names
from motioncat.plans.story import Story, filter_occupancy
from motioncat.registry import query
from motioncat.registry.common import clipd, rounded, sql_wide
from motioncat.session import scratch_path
from motioncat.sources import catalog as src
from motioncat.sources.documents import write_tags_json

KEPT = ["load_seq", "filename", "device", "dt", "duration_s"]
SQL_KEPT = "SELECT load_seq, filename, device, dt, duration_s FROM clipd"
SQL_DEDUP = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY filename, dt ORDER BY load_seq) AS rn
  FROM {src}) WHERE rn = 1"""


def selector_query(name: str, selector: Selector, where: str) -> None:
    @query(name, with_ctes("clipd", f"{SQL_KEPT} WHERE {where}"))
    def run(spark, sf):
        return select_clips(clipd(spark, sf), selector).select(*KEPT)


D = "strftime(dt, '%Y-%m-%d')"
T = "(hour(dt) * 3600 + minute(dt) * 60 + second(dt))"
selector_query("filter_devices", Selector(devices=["Backyard", "Front Door"]), "device IN ('Backyard', 'Front Door')")
selector_query("filter_weekdays", Selector(weekdays=["Saturday", "SUNDAY", "someday"]), "lower(dayname(dt)) IN ('saturday', 'sunday')")
selector_query("filter_date_range", Selector(date_range=("2024-01-05", "2024-01-14")), "CAST(dt AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-14'")
selector_query("filter_date_regex", Selector(date_regex="2024-01-0[1-3]|.*-2[0-9]"), f"regexp_matches({D}, '^(?:^2024-01-0[1-3]|.*-2[0-9]$)')")
selector_query("filter_time_range", Selector(time_range=("22:30:00", "05:15:00")), f"({T} >= 81000 OR {T} <= 18900)")
selector_query("filter_duration_range", Selector(duration_range=(10, 60.5)), "duration_s BETWEEN 10 AND 60.5")
selector_query(
    "selector_and",
    Selector(devices=["Backyard", "Garage"], weekdays=["monday", "friday"], date_range=("2024-01-03", None),
             duration_range=(None, 120), time_range=("06:00:00", "20:00:00")),
    f"device IN ('Backyard', 'Garage') AND lower(dayname(dt)) IN ('monday', 'friday') AND CAST(dt AS DATE) >= DATE '2024-01-03'"
    f" AND duration_s <= 120 AND {T} BETWEEN 21600 AND 72000",
)
selector_query("selector_empty_list", Selector(devices=["Backyard"], filenames=[], weekdays=["monday"]), "device = 'Backyard'")


@query("filter_filenames", with_ctes("clipd", SQL_KEPT + """ WHERE filename IN (
  SELECT filename FROM clips GROUP BY filename HAVING sum(file_size) > 60)"""))
def filter_filenames(spark, sf):
    """A long list of names is a table and a semi join."""
    clips = clipd(spark, sf)
    names = fx.clips(spark, sf).groupBy("filename").agg(F.sum("file_size").alias("mb")).filter("mb > 60")
    return with_names(clips, names).select(*KEPT)


OR_SQL = f"(device = 'Walkway' AND {T} <= 36000) OR (lower(dayname(dt)) = 'sunday' AND duration_s >= 30)"
OR_SELECTORS = [Selector(devices=["Walkway"], time_range=(None, "10:00:00")), Selector(weekdays=["sunday"], duration_range=(30, None))]


@query("selectors_or", with_ctes("clipd", f"SELECT load_seq, filename, device, dt, duration_s FROM ({SQL_DEDUP.format(src='clipd')}) WHERE {OR_SQL}"))
def selectors_or(spark, sf):
    return Story("either", OR_SELECTORS).select(clipd(spark, sf)).select(*KEPT)


@query("filter_occupancy", with_ctes("clipd caldays", """SELECT load_seq, filename, device, c.dt, duration_s FROM clipd c
  LEFT JOIN caldays d ON d.date = CAST(c.dt AS DATE) WHERE coalesce(status, 'UNKNOWN') IN ('OCCUPIED', 'UNKNOWN')"""))
def occupancy_filter(spark, sf):
    return filter_occupancy(clipd(spark, sf), fx.calendar(spark), ["OCCUPIED", "UNKNOWN"]).select(*KEPT)


STORY = Story("mornings", [Selector(devices=["Backyard", "Front Door", "Garage"], time_range=("05:00:00", "12:00:00")),
                           Selector(date_regex="2024-01-(10|11|12)")], ["OCCUPIED", "NOT_OCCUPIED"])
STORY_SQL = f"""WITH picked AS ({SQL_DEDUP.format(src='clipd')}), story AS (SELECT p.* FROM picked p
  LEFT JOIN caldays d ON d.date = CAST(p.dt AS DATE)
  WHERE ((device IN ('Backyard', 'Front Door', 'Garage') AND {T} BETWEEN 18000 AND 43200)
      OR regexp_matches({D}, '^(?:^2024-01-(10|11|12)$)'))
    AND coalesce(status, 'UNKNOWN') IN ('OCCUPIED', 'NOT_OCCUPIED'))"""


@query("story_select", with_ctes("clipd caldays", STORY_SQL + " SELECT load_seq, filename, device, dt, duration_s FROM story"))
def story_select(spark, sf):
    return STORY.select(clipd(spark, sf), fx.calendar(spark)).select(*KEPT)


@query("story_statistics", with_ctes("clipd caldays tags", STORY_SQL + """, t AS (SELECT * FROM tags WHERE filename IN (SELECT 'V' || CAST(CAST(substr(filename, 2, 3) AS INT) AS VARCHAR) FROM story))
  SELECT (SELECT count(*) FROM story) AS num_videos, (SELECT CAST(sum(frame_count) AS BIGINT) FROM story) AS num_frames,
    (SELECT round(sum(duration_s), 6) FROM story) AS seconds, (SELECT round(sum(file_size), 6) FROM story) AS size_mb,
    (SELECT round(sum(frame_count) / sum(duration_s), 6) FROM story) AS avg_fps,
    (SELECT count(*) FROM t) AS num_tags, (SELECT count(*) FROM (SELECT DISTINCT filename, frame_number FROM t)) AS num_tagged_frames,
    (SELECT count(DISTINCT filename) FROM t) AS num_tagged_videos"""))
def story_statistics(spark, sf):
    """Totals of a story; the given detections are keyed to clips by their device number."""
    chosen = STORY.select(clipd(spark, sf), fx.calendar(spark), ordered=False)
    keyed = chosen.withColumn("filename", F.concat(F.lit("V"), F.substring("filename", 2, 3).cast("int").cast("string")))
    return rounded(ops.catalog_stats(keyed, fx.tags(spark, sf)), "seconds", "size_mb", "avg_fps")


@query("story_daily_activity", with_ctes("clipd caldays", STORY_SQL + " " + sql_wide("activity", "CAST(dt AS DATE)", "date", "story")))
def story_daily_activity(spark, sf):
    return rollup.daily(STORY.select(clipd(spark, sf), fx.calendar(spark), ordered=False), "activity", fx.PIVOT_DEVICES)


@query("dedup_clips", with_ctes("clips", SQL_DEDUP.format(src="clips")))
def dedup_clips(spark, sf):
    return ops.dedup_clips(fx.clips(spark, sf))


@query("catalog_union", with_ctes("clips", """SELECT * EXCLUDE (rn, a) FROM (SELECT *, row_number() OVER (PARTITION BY filename, dt ORDER BY a, load_seq) AS rn
  FROM (SELECT 0 AS a, * FROM clips WHERE load_seq % 10 < 7 UNION ALL
        SELECT 1 AS a, * REPLACE (file_size * 2 AS file_size) FROM clips WHERE load_seq % 10 >= 5)) WHERE rn = 1"""))
def catalog_union(spark, sf):
    """Two overlapping archives that cover the table between them."""
    clips = fx.clips(spark, sf)
    second = clips.filter("load_seq % 10 >= 5").withColumn("file_size", F.col("file_size") * 2)
    return ops.union_archives([clips.filter("load_seq % 10 < 7"), second])


@query("catalog_stats", with_ctes("clips", """SELECT count(*) AS num_videos, CAST(sum(frame_count) AS BIGINT) AS num_frames,
  round(sum(duration_s), 6) AS seconds, round(sum(file_size), 6) AS size_mb, round(sum(frame_count) / sum(duration_s), 6) AS avg_fps FROM clips"""))
def catalog_stats(spark, sf):
    return rounded(ops.catalog_stats(fx.clips(spark, sf)), "seconds", "size_mb", "avg_fps")


@query("dashboard_totals", with_ctes("clips", """WITH t AS (SELECT count(*) AS num_videos, count(DISTINCT CAST(dt AS DATE)) AS num_days,
  CAST(sum(frame_count) AS BIGINT) AS num_frames, sum(file_size) AS size_mb, sum(duration_s) AS seconds FROM clips)
  SELECT num_videos, num_days, num_frames, round(size_mb, 4) AS size_mb, round(seconds, 4) AS seconds,
    round(num_videos / num_days, 6) AS videos_per_day, CAST(floor(seconds / 86400) AS BIGINT) AS days,
    CAST(floor((seconds % 86400) / 3600) AS BIGINT) AS hours, CAST(floor((seconds % 3600) / 60) AS BIGINT) AS minutes,
    round(seconds % 60, 4) AS rest_seconds, round(size_mb / 1024, 4) AS size_gb FROM t"""))
def dashboard_totals(spark, sf):
    out = rounded(ops.dashboard_totals(fx.clips(spark, sf)), "videos_per_day")
    return rounded(out, "size_mb", "seconds", "rest_seconds", "size_gb", digits=4)


@query("catalog_bounds", with_ctes("clips", "SELECT CAST(min(dt) AS DATE) AS min_date, CAST(max(dt) AS DATE) AS max_date FROM clips"))
def catalog_bounds(spark, sf):
    return ops.catalog_bounds(fx.clips(spark, sf))


# ---- devices ----
@query("device_asof", with_ctes("clipd", "SELECT load_seq, serial, dt, device FROM clipd"))
def device_asof(spark, sf):
    return clipd(spark, sf).select("load_seq", "serial", "dt", "device")


def derived_devices(spark, sf):
    """A device dimension with one entry per order: serial from the customer, dates from the order."""
    return fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS ord", "concat('C', o_custkey) AS serial", "concat('D', o_custkey % 97, '_', o_orderstatus) AS device",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 90 AS INT)) END AS end_date",
    )


SQL_DERIVED = """dd AS (SELECT o_orderkey AS ord, concat('C', o_custkey) AS serial, concat('D', o_custkey % 97, '_', o_orderstatus) AS device,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) END AS end_date FROM orders)"""


@query("validate_device_overlap", f"""WITH {SQL_DERIVED}, n AS (SELECT serial, device, end_date,
    lead(device) OVER w AS next_device, lead(start_date) OVER w AS next_start FROM dd
    WINDOW w AS (PARTITION BY serial ORDER BY start_date NULLS FIRST, ord)) SELECT * FROM n WHERE end_date >= next_start""")
def validate_device_overlap(spark, sf):
    return dev.device_overlaps(derived_devices(spark, sf))


@query("distinct_devices", f"WITH {SQL_DERIVED} SELECT device, min(ord) AS first_ord FROM dd GROUP BY device")
def distinct_devices(spark, sf):
    return dev.distinct_devices(derived_devices(spark, sf))


@query("selector_devices_union", with_ctes("clipd", """WITH sel AS (SELECT dayname(dt) AS story, list(DISTINCT device) AS devices FROM clipd GROUP BY 1)
  SELECT DISTINCT unnest(devices) AS device FROM sel"""))
def selector_devices_union(spark, sf):
    """Union of the device lists of one selector per weekday."""
    lists = clipd(spark, sf).groupBy(F.date_format("dt", "EEEE").alias("story")).agg(F.collect_set("device").alias("devices"))
    return dev.devices_union(lists)


# ---- folders and plans ----
SQL_BADNAMES = """b AS (SELECT * REPLACE (CASE WHEN load_seq % 50 = 0 THEN 'X' || filename ELSE filename END AS filename) FROM clips)"""


def misnamed(spark, sf):
    bad = F.when(F.col("load_seq") % 50 == 0, F.concat(F.lit("X"), "filename")).otherwise(F.col("filename"))
    return fx.clips(spark, sf).withColumn("filename", bad)


@query("format_check", with_ctes("clips", f"""WITH {SQL_BADNAMES} SELECT strftime(dt, '%Y%m%d') AS day, serial,
  bool_and(starts_with(filename, serial || '_' || strftime(dt, '%Y%m%d'))) AS all_valid, count(*) AS clips FROM b GROUP BY 1, 2"""))
def format_check(spark, sf):
    return ops.format_check(misnamed(spark, sf))


@query("rename_plan", with_ctes("clips", f"""WITH {SQL_BADNAMES}, f AS (SELECT strftime(dt, '%Y%m%d') AS day, serial, filename,
    bool_and(starts_with(filename, serial || '_' || strftime(dt, '%Y%m%d'))) OVER (PARTITION BY strftime(dt, '%Y%m%d'), serial) AS ok FROM b),
  n AS (SELECT serial, day, filename, row_number() OVER (PARTITION BY serial, day ORDER BY filename) AS n FROM (SELECT DISTINCT serial, day, filename FROM f WHERE NOT ok))
  SELECT serial, day, filename, concat(serial, '_', day, '_TEMP_', printf('%05d', n), '.mp4') AS temp_name,
    concat(serial, '_', day, '_', printf('%05d', n), '.mp4') AS final_name FROM n"""))
def rename_plan(spark, sf):
    return ops.rename_plan(misnamed(spark, sf))


@query("write_playlist", with_ctes("clipd", """WITH e AS (SELECT concat('#EXTINF:-1,', strftime(dt, '%Y-%m-%d %H:%M:%S'), ' ', device, ' - ', filename, ' - ',
  CAST(width AS VARCHAR), 'x', CAST(height AS VARCHAR)) AS info, full_path FROM clipd)
  SELECT value, count(*) AS copies, bool_or(first) AS first FROM (SELECT '#EXTM3U' AS value, true AS first UNION ALL SELECT info, false FROM e UNION ALL SELECT full_path, false FROM e) GROUP BY value"""))
def write_playlist(spark, sf):
    """The written file: its header comes first, and every clip brings its two lines."""
    path = scratch_path(spark, "playlist")
    src.write_playlist(clipd(spark, sf), path)
    lines = src.read_playlist(spark, path)
    return lines.groupBy("value").agg(F.count("*").alias("copies"), (F.min("line") == 1).alias("first"))


@query("tagging_workload", with_ctes("clips", "SELECT serial, CAST(sum(ceil(duration_s * 1.5)) AS BIGINT) AS frames_to_tag FROM clips GROUP BY serial"))
def tagging_workload(spark, sf):
    return fx.clips(spark, sf).groupBy("serial").agg(ops.tagging_workload(None, 1.5).alias("frames_to_tag"))


SQL_ROBUST = """r AS (SELECT {key}, list_sort(list({value})) AS v FROM {src} WHERE {value} IS NOT NULL GROUP BY {key}),
  q AS (SELECT {key}, v, len(v) AS n, v[CAST(len(v) // 4 AS INT) + 1] AS q1, v[CAST((3 * len(v)) // 4 AS INT) + 1] AS q3 FROM r),
  m AS (SELECT {key}, CASE WHEN n < 4 THEN list_sum(v) / n WHEN q3 - q1 < 0.001 THEN v[1]
    ELSE coalesce(list_avg(list_filter(v, lambda x: x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))), list_avg(v)) END AS robust_mean FROM q)"""


@query("robust_mean_iqr", with_ctes("clips", "WITH " + SQL_ROBUST.format(key="serial", value="duration_s", src="clips") + " SELECT serial, round(robust_mean, 6) AS robust_mean FROM m"))
def robust_mean_iqr(spark, sf):
    return rounded(ops.robust_mean(fx.clips(spark, sf), ["serial"], "duration_s"), "robust_mean")


@query("default_fps", with_ctes("clips", "WITH " + SQL_ROBUST.format(key="serial", value="fps", src="clips")
       + " SELECT serial, greatest(1, CAST(round_even(robust_mean, 0) AS INT)) AS default_fps FROM m"))
def default_fps(spark, sf):
    return ops.default_fps(fx.clips(spark, sf), ["serial"])


@query("default_width", with_ctes("clips", "SELECT serial, CAST(floor(max(width) * (CAST(0.9 AS DOUBLE) - CAST(0.25 AS DOUBLE))) AS INT) AS default_width FROM clips GROUP BY serial"))
def default_width(spark, sf):
    return ops.default_width(fx.clips(spark, sf), ["serial"], roi=(0.25, 0.0, 0.9, 1.0))


# ---- scalar functions ----
@query("parse_clip_path", with_ctes("clips", f"""WITH {SQL_BADNAMES}, p AS (SELECT load_seq, CASE WHEN load_seq % 37 = 0 THEN '/archive/noise.mp4'
    WHEN load_seq % 41 = 0 THEN concat('/archive/', serial, '_20241350', load_seq, '.mp4') ELSE concat('/archive/', filename) END AS path FROM b)
  SELECT load_seq, regexp_extract(path, '[^/]*$') AS name, split_part(regexp_extract(path, '[^/]*$'), '_', 1) AS serial,
    try_strptime(CASE WHEN regexp_matches(substr(split_part(regexp_extract(path, '[^/]*$'), '_', 2), 1, 14), '^[0-9]{{14}}$')
      THEN substr(split_part(regexp_extract(path, '[^/]*$'), '_', 2), 1, 14) END, '%Y%m%d%H%M%S') AS dt FROM p"""))
def parse_clip_path(spark, sf):
    path = (
        F.when(F.col("load_seq") % 37 == 0, F.lit("/archive/noise.mp4"))
        .when(F.col("load_seq") % 41 == 0, F.concat(F.lit("/archive/"), "serial", F.lit("_20241350"), "load_seq", F.lit(".mp4")))
        .otherwise(F.concat(F.lit("/archive/"), "filename"))
    )
    return misnamed(spark, sf).select("load_seq", path.alias("path")).select(
        "load_seq", C.basename(F.col("path")).alias("name"), C.path_serial(F.col("path")).alias("serial"), C.path_time(F.col("path")).alias("dt")
    )


@query("resolve_clip_time", with_ctes("clips devices", """WITH r AS (SELECT load_seq, dt AS real_dt,
    CASE WHEN load_seq % 3 = 0 THEN full_path ELSE concat('/archive/', serial, '_bad.mp4') END AS full_path,
    CASE WHEN load_seq % 3 = 1 THEN dt END AS container_utc, CASE WHEN load_seq % 6 = 2 THEN dt + INTERVAL 1 DAY END AS file_time FROM clips),
  p AS (SELECT *, split_part(regexp_extract(full_path, '[^/]*$'), '_', 1) AS serial, CASE WHEN load_seq % 3 = 0 THEN real_dt END AS named FROM r),
  a AS (SELECT *, coalesce(named, TIMESTAMP '1900-01-01') AS lk FROM p)
  SELECT load_seq, coalesce(named, container_utc - INTERVAL 5 HOUR, file_time, TIMESTAMP '1900-01-01') AS dt,
    coalesce((SELECT arg_min(d.device, d.ord) FROM devices d WHERE d.serial = a.serial AND (d.start_date IS NULL OR a.lk >= d.start_date) AND (d.end_date IS NULL OR a.lk <= d.end_date)),
      (SELECT arg_min(d.device, d.ord) FROM devices d WHERE d.serial = a.serial), a.serial) AS device FROM a"""))
def resolve_clip_time(spark, sf):
    """Names, container times and file times go missing in turn; January New York is five hours behind UTC."""
    raw = fx.clips(spark, sf).selectExpr(
        "load_seq", "CASE WHEN load_seq % 3 = 0 THEN full_path ELSE concat('/archive/', serial, '_bad.mp4') END AS full_path",
        "CASE WHEN load_seq % 3 = 1 THEN dt END AS container_utc", "CASE WHEN load_seq % 6 = 2 THEN dt + INTERVAL 1 DAY END AS file_time",
    )
    return ops.resolve_clips(raw, fx.devices(spark), "America/New_York").select("load_seq", "dt", "device")


BAD_DURATION = """CASE event_id % 8 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN -value WHEN 2 THEN CAST('NaN' AS DOUBLE)
  WHEN 3 THEN CAST('Infinity' AS DOUBLE) WHEN 4 THEN value + 86400 ELSE value END"""
BAD_SQL = f"""SELECT event_id AS load_seq, {BAD_DURATION} AS container_s, CAST(floor(value * 15) AS BIGINT) AS frames,
  CASE WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(15 AS DOUBLE) END AS fps FROM events"""


@query("repair_duration", f"""WITH b AS ({BAD_SQL}), c AS (SELECT *, CASE WHEN frames > 0 AND fps > 0 THEN CAST(frames - 1 AS DOUBLE) / fps END AS computed FROM b)
  SELECT load_seq, CAST(round(CASE WHEN isnan(container_s) OR isinf(container_s) OR container_s <= 0 OR (computed IS NOT NULL AND container_s > 86400)
    THEN coalesce(computed, container_s) ELSE container_s END, 6) AS VARCHAR) = 'nan' AS is_nan,
    CASE WHEN isnan(container_s) AND computed IS NULL OR isinf(container_s) AND computed IS NULL THEN NULL ELSE
      round(CASE WHEN isnan(container_s) OR isinf(container_s) OR container_s <= 0 OR (computed IS NOT NULL AND container_s > 86400)
        THEN coalesce(computed, container_s) ELSE container_s END, 6) END AS duration_s FROM c""")
def repair_duration(spark, sf):
    fx.table(spark, sf, "events").createOrReplaceTempView("_raw_events")
    bad = spark.sql(BAD_SQL.replace("FROM events", "FROM _raw_events"))
    fixed = bad.withColumn("d", C.repair_duration(F.col("container_s"), F.col("frames"), F.col("fps")))
    finite = ~F.isnan("d") & (F.abs("d") != F.lit(float("inf")))
    return fixed.select("load_seq", F.isnan("d").alias("is_nan"), F.when(finite, F.round("d", 6)).alias("duration_s"))


@query("clip_time_parts", with_ctes("clips", """SELECT load_seq, strftime(dt, '%Y-%m-%d') AS date_str, strftime(dt, '%H:%M:%S') AS time_str,
  strftime(dt, '%Y-%m-%d %H:%M:%S') AS datetime_str, dayname(dt) AS weekday FROM clips"""))
def clip_time_parts(spark, sf):
    return ops.clip_time_parts(fx.clips(spark, sf))


@query("scatter_points", with_ctes("clipd", """SELECT load_seq, device, duration_s, file_size, CAST(width AS BIGINT) * height * frame_count AS pixel_count,
  concat(CAST(width AS VARCHAR), 'x', CAST(height AS VARCHAR)) AS resolution, dayname(dt) AS day_of_week FROM clipd"""))
def scatter_points(spark, sf):
    return ops.scatter_points(clipd(spark, sf))


@query("decimal_hour_label", with_ctes("clips", """WITH h AS (SELECT load_seq, hour(dt) + floor((minute(dt) + second(dt) / 60.0::DOUBLE) / 5.0::DOUBLE) / 12.0::DOUBLE + 1.0::DOUBLE / 24 AS h FROM clips)
  SELECT load_seq, printf('%02d:%02d:%02d', CAST(floor(h) AS BIGINT), CAST(floor((h - floor(h)) * 60) AS BIGINT),
    CAST(floor(((h - floor(h)) * 60 - floor((h - floor(h)) * 60)) * 60) AS BIGINT)) AS label FROM h"""))
def decimal_hour_label(spark, sf):
    return fx.clips(spark, sf).select("load_seq", C.decimal_hour_label(C.hour_bin(F.col("dt"), 12)).alias("label"))


@query("frame_sample_plan", with_ctes("clips", """WITH s AS (SELECT load_seq, filename, frame_count, CAST(ceil(duration_s * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n FROM clips),
  p AS (SELECT *, greatest(1, frame_count // n) AS stride FROM s WHERE n > 0 AND frame_count > 0)
  SELECT load_seq, filename, unnest(generate_series(0, least(frame_count - 1, stride * (n - 1)), stride)) AS frame FROM p"""))
def frame_sample_plan(spark, sf):
    return ops.frame_samples(fx.clips(spark, sf), 0.2)


@query("render_plan", with_ctes("clipd", """WITH p AS (SELECT *, CASE WHEN width * 9 > height * 16 THEN (height * 16) // 9 ELSE width END AS aspect_w,
    CASE WHEN width * 9 < height * 16 THEN (width * 9) // 16 ELSE height END AS aspect_h,
    greatest(1, least(CAST(floor(width * (CAST(0.9 AS DOUBLE) - CAST(0.25 AS DOUBLE))) AS INT), width)) AS roi_w,
    greatest(1, least(CAST(floor(height * (CAST(0.75 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS INT), height)) AS roi_h FROM clipd),
  r AS (SELECT *, greatest(0, least(CAST(floor(width * CAST(0.25 AS DOUBLE)) AS INT), width - roi_w)) AS roi_x,
    greatest(0, least(CAST(floor(height * CAST(0.1 AS DOUBLE)) AS INT), height - roi_h)) AS roi_y FROM p)
  SELECT load_seq, filename, aspect_w, aspect_h, roi_x, roi_y, roi_w, roi_h, 1280 AS target_w,
    CAST(floor(floor(1280 * roi_h / CAST(roi_w AS DOUBLE)) / 2) * 2 AS INT) AS target_h,
    concat(strftime(dt, '%Y-%m-%d'), '    ', strftime(dt, '%H:%M:%S')) AS label,
    concat(strftime(dt, '%Y-%m-%d'), ' ', strftime(dt, '%H:%M:%S'), ' ', device, '.mp4') AS fragment_name FROM r"""))
def render_plan(spark, sf):
    return ops.render_plan(clipd(spark, sf), 1281, roi=(0.25, 0.1, 0.9, 0.75))


@query("audio_level_db", """SELECT user_id, round(20 * log10(greatest(sqrt(avg(power(value / 500, 2))), 1e-12)), 6) AS rms_dbfs,
  round(20 * log10(greatest(max(abs(value / 500)), 1e-12)), 6) AS peak_dbfs FROM events GROUP BY user_id""")
def audio_level_db(spark, sf):
    """Loudness of each clip over a table of samples."""
    out = ops.audio_levels(fx.table(spark, sf, "events"), ["user_id"], F.col("value") / 500)
    return rounded(out, "rms_dbfs", "peak_dbfs")


@query("story_outputs", with_ctes("clipd caldays", STORY_SQL + """ SELECT filename, dt, device, true AS listed, (SELECT count(*) FROM story) AS num_videos,
  (SELECT count(*) FROM (SELECT DISTINCT CAST(dt AS DATE) FROM story)) AS num_days FROM story"""))
def story_outputs(spark, sf):
    """A run of one story; its metadata, playlist, totals and daily frame are read back."""
    analysis = Analysis(archives=[], output=scratch_path(spark, "stories"), stories=[STORY])
    folder = run_stories(analysis, clipd(spark, sf), fx.calendar(spark), devices=fx.PIVOT_DEVICES)[STORY.name]
    written = src.read_catalog_csv(spark, f"{folder}/metadata")[0]
    lines = src.read_playlist(spark, f"{folder}/playlist").select(F.col("value").alias("full_path"), F.lit(True).alias("_in")).distinct()
    totals = spark.read.json(f"{folder}/statistics").first()
    days = spark.read.option("header", True).csv(f"{folder}/daily-activity").count()
    out = written.join(lines, "full_path", "left").select("filename", "dt", "device", F.coalesce("_in", F.lit(False)).alias("listed"))
    return out.select("*", F.lit(totals.num_videos).alias("num_videos"), F.lit(days).cast("bigint").alias("num_days"))


EVENING = Story.from_dict({"name": "evenings", "selectors": [{"devices": ["Backyard", "Garage"], "time_range": {"start": "17:00:00", "end": "23:30:00"}}]})
RUN_SQL = """WITH u AS (SELECT * FROM clipd QUALIFY row_number() OVER (PARTITION BY filename, dt ORDER BY load_seq) = 1),
  s AS (SELECT * FROM u WHERE device IN ('Backyard', 'Garage') AND CAST(dt AS TIME) BETWEEN TIME '17:00:00' AND TIME '23:30:00'),
  t AS (SELECT DISTINCT filename, load_seq % 5 AS frame_number FROM clipd WHERE filename IN (SELECT filename FROM s))
  SELECT filename, dt, device, (SELECT count(*) FROM s) AS num_videos, (SELECT count(*) FROM t) AS num_tags, (SELECT count(DISTINCT filename) FROM t) AS num_tagged_videos FROM s"""


@query("analysis_run", with_ctes("clipd", RUN_SQL))
def analysis_run(spark, sf):
    """A run from its files: two archives that overlap, two tag files that overlap, and one story."""
    root = scratch_path(spark, "analysis")
    clips = clipd(spark, sf)
    whole = ops.dedup_clips(clips)
    src.write_catalog_csv(whole.filter("load_seq % 10 < 7"), f"{root}/a")
    src.write_catalog_csv(whole.filter("load_seq % 10 >= 5"), f"{root}/b")
    tags = clips.selectExpr(
        "filename", "CAST(load_seq % 5 AS INT) AS frame_number", "'TRACKED_OBJECT' AS type", "'person' AS value", "0.5D AS confidence",
        "load_seq % 3 + 1 AS track_id", "10 AS x1", "10 AS y1", "50 AS x2", "90 AS y2", "load_seq AS ord", "load_seq")
    write_tags_json(tags.filter("load_seq % 4 < 3"), f"{root}/t1", "2024-02-01T00:00:00")
    write_tags_json(tags.filter("load_seq % 4 >= 2"), f"{root}/t2", "2024-02-02T00:00:00")
    analysis = Analysis.from_dict({
        "video_database_list": [{"video_metadata_file": f"{root}/{n}"} for n in "ab"], "tag_database_files": [f"{root}/t1", f"{root}/t2"],
        "output_directory": f"{root}/out"})
    folder = run_analysis(replace(analysis, stories=[EVENING]), spark)[EVENING.name]
    totals = spark.read.json(f"{folder}/statistics").first()
    counts = [F.lit(totals[c]).cast("bigint").alias(c) for c in ("num_videos", "num_tags", "num_tagged_videos")]
    return src.read_catalog_csv(spark, f"{folder}/metadata")[0].select("filename", "dt", "device", *counts)
